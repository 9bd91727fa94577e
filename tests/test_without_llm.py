"""The entry point without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and set(e.oracle_sql()) <= set(q); print(sorted(x for x in q if x.startswith('op') or x == 'pipeline'))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_other_queries_are_listed_without_the_optional_folders(tmp_path, pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[]"
