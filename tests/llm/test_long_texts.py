"""Texts of 30 MB under a bound on memory, each operator in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
START = """
import random, resource
from seedscape.llm import near_copies, pii, simhash, suffix_dedup
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
rng = random.Random(1)
words = [str(rng.randint(0, 10**7)).encode() for _ in range(50_000)]
text = b" ".join(rng.choices(words, k=4_000_000))[: 30 << 20]
before = peak()
"""
CODE = {
    "op2": "simhash.fingerprint(text, 4)",
    "near copies": "near_copies.wide_fingerprint(near_copies.shingle_set(text, 5, near_copies._WordHashes()))",
    "op8": "pii.pseudonymized(text.decode(), pii.Feistel(b'k'))",
    "op10": """
import numpy as np, pyarrow as pa
class Frame:  # what _cut hands to its tasks
    def select(self, *columns): return self
seen = {}
suffix_dedup.map_batches = lambda frame, run, schema: seen.update(run=run)
suffix_dedup.text_bytes = lambda name: name
suffix_dedup._cut(Frame(), 100)
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["_doc", "text"])
assert sum(len(b) for b in seen["run"](iter([batch]))) > 100_000
""",
}


@pytest.mark.parametrize("name", CODE)
def test_long_text_stays_within_bounds(name):
    code = START + CODE[name] + "\nprint(peak() - before)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 700
