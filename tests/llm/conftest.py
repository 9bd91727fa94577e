import random

import pytest

from pyspark.sql import functions as F

WORDS = "the of and shard token résumé größe 1234 x9 a- -- state machine learning corpora 東京 tower".split()


@pytest.fixture()
def texts():
    """Some invented texts with nulls, empties, copies, white space of all kinds and a long one."""
    rng = random.Random(7)
    made = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(40)]
    made += [None, "", " ", "\t\n ", made[0], made[0], made[1] + " end", made[2].upper(), "A B C", "  two  spaces \n\n\n x "]
    return made + ["".join(rng.choices("ab cd\n  'll 12é,", k=5000)), "z" * 3000 + " " * 500 + "'re"]


@pytest.fixture()
def docs(spark, texts):
    """The texts with ids, one null id and clashing extra columns."""
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    return frame.withColumns({"ids": F.lit(1), "key": F.lit("k"), "start": F.lit(None).cast("int"), "fingerprint": F.lit("f")})


@pytest.fixture()
def no_docs(docs):
    return docs.limit(0)
