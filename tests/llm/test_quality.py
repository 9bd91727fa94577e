import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from seedscape.llm import quality


@pytest.fixture(scope="module")
def corpus(spark):
    """Good documents, shouted ones and insults; the sources differ too."""
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioubcdlnrst", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1200):
        kind = rng.choice(["good", "good", "good", "shout", "toxic"])
        own = rng.choices(words, k=rng.randint(20, 120))
        if kind == "shout":
            own = [w.upper() + "!!" for w in own]
        if kind == "toxic":
            own[rng.randrange(len(own))] = rng.choice(["idiot", "clown", "grobiab", "grobion"])
        docs.append((i, " ".join(own), "en", f"s{rng.randrange(5)}"))
        if i % 3:
            labels.append((i, int(kind != "shout"), int(kind == "toxic")))
    truth = {i: q == 1 and t == 0 for i, q, t in labels}
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        truth,
    )


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    held = labels.filter("doc_id % 4 = 1")
    model = quality.fit(docs, labels.filter("doc_id % 4 <> 1"))
    kept = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    ids = [r.doc_id for r in held.collect()]
    assert np.mean([kept[i] == truth[i] for i in ids]) > 0.93
    assert np.mean([kept[i] for i in ids if truth[i]]) > 0.97
    assert model.history[-1]["round"] == quality.COTRAIN_ROUNDS and sum(model.history[-1]["taught"]) > 0


def test_worker_scores_equal_the_views(corpus):
    docs, labels, _ = corpus
    model = quality.fit(docs, labels)
    for r in quality.score(docs.limit(30), model).collect():
        text, facts = r.text.encode(), (r.lang, r.source)
        content = model.content.score([quality._hashed(quality.content_tokens(text))])
        metadata = model.metadata.score([quality._hashed(quality.metadata_tokens(text, facts))])
        assert np.allclose([r.content_score, r.metadata_score], [content[0], metadata[0]])
        assert np.isclose(r.quality, quality._sigmoid(model.combine(content, metadata))[0])


def test_odd_rows_and_no_labels(corpus, spark, docs, no_docs):
    known, labels, _ = corpus
    odd = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (4, None, 0), (10**9, 0, 0)], labels.schema))
    assert {r.doc_id: r.quality for r in quality.score(known, quality.fit(known, odd)).collect()} == {
        r.doc_id: r.quality for r in quality.score(known, quality.fit(known, labels.filter("doc_id <> 4").unionByName(labels.filter("doc_id = 4")))).collect()
    }
    model = quality.fit(known, labels)
    clash = docs.withColumns({"keep": F.lit("x"), "lang": F.lit(None).cast("string"), "source": F.lit("s1")})
    rows = quality.score(clash, model).collect()
    assert len(rows) == docs.count() and all(isinstance(r.keep, bool) for r in rows)
    assert quality.score(no_docs.withColumns({"lang": F.lit(""), "source": F.lit("")}), model).count() == 0
    for untaught in (quality.fit(docs, labels.limit(0)), quality.fit(no_docs, labels)):
        assert all(r.keep and r.quality is None for r in quality.score(docs, untaught).collect())


def test_calibration_of_a_useless_score_is_the_prior():
    y = np.array([1.0, 1.0, 1.0, 0.0] * 50)
    slope, offset = quality._calibration(-y, y)
    assert slope == 0 and 0.7 < quality._sigmoid(np.array([offset]))[0] < 0.8
