import hashlib

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from seedscape.llm import bpe, decontaminate, pii, quality
from seedscape.llm.queries import PATTERN, PSEUDONYM_KEY, RANKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, documents):
    """Documents with nulls, empties, a long text, repeats and columns that clash with the operators' own."""
    rows = [(None, None), (None, "no id"), (9001, None), (9002, ""), (9003, "very long text " * 20_000), (9004, "mail a.lee@b.com +1 (988) 555-2485")]
    more = spark.createDataFrame(rows + rows[3:], "doc_id long, text string")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.lit(9005).cast("long").alias("doc_id"), "text").limit(1)
    whole = documents.unionByName(more.unionByName(item), allowMissingColumns=True)
    clash = {name: F.lit("clash") for name in ("keep", "quality", "hits", "items", "n_words", "pii", "ids", "fingerprint", "good", "component_id")}
    return whole.withColumns(clash)


def test_stages_are_the_ones_dealt():
    assert [name for name, _ in pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]


def test_each_stage_against_brute_force(spark, odd):
    """Every stage on its own input."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = lambda df: sorted(map(str, df.collect()))

    model = quality.fit(odd, labels)
    good = pipeline.keep_good(spark, odd, SF).cache()
    assert good.columns == odd.columns and good.count() < odd.count()
    expected = [r for r in odd.collect() if _quality(model, r) >= 0.5]
    assert rows(good) == sorted(map(str, expected))

    single = pipeline.drop_near_copies(spark, good, SF).cache()
    sets = [(r.doc_id, _shingles(r.text or "")) for r in good.collect()]
    names = _components(sets)
    stay = {names[s] for _, s in sets} - {None}
    assert single.columns == odd.columns
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(stay)
    assert single.filter("doc_id is null").count() == good.filter("doc_id is null").count()

    clean = pipeline.drop_contaminated(spark, single, SF).cache()
    runs = {w for _, t in items for w in decontaminate.windows_of(decontaminate.words_of(t.encode()))}
    expected = [r for r in single.collect() if not _contaminated(r.text, runs)]
    assert rows(clean) == sorted(map(str, expected)) and 9005 not in {r.doc_id for r in expected}

    private = pipeline.replace_personal_values(spark, clean, SF).cache()
    cipher = pii.Feistel(PSEUDONYM_KEY)
    assert private.columns == odd.columns
    texts = lambda found: sorted(map(str, ((r[0], r[1]) for r in found)))
    expected = [(r.doc_id, pii.pseudonymized(r.text, cipher)[0] if r.text else r.text) for r in clean.collect()]
    assert texts(private.select("doc_id", "text").collect()) == texts(expected)

    coded = pipeline.encode(spark, private, SF)
    encoding = bpe.tokenizer(RANKS, PATTERN)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    expected = [(r.doc_id, encoding.encode_ordinary(r.text or ""), digest(r.text)) for r in private.collect()]
    found = [(r.doc_id, r.ids, r.decoded_sha256) for r in coded.collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_run_equals_the_stages_one_by_one(spark, documents):
    docs = documents
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r.doc_id, r.n_tokens, r.decoded_sha256)
    assert sorted(map(key, pipeline.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def test_stages_on_no_documents(spark, documents):
    docs = documents.limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def _quality(model, row):
    text = (row.text or "").encode()
    facts = [str(row[c]) for c in model.facts]
    content = model.content.score([quality._hashed(quality.content_tokens(text))])
    metadata = model.metadata.score([quality._hashed(quality.metadata_tokens(text, facts))])
    return quality._sigmoid(model.combine(content, metadata))[0]


def _contaminated(text, runs):
    words = decontaminate.words_of((text or "").encode())
    hit = set()
    for size in {len(w) for w in runs}:
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in runs:
                hit |= set(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def _shingles(text, size=5):
    words = text.encode().lower().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def _components(sets):
    """Smallest id per set of shingles, by the true similarity of all pairs."""
    kinds = sorted({s for _, s in sets}, key=sorted)
    root = {s: s for s in kinds}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if a & b and len(a & b) >= 0.8 * len(a | b):
                root[find(b)] = find(a)
    least = {}
    for i, s in sets:
        if i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return {s: least.get(find(s)) for s in kinds}
