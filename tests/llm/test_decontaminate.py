from pyspark.sql import functions as F

from seedscape.llm import decontaminate as d


def brute(text, items, window=13):
    words = d.words_of(text and text.encode())
    hit, ids = set(), set()
    for item_id, item in items:
        for run in d.windows_of(d.words_of(item and item.encode()), window):
            for i in range(len(words) - len(run) + 1):
                if tuple(words[i : i + len(run)]) == run:
                    hit |= set(range(i, i + len(run)))
                    ids.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(ids)


ITEMS = [
    (1, "the of and shard token"),
    (10, "Learning, corpora!"),
    (2, "tower"),
    (3, None),
    (4, ""),
    (None, "state machine"),
    (5, " ".join(f"w{i}" for i in range(30))),
    (6, " ".join(f"w{i}" for i in range(5, 25))),
    (7, " ".join(f"w{i}" for i in range(5, 25))),
    (8, "of"),
]


def test_equals_brute_force(spark, docs):
    extra = spark.createDataFrame([(900, "x " + " ".join(f"W{i}" for i in range(3, 20)) + " y"), (901, " ".join(f"w{i}" for i in range(3, 15)))], "doc_id long, text string")
    whole = docs.unionByName(extra, allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for filter_bits in (d.FILTER_BITS, 64):  # the smaller one lets almost everything through
        found = d.find_windows(whole, items, filter_bits=filter_bits)
        rows = found.withColumns({"n_hit": d.n_hit(), "contaminated": d.is_contaminated()}).collect()
        assert len(rows) == whole.count()
        assert set(found.columns) == {*docs.columns, "hits", "items"}
        for row in rows:
            n_words, n_hit, ids = brute(row.text, ITEMS)
            assert (row.n_words, row.n_hit, row["items"]) == (n_words, n_hit, ids)
            assert row.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


def test_short_windows_and_one_word_shingles(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for row in d.find_windows(docs, items, window=4, shingle=2).withColumn("n_hit", d.n_hit()).collect():
        assert (row.n_words, row.n_hit, row["items"]) == brute(row.text, ITEMS, 4)


def test_empty_sides(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.find_windows(no_docs, items).count() == 0
    clean = d.find_windows(docs, items.limit(0))
    assert clean.filter(F.size("items") > 0).count() == 0 and clean.count() == docs.count()


def test_parts_hold_every_word_once():
    long = " ".join(["ab", "c" * 40, "d,e", "  ", "f" * 700] * 30).encode()
    texts = [None, long, b"", b" .,", b"one", b"Two  three.", long[:50], b" four ", b"--"]
    for size in (1, 10, 100, 1 << 20):
        for margin in (0, 1, 5, 13):
            seen = [[] for _ in texts]
            for part in d.parts_of(texts, margin, size):
                assert part.data.split() == [part.data[a:b] for a, b in zip(part.starts, part.ends)]
                for at, (a, b, i, place) in enumerate(zip(part.starts, part.ends, part.text, part.place)):
                    assert d.words_of(texts[i])[place] == part.data[a:b]
                    if part.low <= at < part.high:
                        assert place == len(seen[i])
                        seen[i].append(part.data[a:b])
                        for near in range(max(0, place - margin), min(len(d.words_of(texts[i])), place + margin + 1)):
                            assert 0 <= at + near - place < len(part.text) and part.text[at + near - place] == i
            assert seen == [d.words_of(t) for t in texts]


def test_hash_of_a_word_depends_on_its_bytes_only():
    (whole,) = d.parts_of([b"some words, " + b"y" * 1000, None, b"", b"words some " + b"y" * 1000 + b" emos"], 3)
    made = d.word_hashes(whole).tolist()
    assert made[:3] == [made[4], made[3], made[5]] and len(set(made)) == 4
    hashes, at = whole.shingles(d.word_hashes(whole), 3)
    assert at.tolist() == [0, 3, 4] and len(set(hashes.tolist())) == 3


def test_long_items_and_texts(spark):
    """An item and a text of several parts each; the text repeats, has a giant word and holds two stretches of the item."""
    item = [f"i{i}" for i in range(300_000)]
    giant = "x" * 3_000_000
    text = " ".join([*item[150_000:150_020], giant, *[f"t{i}" for i in range(200_000)], *item[299_980:], giant, *item[7:19], "end"])
    docs = spark.createDataFrame([(1, text), (2, text), (3, " ".join(item))], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(item)), ("b", "end"), ("c", None)], "item_id string, text string")
    rows = {r.doc_id: r for r in d.find_windows(docs, items).drop("text").collect()}
    for i in (1, 2):
        assert rows[i].n_words == 20 + 1 + 200_000 + 20 + 1 + 12 + 1
        assert [(h.start, h.end) for h in rows[i].hits] == [(0, 20), (200_021, 200_041), (200_054, 200_055)]
        assert rows[i]["items"] == ["a", "b"]
    assert rows[3].n_words == 300_000 and [(h.start, h.end) for h in rows[3].hits] == [(0, 300_000)] and rows[3]["items"] == ["a"]


def test_larger_benchmark_takes_no_more_jobs(spark, docs):
    """Thirty times the items: the same number of jobs, the same hits as by brute force."""
    def jobs(items, group):
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = d.find_windows(docs, items).withColumn("n_hit", d.n_hit()).select("text", "n_words", "n_hit", "items").collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few = ITEMS[:2]
    many = few + [(100 + i, f"{a} {b} {i}") for i, (a, b) in enumerate([("the", "of"), ("shard", "token")] * 30)]
    few_rows, few_jobs = jobs(spark.createDataFrame(few, "item_id long, text string"), "few items")
    many_rows, many_jobs = jobs(spark.createDataFrame(many, "item_id long, text string"), "many items")
    assert abs(many_jobs - few_jobs) <= 2
    for rows, items in ((few_rows, few), (many_rows, many)):
        for row in rows:
            assert (row.n_words, row.n_hit, row["items"]) == brute(row.text, items)
