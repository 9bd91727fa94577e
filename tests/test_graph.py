import random

from seedscape.operators import graph, similarity
from seedscape.operators.matching import match_by_doi
from seedscape.plans import review

EDGES = [("a", "b"), ("b", "c"), ("d", "b"), ("c", "e"), ("x", "y"), ("e", "f")]


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def edges(spark):
    return spark.createDataFrame(EDGES, "id string, cited_id string")


def found(df):
    return sorted(r["id"] for r in df.collect())


def test_both_directions_and_lone_ids(spark):
    assert found(graph.follow_citations(ids(spark, "b", "nobody"), edges(spark))) == ["a", "b", "c", "d"]
    assert found(graph.expand(ids(spark, "a"), edges(spark), 2)) == ["a", "b", "c", "d"]
    assert found(graph.expand(ids(spark, "a"), edges(spark), 3)) == ["a", "b", "c", "d", "e"]


def test_runs_do_not_mix(spark):
    seeds = spark.createDataFrame([(1, "a"), (2, "x")], "run int, id string")
    rows = graph.expand(seeds, edges(spark), 2, ["run"]).collect()
    assert sorted((r["run"], r["id"]) for r in rows) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "x"), (2, "y")]


def test_expansion_grows_and_matches_brute_force_with_a_hub(spark):
    rng = random.Random(1)
    links = [(f"n{i}", "hub") for i in range(150)] + [(f"n{rng.randint(0, 200)}", f"n{rng.randint(0, 200)}") for _ in range(100)]
    table = spark.createDataFrame(links, "id string, cited_id string")
    known = {"n3", "n77"}
    before = set()
    for degrees in (1, 2, 3):
        plain = set(known)
        for _ in range(degrees):
            plain = {end for link in links if plain & set(link) for end in link}
        got = set(found(graph.expand(ids(spark, *known), table, degrees)))
        assert got == plain and before <= got
        before = got


def test_neighbour_counts_count_edges(spark):
    rows = graph.neighbour_counts(ids(spark, "b"), edges(spark), 2).collect()
    assert {r["id"]: r["n_reached"] for r in rows} == {"a": 1, "c": 1, "d": 1, "b": 3, "e": 1}


def test_references_in_both_directions(spark):
    assert found(graph.references_of(edges(spark), "b")) == ["c"]
    assert found(graph.references_of(edges(spark), "b", "in")) == ["a", "d"]


def test_doi_match_cases(spark):
    reviews = spark.createDataFrame([(1, "one"), (2, "none"), (3, "many"), (4, "tied"), (5, None)], "id long, doi string")
    records = spark.createDataFrame(
        [(10, "one", 0.1), (11, "many", 0.2), (12, "many", 0.3), (13, "tied", 0.5), (14, "tied", 0.5), (15, "tied", 0.4), (16, None, 9.0)],
        "id long, doi string, pagerank double",
    )
    got = {r["id"]: (r["n_matches"], r["match_id"], r["multiple_match_flag"]) for r in match_by_doi(reviews, records).collect()}
    assert got == {1: (1, 10, 0), 2: (0, None, 0), 3: (2, 12, 1), 4: (3, None, 1), 5: (0, None, 0)}


def test_many_runs_travel_as_bits(spark):
    """A hundred runs, some of them equal, one without a key: as if each went alone; an ID has a row per 64 runs."""
    rng = random.Random(5)
    links = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(90)]
    table = spark.createDataFrame(links, "id string, cited_id string")
    starts = {run: {f"n{rng.randint(0, 60)}" for _ in range(run % 4 + 1)} for run in range(100)}
    starts[None] = starts[7]
    rows = [(run, i) for run, own in starts.items() for i in own]
    seeds = spark.createDataFrame(rows + rows[:5], "run int, id string")
    reached, counted = {}, {}
    for run, own in starts.items():
        ring = set(own)
        counts = {}
        for _ in range(2):
            hits = [far for a, b in links for near, far in ((a, b), (b, a)) if near in ring]
            for far in hits:
                counts[far] = counts.get(far, 0) + 1
            ring = set(hits)
        counted |= {(run, i): n for i, n in counts.items()}
        ring = set(own)
        for _ in range(2):
            ring = {x for a, b in links if a in ring or b in ring for x in (a, b)}
        reached[run] = ring
    found = {}
    for r in graph.expand(seeds, table, 2, ["run"]).collect():
        assert r["id"] not in found.setdefault(r["run"], set())
        found[r["run"]].add(r["id"])
    assert found == {run: ids_ for run, ids_ in reached.items() if ids_}
    assert {(r["run"], r["id"]): r["n_reached"] for r in graph.neighbour_counts(seeds, table, 2, ["run"]).collect()} == counted
    bits = graph.to_bits(seeds, graph.number_runs(seeds, ["run"]), ["run"])
    assert bits.where("chunk = 0").count() == bits.where("chunk = 0").select("id").distinct().count() <= 61
    assert bits.select("chunk").distinct().count() == 2


def test_papers_are_looked_up_once_for_all_sets(spark, monkeypatch):
    calls, plain = [], review.attach_papers
    monkeypatch.setattr(review, "attach_papers", lambda *tables: calls.append(1) or plain(*tables))
    papers = spark.createDataFrame([(c, "t", 1.0, None if c == "e" else "1:2") for c in "abcdef"], "id string, title string, ef double, cl string")
    edges = spark.createDataFrame([("a", "c"), ("b", "d"), ("c", "e"), ("f", "f")], "id string, cited_id string")
    sets = review.collect_papers(spark.createDataFrame([("a",), ("b",)], "id string"), papers, edges, 1, degrees=1)
    (seed,), (target,) = ([r["id"] for r in rows.collect()] for rows in (sets.seeds, sets.targets))
    assert {seed, target} == {"a", "b"} and calls == [1]
    assert {r["id"] for r in sets.candidates.collect()} == {seed, {"a": "c", "b": "d"}[seed]}
    assert sets.seeds.columns == sets.targets.columns == sets.candidates.columns == papers.columns


def test_lists_of_reviews_are_cut_by_their_size(spark, monkeypatch):
    """A task holds a bounded number of pairs, whatever the number of shuffle partitions."""
    monkeypatch.setattr(similarity, "TASK_TERMS", 100)
    edges = spark.range(4000).selectExpr("id % 500 AS id", "id % 250 AS cited_id")
    reviews = spark.range(400).unionByName(spark.range(100)).select("id")
    found = graph.lists_of_reviews(edges, reviews)
    assert found.rdd.getNumPartitions() == 40
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(i % 500, i % 250) for i in range(4000) if i % 500 < 400}
