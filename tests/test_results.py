import pytest
from pyspark.sql import functions as F

from seedscape.functions.pvalues import f_tail_value, t_two_sided_value
from seedscape.operators import prep, similarity, subjects
from seedscape.operators.significance import anova, pairwise_t_tests
from seedscape.scratch import new_path
from seedscape.sources import readers, runs, writers


def test_tail_probabilities_against_tables():
    assert t_two_sided_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided_value(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided_value(0.0, 5) == pytest.approx(1.0)
    assert f_tail_value(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_tail_value(0.0, 3, 7) == pytest.approx(1.0)


def test_anova_and_t_on_a_small_table(spark):
    rows = [("a", x) for x in (6.0, 8.0, 4.0, 5.0, 3.0, 4.0)]
    rows += [("b", x) for x in (8.0, 12.0, 9.0, 11.0, 6.0, 8.0)]
    rows += [("Other", x) for x in (13.0, 9.0, 11.0, 8.0, 7.0, 12.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = anova(df, "g", "x").first()
    assert (got["df_between"], got["df_within"]) == (2, 15)
    assert got["f"] == pytest.approx(9.2647, abs=1e-4) and got["p"] == pytest.approx(0.0024, abs=1e-4)
    tests = pairwise_t_tests(df, "g", "x").collect()
    assert [(t["group_a"], t["group_b"], t["df"]) for t in tests] == [("a", "b", 10)]
    # mean difference -4; squared deviations 16 and 24 over 10 degrees of freedom
    assert tests[0]["t"] == pytest.approx(-4 / (4.0 * 2 / 6) ** 0.5)
    assert tests[0]["corrected_level"] == 0.05 and tests[0]["significant"]


def test_year_column_is_guessed():
    assert prep.infer_year_column(["id", "Year"]) == "Year"
    assert prep.infer_year_column(["pub_year", "PAPER_YEAR"]) == "PAPER_YEAR"
    assert prep.infer_year_column(["yearly", "x"]) == "yearly"
    assert prep.infer_year_column(["pub_date"]) is None


def test_year_filter_keeps_boundary_and_drops_unknown(spark):
    df = spark.createDataFrame([(1, 1960), (2, 1961), (3, None)], "id int, year int")
    assert [r["id"] for r in prep.year_lowpass_filter(df, 1960).collect()] == [1]
    assert prep.year_lowpass_filter(df, None).count() == 3


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="nope"):
        prep.canonical(spark.range(1), {"nope": "id"})


def test_subjects_have_47_entries(spark):
    assert len(subjects.BROAD_FIELDS) == 47
    df = spark.createDataFrame([("Optics",), ("Poetry",), (None,)], "s string")
    assert sorted(r["field"] for r in subjects.roll_up(df, "s").collect()) == ["Natural Sciences", "Other", "Other"]


def test_similarity_of_texts(spark):
    cands = spark.createDataFrame([(1, "Deep graphs"), (2, "cooking rice"), (3, ""), (4, None)], "id long, title string")
    seeds = spark.createDataFrame([(9, "deep GRAPHS")], "id long, title string")
    got = {r["id"]: r["title_similarity"] for r in similarity.title_similarity(cands, seeds).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == got[3] == got[4] == 0.0


def test_similarity_keeps_runs_apart(spark):
    cands = spark.createDataFrame([("r", 1, "aa bb"), ("s", 1, "aa bb"), ("s", 2, "cc")], "run string, id long, title string")
    seeds = spark.createDataFrame([("r", 9, "aa bb"), ("s", 9, "cc"), ("s", 8, "cc")], "run string, id long, title string")
    rows = similarity.title_similarity(cands, seeds, ["run"]).collect()
    got = {(r["run"], r["id"]): r["title_similarity"] for r in rows}
    assert got == {("r", 1): pytest.approx(1.0), ("s", 1): 0.0, ("s", 2): pytest.approx(1.0)}


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "id long, embedding array<float>")
    seeds = spark.createDataFrame([(1,), (2,), (77,)], "id long")
    cands = spark.createDataFrame([(3,), (1,), (55,)], "id long")
    got = {r["id"]: r["embedding_similarity"] for r in similarity.embedding_similarity(cands, seeds, vectors).collect()}
    assert got[3] == pytest.approx(1.5 * 3 / (1.25**0.5 * 18**0.5))
    assert got[1] == pytest.approx(0.5 / 1.25**0.5) and got[55] is None


def test_table_formats(spark):
    assert readers.is_tab_separated("x.tsv") and readers.is_tab_separated("a/csv/b") and readers.is_tab_separated("x", "TSV")
    assert not readers.is_tab_separated("x.tsv.parquet") and not readers.is_tab_separated("x")
    with pytest.raises(TypeError):
        readers.load(spark, 3)


def test_id_list_forms(spark):
    path = new_path(spark, "ids")
    spark.createDataFrame([("ID",), (" a ",), ("",), ("b",)], "value string").coalesce(1).write.text(path)
    assert sorted(r["id"] for r in readers.read_id_list(spark, path).collect()) == ["ID", "a", "b"]
    assert sorted(r["id"] for r in readers.read_id_list(spark, path, header=True).collect()) == ["a", "b"]
    assert readers.read_id_list(spark, path, keep_blank=True).count() == 4


def test_existing_output_is_refused(spark):
    path = new_path(spark, "out")
    writers.write_new(spark.range(1), path)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_new(spark.range(1), path)


def test_exactly_one_info_record(spark):
    info = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, t string")
    assert readers.only_paper_info(info, info["id"] == 2).first()["t"] == "c"
    for wrong in (1, 3):
        with pytest.raises(RuntimeError, match="exactly one record"):
            readers.only_paper_info(info, info["id"] == wrong)


def test_restart_redoes_only_what_is_not_recorded(spark):
    folder = new_path(spark, "runs")
    wanted = spark.createDataFrame([(1, s) for s in (1, 2, 3)], "review_id int, split_seed int")
    seen = []

    def collect(open_runs):
        seen.append(sorted(r["split_seed"] for r in open_runs.collect()))
        return open_runs.selectExpr("*", f"'{len(seen)}' AS pass")

    runs.collect_pending(wanted.where("split_seed < 3"), folder, collect)
    runs.collect_pending(wanted, folder, collect)
    assert seen == [[1, 2], [3]]
    done = {r["split_seed"]: r["pass"] for r in spark.read.parquet(f"{folder}/papers.parquet").collect()}
    assert {k: str(v) for k, v in done.items()} == {1: "1", 2: "1", 3: "2"}


def test_vectors_of_several_runs(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, embedding array<float>")
    seeds = spark.createDataFrame([("r", 1), ("s", 2)], "run string, id long")
    cands = spark.createDataFrame([("r", 1), ("r", 2), ("s", 2)], "run string, id long")
    rows = similarity.embedding_similarity(cands, seeds, vectors, ["run"]).collect()
    got = {(r["run"], r["id"]): r["embedding_similarity"] for r in rows}
    assert got == {("r", 1): pytest.approx(1.0), ("r", 2): 0.0, ("s", 2): pytest.approx(1.0)}


def test_t_tests_of_flat_and_single_groups(spark):
    from seedscape.operators.significance import anova, pairwise_t_tests

    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("c", 3.0)], "k string, s double")
    found = pairwise_t_tests(rows, "k", "s").collect()
    assert len(found) == 3 and all(r["t"] is None and r["p"] is None and r["significant"] is None for r in found)
    assert anova(rows, "k", "s").first()["f"] is None


def test_p_values_of_large_samples():
    from seedscape.functions.pvalues import f_tail_value, t_two_sided_value

    for df in (1e6, 1e8, 1e10, 1e12):
        assert abs(t_two_sided_value(2.0, df) - 0.04550026389635842) < 1e-9 + 1 / df
    assert abs(t_two_sided_value(2.0, 10.0) - 0.07338803477074037) < 1e-12
    assert abs(f_tail_value(1.0, 1e9, 1e9) - 0.5) < 1e-4


def test_keys_of_a_collection_keep_their_type(spark):
    folder = new_path(spark, "typed")
    wanted = spark.createDataFrame([("007", 1), ("08", 1), ("08", 2)], "review_id string, split_seed int")
    runs.collect_pending(wanted, folder, lambda own: own.crossJoin(spark.range(4)), group_size=2)
    back = runs.read_collection(spark, folder, {"review_id": "string", "split_seed": "int"})
    assert {(r["review_id"], r["split_seed"], r["n"]) for r in back.groupBy("review_id", "split_seed").agg(F.count("*").alias("n")).collect()} == {
        ("007", 1, 4), ("08", 1, 4), ("08", 2, 4)
    }


def test_pairs_of_many_groups_are_an_ordinary_join(spark, monkeypatch):
    """Every pair once, whatever the blocks, and no loop over a broadcast table in the plan."""
    from seedscape.operators import significance

    monkeypatch.setattr(significance, "BLOCK", 4)
    rows = [(f"g{g:02d}", float(g * 3 + i * i % 7)) for g in range(15) for i in range(5)]
    tests = pairwise_t_tests(spark.createDataFrame(rows, "g string, x double"), "g", "x")
    plan = tests._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = [(r["group_a"], r["group_b"]) for r in tests.collect()]
    assert sorted(found) == [(f"g{a:02d}", f"g{b:02d}") for a in range(15) for b in range(a + 1, 15)]
    assert {r["corrected_level"] for r in tests.collect()} == {0.05 / 105}
