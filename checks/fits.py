"""Fits that a statement can repeat: Newton steps and rounds of boosting, spelled out in SQL."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import paper_sets, query, rounded, target_ids, view
from seedscape.operators import classifiers as clf
from seedscape.operators.boosting import bin_edges, boost
from seedscape.operators.features import cluster_distance, with_features
from seedscape.operators.model_tables import parts_of, score_with_tables
from seedscape.operators.prep import prepare_candidates
from seedscape.operators.ranking import rank_candidates
from seedscape.operators.sampling import split_train
from seedscape.plans.review import collect_splits, evaluate_saved, train_saved
from seedscape.scratch import materialize, new_path
from seedscape.sources.writers import save_paper_set

PAIR = ["avg_distance", "ln_ef"]
STEPS = 14

#: Candidates with two features, their class as a number and their part of the split.
FACTS = """
    facts AS (
        SELECT p.id, p.title, p.target, avg_distance, ln(1 + p.ef) AS ln_ef, CASE WHEN p.target THEN 1.0::DOUBLE ELSE 0.0 END AS y,
               row_number() OVER (ORDER BY md5('999:' || p.id), p.id) <= floor(count(*) OVER () * 4 / 5) AS is_train
        FROM {prepared} p JOIN {distances} d ON p.cl = d.cl),
    classes AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS n_all FROM facts WHERE is_train GROUP BY y)"""


def _two_facts(spark: SparkSession, sf: str) -> DataFrame:
    sets = paper_sets(spark, sf)
    prepared = materialize(prepare_candidates(sets.candidates, sets.seeds, sets.targets), "prepared")
    split = materialize(split_train(prepared), "split")
    placed = with_features(split, sets.seeds, {"avg_distance": cluster_distance})
    return materialize(placed.withColumn("ln_ef", F.log1p("ef")), "features")


def newton_sql(name: str, columns: list[str], weight: str = "1.0") -> str:
    """Tables of Newton steps from 0 on ``facts``; ``{name}_fit`` has the coefficients, the intercept last."""
    x = [*columns, "1.0"]
    n = len(x)
    made = [f"{name}_0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(n)) + ")"]
    margin = " + ".join(f"b{i} * {c}" for i, c in enumerate(x))
    for step in range(STEPS):
        sums = [f"any_value(b{i}) AS b{i}, sum(w * (p - y) * {c}) + any_value(b{i}) AS g{i}" for i, c in enumerate(x)]
        sums += [f"sum(w * p * (1 - p) * {x[i]} * {x[j]}) + {int(i == j)} AS h{i}{j}" for i in range(n) for j in range(i, n)]
        rows = f"SELECT f.*, b.*, {weight} AS w, 1 / (1 + exp(-greatest(least({margin}, 700), -700))) AS p FROM facts f JOIN classes USING (y), {name}_{step} b WHERE is_train"
        made.append(f"{name}_s{step} AS (SELECT {', '.join(sums)} FROM ({rows}))")
        if n == 2:
            det, moves = "(h00 * h11 - h01 * h01)", ["h11 * g0 - h01 * g1", "h00 * g1 - h01 * g0"]
        else:
            c = {"00": "(h11 * h22 - h12 * h12)", "01": "(h02 * h12 - h01 * h22)", "02": "(h01 * h12 - h02 * h11)"}
            c |= {"11": "(h00 * h22 - h02 * h02)", "12": "(h01 * h02 - h00 * h12)", "22": "(h00 * h11 - h01 * h01)"}
            det = f"(h00 * {c['00']} + h01 * {c['01']} + h02 * {c['02']})"
            moves = [" + ".join(f"{c[''.join(sorted((str(i), str(j))))]} * g{j}" for j in range(3)) for i in range(3)]
        made.append(f"{name}_{step + 1} AS (SELECT " + ", ".join(f"b{i} - ({m}) / {det} AS b{i}" for i, m in enumerate(moves)) + f" FROM {name}_s{step})")
    made.append(f"{name}_fit AS (SELECT * FROM {name}_{STEPS})")
    made.append(f"{name}_scored AS (SELECT facts.*, 1 / (1 + exp(-({margin}))) AS score FROM facts, {name}_fit)")
    return ",\n    ".join(made)


@query(f"""
    WITH {FACTS}, {newton_sql("plain", PAIR)}, {newton_sql("even", PAIR, "n_all / (2.0 * n)")}
    SELECT p.id, p.target, round(p.score, 6) AS score, round(e.score, 6) AS balanced_score FROM plain_scored p JOIN even_scored e USING (id)""")
def logistic_fits(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression with the intercept penalised, plain and with balanced classes, on two features."""
    facts = _two_facts(spark, sf)
    train = facts.where("is_train")
    scored = clf.score_rows(clf.logistic()(train, PAIR), facts)
    even = clf.score_rows(clf.logistic(balanced=True)(train, PAIR), facts, ["id"]).withColumnRenamed("score", "balanced_score")
    return rounded(scored.join(even, "id"))


@query(f"""
    WITH {FACTS}, {newton_sql("fit", PAIR)}
    SELECT id, target, title, round(score, 6) AS pred_ranks, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fit_scored""")
def predicted_order(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates with the model's probability and their place."""
    facts = _two_facts(spark, sf)
    ranked = clf.predict_ranks(clf.logistic()(facts.where("is_train"), PAIR), facts)
    placed = rank_candidates(ranked.withColumnRenamed("pred_ranks", "score"))
    return placed.select("id", "target", "title", F.round("score", 6).alias("pred_ranks"), "rank")


@query(f"""
    WITH {FACTS}, {newton_sql("fit", PAIR)}
    SELECT is_train, id, row_number() OVER (PARTITION BY is_train ORDER BY score DESC, id) AS rank,
           sum(CAST(target AS BIGINT)) OVER (PARTITION BY is_train ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS hits
    FROM fit_scored""")
def order_of_both_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The held-out fifth and the training part, each ranked for itself, with the targets found so far."""
    facts = _two_facts(spark, sf)
    scored = clf.score_rows(clf.logistic()(facts.where("is_train"), PAIR), facts, ["id", "target", "is_train"])
    return rank_candidates(scored, ["is_train"]).select("is_train", "id", "rank", "hits")


@query(f"""
    WITH {FACTS}, {newton_sql("rank", ["ln_ef"])}, {newton_sql("far", ["avg_distance"])}, {newton_sql("both", PAIR)},
    scored AS (SELECT 'rank' AS feature_set, id, target, score FROM rank_scored UNION ALL SELECT 'distance', id, target, score FROM far_scored
               UNION ALL SELECT 'both', id, target, score FROM both_scored),
    placed AS (SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY score DESC, id) AS rank FROM scored)
    SELECT feature_set, (SELECT count(*) FROM {{target_ids}}) AS num_target_papers,
           count(*) FILTER (target AND rank <= (SELECT count(*) FROM {{target_ids}})) AS num_correctly_predicted,
           round(count(*) FILTER (target AND rank <= (SELECT count(*) FROM {{target_ids}})) / (SELECT count(*) FROM {{target_ids}}), 6) AS r_precision
    FROM placed GROUP BY feature_set""")
def measured_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """R-precision with the rank alone, the distance alone, and both."""
    facts = _two_facts(spark, sf)
    sets = {"rank": ["ln_ef"], "distance": ["avg_distance"], "both": PAIR}
    found = clf.compare_feature_sets(facts.where("is_train"), facts, sets, target_ids(spark, sf).count(), clf.logistic())
    counts = [F.col(c).cast("long").alias(c) for c in ("num_target_papers", "num_correctly_predicted")]
    return found.select("feature_set", *counts, F.round("r_precision", 6).alias("r_precision"))


@query("""SELECT unnest(['l2', 'l2', 'l2', 'balanced', 'balanced', 'balanced', 'l1', 'l1', 'l1']) AS fit,
                 unnest([0, 1, 2, 0, 1, 2, 0, 1, 2])::INT AS place, 0.0::DOUBLE AS slack""")
def logistic_minima(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions of a minimum, summed up anew from the training rows: 0 for every coefficient of every fit."""
    train = materialize(_two_facts(spark, sf).where("is_train"), "train")
    fits = {"l2": clf.logistic(), "balanced": clf.logistic(balanced=True), "l1": clf.logistic(penalty="l1")}
    made = None
    for name, fitter in fits.items():
        part = fitter.slack(train, fitter.fit_runs(train, PAIR), PAIR).withColumn("fit", F.lit(name))
        made = part if made is None else made.unionByName(part)
    return made.select("fit", "place", F.round("slack", 5).alias("slack"))


@query("""
    SELECT s AS split_seed, p AS place, 0.0::DOUBLE AS slack, TRUE AS same_alone
    FROM (SELECT unnest([1, 2, 3, 4, 5])::INT AS s), (SELECT unnest([0, 1, 2])::INT AS p)""")
def logistic_of_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Five splits of one list, fitted in the jobs of one: each at its own minimum, and as if fitted alone."""
    size = F.when(F.col("n_rows") < 21, 3).otherwise(20)
    by, tables = ["split_seed"], [view(spark, sf, name) for name in ("id_list", "papers", "citations")]
    sets = collect_splits(*tables, size)
    prepared = materialize(prepare_candidates(sets.candidates, sets.seeds, sets.targets, by=by), "prepared")
    split = materialize(split_train(prepared, F.col("split_seed"), by), "split")
    placed = with_features(split, sets.seeds, {"avg_distance": cluster_distance}, by).withColumn("ln_ef", F.log1p("ef"))
    train = materialize(placed.where("is_train"), "train")
    fitter = clf.logistic()
    fitted = fitter.fit_runs(train, PAIR, by)
    alone = fitter.fit_runs(train.where("split_seed = 3"), PAIR).select(F.posexplode("beta").alias("place", "alone"))
    own = fitted.select("split_seed", F.posexplode("beta").alias("place", "b")).join(alone, "place")
    close = (F.col("split_seed") != 3) | (F.abs(F.col("b") - F.col("alone")) <= 1e-6 * (1 + F.abs("b")))
    flagged = own.select("split_seed", "place", close.alias("same_alone"))
    return fitter.slack(train, fitted, PAIR, by).select("split_seed", "place", F.round("slack", 5).alias("slack")).join(flagged, ["split_seed", "place"])


def _ln_ef(candidates: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return candidates.select(*by, "id", F.log1p("ef").alias("ln_ef"))


@query(f"""
    WITH {FACTS}, {newton_sql("plain", PAIR)}, {newton_sql("even", PAIR, "n_all / (2.0 * n)")},
    scored AS (SELECT 'a' AS run_id, 'logistic' AS classifier_str, target, score FROM plain_scored
               UNION ALL SELECT 'b', 'logistic_balanced', target, score FROM even_scored),
    steps AS (SELECT run_id, classifier_str, score, count(*) AS n, sum(CAST(target AS INT)) AS pos FROM scored GROUP BY ALL),
    placed AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY run_id) AS total FROM steps
               WINDOW w AS (PARTITION BY run_id ORDER BY score DESC))
    SELECT run_id, classifier_str, round(sum(pos / total * tp / seen), 6) AS average_precision, CAST(sum(n) AS BIGINT) AS num_candidates
    FROM placed GROUP BY ALL UNION ALL SELECT 'lost', NULL, NULL, NULL""")
def remeasured_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two saved runs and one without a model, read and scored together, with their average precision."""
    sets = paper_sets(spark, sf)
    chosen = {"avg_distance": cluster_distance, "ln_ef": _ln_ef}
    rows = [("lost", "review 3", 0.9, new_path(spark, "lost"), "logistic")]
    fits = {"a": ("logistic", clf.logistic()), "b": ("logistic_balanced", clf.logistic(balanced=True))}
    for number, (run, (name, fitter)) in enumerate(fits.items(), 1):
        folder = new_path(spark, "run")
        for part, table in (("seed_papers", sets.seeds), ("target_papers", sets.targets), ("test_papers", sets.candidates)):
            save_paper_set(table, folder, part)
        train_saved(spark, folder, classifiers={name: fitter}, features=chosen)
        rows.append((run, f"review {number}", 0.5, folder, name))
    log = spark.createDataFrame(rows, "id string, review_paper_id string, score double, datadir string, clf string")
    found = evaluate_saved(spark, log, ["review_paper_id"], "score", chosen)
    count = F.col("num_candidates").cast("long").alias("num_candidates")
    return found.select("run_id", "classifier_str", F.round("average_precision", 6).alias("average_precision"), count)


@query("""SELECT o_orderkey AS id, clf, TRUE AS same FROM {orders}, (SELECT unnest(['forest', 'bayes', 'svm', 'boosted']) AS clf)
          WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem})""")
def models_as_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of trees and other parts as rows, routed and added up on their own, give the scores of the models."""
    names = FEATURES[:5]
    facts = _order_facts(spark, sf, names)
    fits = {"forest": clf.forest(10, max_depth=8), "bayes": clf.gaussian_bayes(), "svm": clf.linear_svm(), "boosted": clf.boosted(40)}
    parts = rows = None
    for name, fitter in fits.items():
        model = fitter(facts, names)
        part = parts_of(spark, model, new_path(spark, "forest")).withColumn("run_id", F.lit(name))
        run = clf.score_rows(model, facts, ["id", *names]).withColumnRenamed("score", "own").withColumn("run_id", F.lit(name))
        parts, rows = (part, run) if parts is None else (parts.unionByName(part), rows.unionByName(run))
    both = score_with_tables(rows, parts, names, keep=("id", "own"))
    return both.select("id", F.col("run_id").alias("clf"), (F.abs(F.col("score") - F.col("own")) < 1e-6).alias("same"))


FEATURES = [f"f{i}" for i in range(20)]
ROUNDS = 3

ORDER_FACTS = """
    SELECT o_orderkey AS id, o_totalprice > 150000 AS target, CAST(n_lines AS DOUBLE) AS f0, quantity AS f1, most AS f2, least AS f3,
           dear AS f4, cheap AS f5, tax_high AS f6, tax_low AS f7, CAST(part_high AS DOUBLE) AS f8, CAST(part_low AS DOUBLE) AS f9,
           CAST(supp_high AS DOUBLE) AS f10, CAST(supp_low AS DOUBLE) AS f11, CAST(returned AS DOUBLE) AS f12, CAST(accepted AS DOUBLE) AS f13,
           CAST(open_lines AS DOUBLE) AS f14, CAST(o_custkey AS DOUBLE) AS f15, CAST(c_nationkey AS DOUBLE) AS f16, c_acctbal AS f17,
           CAST(year(o_orderdate) AS DOUBLE) AS f18, CAST(month(o_orderdate) AS DOUBLE) AS f19
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN (
        SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity, max(l_quantity) AS most, min(l_quantity) AS least,
               max(l_discount) AS dear, min(l_discount) AS cheap, max(l_tax) AS tax_high, min(l_tax) AS tax_low, max(l_partkey) AS part_high,
               min(l_partkey) AS part_low, max(l_suppkey) AS supp_high, min(l_suppkey) AS supp_low,
               sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS accepted,
               sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines
        FROM {lineitem} GROUP BY l_orderkey) AS lines ON o_orderkey = l_orderkey"""


def rounds_sql() -> str:
    """Tables of ROUNDS rounds of boosting on ``order_facts``; ``best_r`` is the stump of round r."""
    made = [
        "rows_ AS (SELECT id, CASE WHEN target THEN 1.0::DOUBLE ELSE 0.0 END AS y, 1.0::DOUBLE / count(*) OVER () AS w FROM order_facts)",
        f"listed AS (SELECT id, unnest(range(20)) AS feature, unnest([{', '.join(FEATURES)}]) AS x FROM order_facts)",
        "counted AS (SELECT feature, x, count(*) AS n FROM listed GROUP BY ALL)",
        "seen AS (SELECT *, sum(n) OVER o AS upto, sum(n) OVER (PARTITION BY feature) AS total, row_number() OVER o AS place,"
        " count(*) OVER (PARTITION BY feature) AS different FROM counted WINDOW o AS (PARTITION BY feature ORDER BY x))",
        "edges AS (SELECT feature, x AS edge FROM seen WHERE place < different AND (different <= 64 OR (64 * upto) // total > (64 * (upto - n)) // total))",
        "bins AS (SELECT c.feature, c.x, count(e.edge) AS bin FROM counted c LEFT JOIN edges e ON e.feature = c.feature AND e.edge < c.x GROUP BY ALL)",
        "numbered AS (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS bin FROM edges)",
        "cells AS (SELECT id, l.feature, bin FROM listed l JOIN bins b ON l.feature = b.feature AND l.x = b.x)",
        "weights_0 AS (SELECT * FROM rows_)",
    ]
    value = lambda p, q: f"0.5 * ln(least(greatest({p} / ({p} + {q}), 2.220446049250313e-16), 1 - 2.220446049250313e-16) / (1 - least(greatest({p} / ({p} + {q}), 2.220446049250313e-16), 1 - 2.220446049250313e-16)))"
    for r in range(1, ROUNDS + 1):
        made += [
            f"sums_{r} AS (SELECT feature, bin, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM weights_{r - 1} JOIN cells USING (id) GROUP BY ALL)",
            f"sides_{r} AS (SELECT feature, bin, sum(pos) OVER l AS p1, sum(neg) OVER l AS n1, sum(pos) OVER h AS p2, sum(neg) OVER h AS n2 FROM sums_{r}"
            " WINDOW l AS (PARTITION BY feature ORDER BY bin), h AS (PARTITION BY feature ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
            f"best_{r} AS (SELECT {r} AS round, s.feature, edge, s.bin, {value('p1', 'n1')} AS low, {value('p2', 'n2')} AS high FROM sides_{r} s"
            " JOIN numbered USING (feature, bin) ORDER BY round(p1 * n1 / (p1 + n1) + p2 * n2 / (p2 + n2), 12), s.feature, s.bin LIMIT 1)",
            f"weights_{r} AS (SELECT w.id, y, w * exp(-(2 * y - 1) * CASE WHEN c.bin <= b.bin THEN low ELSE high END) AS w"
            f" FROM weights_{r - 1} w JOIN best_{r} b ON TRUE JOIN cells c ON c.id = w.id AND c.feature = b.feature)",
        ]
    return ",\n    ".join(made)


def _order_facts(spark: SparkSession, sf: str, features: Sequence[str]) -> DataFrame:
    """Every order with its class and the features that are asked for; the others are not summed up."""
    tables = {name: view(spark, sf, name) for name in ("orders", "customer", "lineitem")}
    facts = spark.sql(ORDER_FACTS, **tables).withColumn("label", F.col("target").cast("double"))
    return materialize(facts.select("id", "target", "label", *features), "facts")


@query(f"""
    WITH order_facts AS ({ORDER_FACTS}), {rounds_sql()}
    SELECT round::INT AS round, 'f' || feature AS feature, edge, round(low, 6) AS low, round(high, 6) AS high
    FROM ({" UNION ALL ".join(f"SELECT * FROM best_{r}" for r in range(1, ROUNDS + 1))})""")
def first_boosting_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The first stumps over twenty features, with their thresholds and leaf values."""
    facts = _order_facts(spark, sf, FEATURES)
    edges = bin_edges(facts, FEATURES)
    listed = spark.createDataFrame([(i, f"f{i}", b, e) for i in range(20) for b, e in enumerate(edges[f"f{i}"])], "feature int, name string, bin int, edge double")
    stumps = boost(facts, FEATURES, edges, ROUNDS)
    return stumps.join(listed, ["feature", "bin"]).select("round", F.col("name").alias("feature"), "edge", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT o_orderkey AS id, o_totalprice > 150000 AS target, TRUE AS is_probability FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem})")
def boosted_many_features(spark: SparkSession, sf: str) -> DataFrame:
    """Five hundred rounds over twenty features."""
    facts = _order_facts(spark, sf, FEATURES)
    scored = clf.score_rows(clf.boosted()(facts, FEATURES), facts)
    return scored.select("id", "target", F.col("score").between(0, 1).alias("is_probability"))
