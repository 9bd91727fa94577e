"""Citation graph."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import paper_sets, query, rounded, seed_ids, view
from seedscape.operators import graph
from seedscape.operators.clusters import average_distance
from seedscape.operators.prep import drop_unclustered, flag_targets, remove_seeds
from seedscape.operators.summary import top_sorted
from seedscape.plans.review import collect_lists, collect_splits
from seedscape.scratch import new_path


@query("SELECT c.id, cited_id FROM {citations} c JOIN {ring1} r ON c.id = r.id")
def out_citations(spark: SparkSession, sf: str) -> DataFrame:
    edges = view(spark, sf, "citations")
    return graph.out_citations(edges, graph.follow_citations(seed_ids(spark, sf), edges))


@query("SELECT c.id, cited_id FROM {citations} c JOIN {seed_ids} s ON c.cited_id = s.id")
def in_citations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_citations(view(spark, sf, "citations"), seed_ids(spark, sf))


@query("SELECT id FROM {citations} UNION SELECT cited_id FROM {citations}")
def combined_ids(spark: SparkSession, sf: str) -> DataFrame:
    return graph.combine_ids([view(spark, sf, "citations")])


@query("SELECT id FROM {ring1}")
def follow_citations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.follow_citations(seed_ids(spark, sf), view(spark, sf, "citations"))


@query("SELECT id FROM {ring2}")
def two_degrees_out(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand(seed_ids(spark, sf), view(spark, sf, "citations"), 2)


@query("""
    WITH start AS (SELECT CAST(p_size % 5 AS INT) AS run_id, 'p' || CAST(p_partkey AS STRING) AS id FROM {part}),
    one AS (SELECT DISTINCT run_id, unnest([c.id, cited_id]) AS id FROM {citations} c JOIN start s ON c.id = s.id OR c.cited_id = s.id)
    SELECT run_id, id FROM one""")
def many_runs_one_degree_out(spark: SparkSession, sf: str) -> DataFrame:
    """Several seed sets followed in one job, kept apart by their run."""
    start = view(spark, sf, "part").select(
        (F.col("p_size") % 5).cast("int").alias("run_id"), F.concat(F.lit("p"), "p_partkey").alias("id")
    )
    return graph.expand(start, view(spark, sf, "citations"), 1, ["run_id"])


@query("SELECT id, title, year, round(ef, 6) AS ef, cl FROM {candidates}")
def candidate_papers(spark: SparkSession, sf: str) -> DataFrame:
    reached = graph.expand(seed_ids(spark, sf), view(spark, sf, "citations"))
    papers = graph.attach_papers(reached, drop_unclustered(view(spark, sf, "papers")))
    return rounded(papers.select("id", "title", "year", "ef", "cl"))


@query("SELECT cited_id AS id FROM {citations} WHERE id = 'o42'")
def references_of_paper(spark: SparkSession, sf: str) -> DataFrame:
    return graph.references_of(view(spark, sf, "citations"), "o42")


@query("SELECT DISTINCT id AS review_id, cited_id AS id FROM {citations} WHERE id IN (SELECT id FROM {papers})")
def lists_of_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The references of every paper, as the lists that a collection starts from."""
    return graph.lists_of_reviews(view(spark, sf, "citations"), view(spark, sf, "papers"))


@query("SELECT id FROM {citations} WHERE cited_id = 'p42'")
def citing_papers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.references_of(view(spark, sf, "citations"), "p42", "in")


@query("""
    WITH ways AS (SELECT id AS near, cited_id AS far FROM {citations} UNION ALL SELECT cited_id, id FROM {citations}),
    first AS (SELECT far FROM ways WHERE near IN (SELECT id FROM {seed_ids})),
    second AS (SELECT far FROM ways WHERE near IN (SELECT far FROM first))
    SELECT far AS id, count(*) AS n_reached FROM (SELECT * FROM first UNION ALL SELECT * FROM second) GROUP BY far""")
def neighbour_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbour_counts(seed_ids(spark, sf), view(spark, sf, "citations"))


@query("SELECT id FROM {candidates} INTERSECT SELECT id FROM {target_ids}")
def targets_in_candidates(spark: SparkSession, sf: str) -> DataFrame:
    sets = paper_sets(spark, sf)
    return sets.candidates.select("id").intersect(sets.targets.select("id"))


@query("SELECT doc_id AS id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
def ids_not_done_yet(spark: SparkSession, sf: str) -> DataFrame:
    done = view(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return view(spark, sf, "texts").select("id").join(done, "id", "left_anti")


@query("""SELECT c.id, title, year, round(ef, 6) AS ef, c.id IN (SELECT id FROM {target_ids}) AS target,
                 round(avg_distance, 6) AS avg_distance
          FROM {candidates} c JOIN {distances} d ON c.cl = d.cl WHERE c.id NOT IN (SELECT id FROM {seed_ids})""")
def related_papers(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way without a model: two degrees out, cluster distance to the seeds, target flag."""
    sets = paper_sets(spark, sf)
    placed = average_distance(remove_seeds(sets.candidates, sets.seeds), sets.seeds)
    flagged = flag_targets(placed, sets.targets)
    return rounded(flagged.select("id", "title", "year", "ef", "target", "avg_distance"))


@query("""SELECT id, avg_distance, ef FROM (
            SELECT c.id, round(avg_distance, 6) AS avg_distance, round(ef, 6) AS ef FROM {candidates} c JOIN {distances} d ON c.cl = d.cl)
          ORDER BY avg_distance, ef DESC, id LIMIT 50""")
def nearest_papers(spark: SparkSession, sf: str) -> DataFrame:
    sets = paper_sets(spark, sf)
    placed = average_distance(sets.candidates, sets.seeds)
    table = rounded(placed.select("id", "avg_distance", "ef"))
    return top_sorted(table, [F.col("avg_distance"), F.col("ef").desc(), F.col("id")], 50)


@query("""
    WITH lists AS (SELECT s AS split_seed, id, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(s AS STRING) || ':' || id), id)
                          <= CASE WHEN count(*) OVER (PARTITION BY s) < 21 THEN 3 ELSE 20 END AS is_seed
                   FROM {id_list}, unnest([1, 2, 3, 4, 5]) AS seeds(s)),
    one AS (SELECT DISTINCT split_seed, unnest([c.id, cited_id]) AS id FROM lists l JOIN {citations} c
            ON l.id = c.cited_id OR l.id = c.id WHERE is_seed),
    two AS (SELECT split_seed, unnest([c.id, cited_id]) AS id FROM one JOIN {citations} c ON one.id = c.id
            UNION SELECT split_seed, unnest([c.id, cited_id]) FROM one JOIN {citations} c ON one.id = c.cited_id)
    SELECT split_seed, two.id, cl FROM two JOIN {known_papers} p ON two.id = p.id""")
def candidates_of_all_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Five random splits of one list, all expanded in the same jobs."""
    size = F.when(F.col("n_rows") < 21, 3).otherwise(20)
    tables = [view(spark, sf, name) for name in ("id_list", "papers", "citations")]
    return collect_splits(*tables, sample_size=size).candidates.select("split_seed", "id", "cl")


@query("""
    WITH lists AS (SELECT p_brand AS review_id, s AS split_seed, 'p' || CAST(p_partkey AS STRING) AS id,
                          row_number() OVER (PARTITION BY p_brand, s ORDER BY md5(CAST(s AS STRING) || ':p' || CAST(p_partkey AS STRING))) <= 3 AS is_seed
                   FROM {part}, unnest([1, 2, 3, 4, 5]) AS seeds(s)),
    one AS (SELECT DISTINCT review_id, split_seed, unnest([c.id, cited_id]) AS id FROM lists l JOIN {citations} c ON l.id = c.cited_id WHERE is_seed),
    two AS (SELECT review_id, split_seed, unnest([c.id, cited_id]) AS id FROM one JOIN {citations} c ON one.id = c.id
            UNION SELECT review_id, split_seed, unnest([c.id, cited_id]) FROM one JOIN {citations} c ON one.id = c.cited_id),
    sets AS (SELECT review_id, split_seed, CASE WHEN is_seed THEN 'seed' ELSE 'target' END AS paper_set, id FROM lists
             UNION ALL SELECT review_id, split_seed, 'candidate', id FROM two)
    SELECT review_id, CAST(split_seed AS INT) AS split_seed, paper_set, count(*) AS n FROM sets JOIN {known_papers} USING (id) GROUP BY ALL""")
def collected_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Five splits of each of many ID lists, collected together and stored by run."""
    lists = view(spark, sf, "part").select(F.col("p_brand").alias("review_id"), F.concat(F.lit("p"), "p_partkey").alias("id"))
    folder = new_path(spark, "lists")
    collect_lists(lists, view(spark, sf, "papers"), view(spark, sf, "citations"), 3, folder)
    stored = spark.read.parquet(f"{folder}/papers.parquet")
    return stored.groupBy("review_id", "split_seed", "paper_set").agg(F.count("*").alias("n"))
