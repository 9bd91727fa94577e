"""Features of candidates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import paper_sets, prefix_sql, query, rounded, seed_ids, tokens_sql, union_all, view
from seedscape.functions import paths
from seedscape.functions.text import contains_word, terms, text_from_json, text_from_positions
from seedscape.operators import clusters, features, similarity
from seedscape.operators.graph import attach_papers
from seedscape.operators.matching import meta_clusters
from seedscape.operators.prep import drop_unclustered
from seedscape.operators.summary import describe_counts

PAIRS = """(SELECT a.cl AS a_cl, b.cl AS b_cl, string_split(a.cl, ':') AS a, string_split(b.cl, ':') AS b
    FROM {known_papers} a JOIN {citations} e ON a.id = e.id JOIN {known_papers} b ON b.id = e.cited_id)"""


def _edge_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Both cluster paths of every citation."""
    known = drop_unclustered(view(spark, sf, "papers"))
    ends = [known.select(F.col("id").alias(key), F.col("cl").alias(name)) for key, name in (("id", "a_cl"), ("cited_id", "b_cl"))]
    return view(spark, sf, "citations").join(ends[0], "id").join(ends[1], "cited_id").select("a_cl", "b_cl")


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the parts of one order next to each other, so that they do share levels."""
    line = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    cl = view(spark, sf, "part_papers").select(F.substring("id", 2, 20).cast("long").alias("l_partkey"), "cl")
    placed = line.join(cl, "l_partkey").select("l_orderkey", "l_linenumber", "cl")
    following = placed.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("cl").alias("b_cl"))
    return placed.withColumnRenamed("cl", "a_cl").join(following, ["l_orderkey", "l_linenumber"]).select("a_cl", "b_cl")


CHAIN = """(SELECT x.cl AS a_cl, y.cl AS b_cl, string_split(x.cl, ':') AS a, string_split(y.cl, ':') AS b
    FROM (SELECT l_orderkey, l_linenumber, cl FROM {lineitem} JOIN {part_papers} ON id = 'p' || CAST(l_partkey AS STRING)) x
    JOIN (SELECT l_orderkey, l_linenumber, cl FROM {lineitem} JOIN {part_papers} ON id = 'p' || CAST(l_partkey AS STRING)) y
    ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber - 1)"""
LCA = prefix_sql("a", "b")


@query(f"""SELECT a_cl, b_cl, round(((len(a) + len(b)) / 2 - {LCA}) / ((len(a) + len(b)) / 2), 6) AS distance, count(*) AS n
           FROM {CHAIN} GROUP BY ALL""")
def tree_distance(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _chain(spark, sf).groupBy("a_cl", "b_cl").agg(F.count("*").alias("n"))
    return rounded(pairs.withColumn("distance", paths.tree_distance(F.col("a_cl"), F.col("b_cl"))))


@query(f"SELECT CAST(len(a) + len(b) - 2 * {LCA} AS INT) AS distance, count(*) AS n FROM {CHAIN} GROUP BY 1")
def path_length(spark: SparkSession, sf: str) -> DataFrame:
    length = paths.path_length(F.col("a_cl"), F.col("b_cl"))
    return _chain(spark, sf).groupBy(length.alias("distance")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST({LCA} AS INT) AS levels, count(*) AS n FROM {PAIRS} GROUP BY 1")
def shared_levels_of_citations(spark: SparkSession, sf: str) -> DataFrame:
    shared = paths.shared_depth(F.col("a_cl"), F.col("b_cl"))
    return _edge_paths(spark, sf).groupBy(shared.alias("levels")).agg(F.count("*").alias("n"))


@query("SELECT c.id, round(avg_distance, 6) AS avg_distance FROM {candidates} c JOIN {distances} d ON c.cl = d.cl")
def average_cluster_distance(spark: SparkSession, sf: str) -> DataFrame:
    sets = paper_sets(spark, sf)
    return rounded(clusters.average_distance(sets.candidates, sets.seeds).select("id", "avg_distance"))


BETWEEN = f"""(SELECT CAST(len(a) + len(b) - 2 * {LCA} AS INT) AS distance, n
    FROM (SELECT string_split(x.cl, ':') AS a, string_split(y.cl, ':') AS b, x.n * y.n AS n
          FROM (SELECT cl, count(*) AS n FROM {{part_papers}} GROUP BY cl) x,
               (SELECT cl, count(*) AS n FROM {{tree_papers}} GROUP BY cl
                UNION ALL SELECT cl, count(*) FROM {{part_papers}} GROUP BY cl) y WHERE x.cl <> y.cl))"""


def _two_groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = view(spark, sf, "part_papers").select("id", "cl")
    return parts, view(spark, sf, "tree_papers").unionByName(parts)


@query(f"SELECT distance, CAST(sum(n) AS BIGINT) AS n_pairs FROM {BETWEEN} GROUP BY distance")
def distances_between_groups(spark: SparkSession, sf: str) -> DataFrame:
    pairs = clusters.distances_between(*_two_groups(spark, sf))
    return pairs.select("distance", F.col("n_pairs").cast("long").alias("n_pairs"))


@query(f"""SELECT CAST(len(a) + len(b) - 2 * {LCA} AS INT) AS distance, CAST(sum(n) AS BIGINT) AS n_pairs
           FROM (SELECT string_split(x.cl, ':') AS a, string_split(y.cl, ':') AS b,
                        CASE WHEN x.cl = y.cl THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS n
                 FROM (SELECT cl, count(*) AS n FROM {{part_papers}} GROUP BY cl) x,
                      (SELECT cl, count(*) AS n FROM {{part_papers}} GROUP BY cl) y WHERE x.cl <= y.cl)
           GROUP BY distance HAVING sum(n) > 0""")
def distances_within_group(spark: SparkSession, sf: str) -> DataFrame:
    pairs = clusters.distances_within(view(spark, sf, "part_papers"))
    return pairs.select("distance", F.col("n_pairs").cast("long").alias("n_pairs"))


@query(f"""
    WITH counted AS (SELECT distance, sum(n) AS n FROM {BETWEEN} GROUP BY distance),
    seen AS (SELECT *, sum(n) OVER (ORDER BY distance) AS upto, sum(n) OVER () AS total FROM counted),
    stats AS (SELECT sum(n) AS total, sum(n * distance) / sum(n) AS mean FROM counted)
    SELECT CAST(max(s.total) AS BIGINT) AS n, round(max(mean), 6) AS mean,
           round(sqrt(sum(n * (distance - mean) * (distance - mean)) / (max(s.total) - 1)), 6) AS std,
           CAST(min(distance) AS DOUBLE) AS min, CAST(max(distance) AS DOUBLE) AS max,
           CAST(min(distance) FILTER (upto > floor((s.total - 1) * 0.25)) AS DOUBLE) AS q25,
           CAST(min(distance) FILTER (upto > floor((s.total - 1) * 0.5)) AS DOUBLE) AS median,
           CAST(min(distance) FILTER (upto > floor((s.total - 1) * 0.75)) AS DOUBLE) AS q75
    FROM seen s, stats""")
def described_distances(spark: SparkSession, sf: str) -> DataFrame:
    pairs = clusters.distances_between(*_two_groups(spark, sf))
    counts = pairs.select(F.col("distance").cast("double").alias("value"), F.col("n_pairs").cast("long").alias("n"))
    return rounded(describe_counts(counts))


@query("SELECT id, round(ef, 6) AS ef FROM {papers}")
def column_feature(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.column_feature(view(spark, sf, "papers"), "ef"))


@query("SELECT id, term, tf FROM {text_tf} WHERE NOT is_seed")
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.term_counts(view(spark, sf, "text_candidates"), ["id"], "text")


@query("SELECT doc_id AS id, len(" + tokens_sql() + ") AS n_terms, md5(array_to_string(" + tokens_sql() + ", ' ')) AS digest FROM {documents}")
def terms_in_order(spark: SparkSession, sf: str) -> DataFrame:
    found = view(spark, sf, "texts").withColumn("terms", terms(F.col("text")))
    return found.select("id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("digest"))


@query("SELECT id, is_seed, term, round(w, 6) AS weight FROM {text_weights}")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    texts = similarity.candidates_and_seeds(view(spark, sf, "text_candidates"), view(spark, sf, "text_seeds"), text_col="text")
    return rounded(similarity.tfidf(texts, text_col="text", keys=["id", "is_seed"]))


@query("SELECT id, round(similarity, 6) AS similarity FROM {text_similarity}")
def text_similarity_to_seeds(spark: SparkSession, sf: str) -> DataFrame:
    scored = similarity.title_similarity(
        view(spark, sf, "text_candidates"), view(spark, sf, "text_seeds"), text_col="text", out_col="similarity"
    )
    return rounded(scored.select("id", "similarity"))


@query("SELECT id, round(abs(ef - (SELECT avg(ef) FROM {seeds})), 6) AS ef_distance FROM {papers}")
def distance_to_seed_mean(spark: SparkSession, sf: str) -> DataFrame:
    papers = view(spark, sf, "papers")
    seeds = attach_papers(seed_ids(spark, sf), papers)
    return rounded(features.distance_to_seed_mean(papers, seeds, "ef").select("id", "ef_distance"))


@query("""
    WITH parts AS (SELECT v.id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {vectors} v),
    mean AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM parts WHERE id IN (SELECT id FROM {vector_seeds}) GROUP BY i)
    SELECT id, round(sum(x * m) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(m * m))), 6) AS embedding_similarity
    FROM parts JOIN mean ON parts.i = mean.i GROUP BY id""")
def embedding_similarity_to_seeds(spark: SparkSession, sf: str) -> DataFrame:
    vectors = view(spark, sf, "vectors")
    return rounded(similarity.embedding_similarity(vectors.select("id"), view(spark, sf, "vector_seeds"), vectors))


@query("""
    WITH placed AS (SELECT t.id, CASE WHEN meta_cl IS NULL THEN NULL ELSE string_split(meta_cl, ':') END AS a, t.id IN (SELECT id FROM {seed_ids}) AS is_seed
                    FROM {tree_papers} t LEFT JOIN {meta} ON toplevel_in_tree = CAST(split_part(cl, ':', 1) AS INT)),
    near AS (SELECT a AS b FROM placed WHERE is_seed AND a IS NOT NULL)
    SELECT id, round(avg(((len(a) + len(b)) / 2 - """ + LCA + """) / ((len(a) + len(b)) / 2)), 6) AS meta_distance
    FROM placed LEFT JOIN near ON a IS NOT NULL GROUP BY id""")
def meta_cluster_distance(spark: SparkSession, sf: str) -> DataFrame:
    placed = meta_clusters(view(spark, sf, "tree_papers"), view(spark, sf, "meta"))
    seeds = attach_papers(seed_ids(spark, sf), placed)
    scored = clusters.average_distance(placed, seeds, path_col="cl_meta", out_col="meta_distance")
    return rounded(scored.select("id", "meta_distance"))


@query("""
    WITH tf AS (SELECT id, term, tf FROM {text_tf} WHERE NOT is_seed),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {text_candidates})) / (1.0 + count(*))) + 1.0 AS idf
            FROM tf GROUP BY term HAVING count(*) >= 10)
    SELECT id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)), 6) AS weight
    FROM tf JOIN idf USING (term)""")
def bag_of_words_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(similarity.tfidf(view(spark, sf, "text_candidates"), text_col="text", min_df=10))


@query("""SELECT c.id, round(avg_distance, 6) AS avg_distance, round(ef, 6) AS ef,
                 round(abs(ef - (SELECT avg(ef) FROM {seeds})), 6) AS ef_distance
          FROM {candidates} c JOIN {distances} d ON c.cl = d.cl""")
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    sets = paper_sets(spark, sf)
    seeds, reached = sets.seeds, sets.candidates
    tables = [
        clusters.average_distance(reached, seeds).select("id", "avg_distance"),
        features.column_feature(reached, "ef"),
        features.distance_to_seed_mean(reached, seeds, "ef").select("id", "ef_distance"),
    ]
    return rounded(features.feature_union(reached.select("id"), tables))


@query("SELECT doc_id AS id, md5(array_to_string(" + tokens_sql() + ", ' ')) AS digest FROM {documents} WHERE len(" + tokens_sql() + ") > 0")
def rebuilt_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Word positions of every text, and the text put together from them again."""
    index = similarity.positions(view(spark, sf, "texts"))
    return index.select("id", F.md5(F.array_join(text_from_positions(F.col("index")), " ")).alias("digest"))


@query("SELECT doc_id AS id, md5(array_to_string(" + tokens_sql() + ", ' ')) AS digest FROM {documents} WHERE len(" + tokens_sql() + ") > 0")
def texts_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same with each index stored as a JSON record."""
    index = similarity.positions(view(spark, sf, "texts"), out_col="InvertedIndex")
    record = F.to_json(F.struct(F.size("InvertedIndex").alias("IndexLength"), "InvertedIndex"))
    return index.select("id", F.md5(F.array_join(text_from_json(record), " ")).alias("digest"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
          FROM {events} GROUP BY event_type""")
def event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """A value inside JSON strings, per type of event."""
    read = view(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT id, is_seed FROM {all_texts}")
def texts_with_seeds_appended(spark: SparkSession, sf: str) -> DataFrame:
    both = similarity.candidates_and_seeds(view(spark, sf, "text_candidates"), view(spark, sf, "text_seeds"), text_col="text")
    return both.select("id", "is_seed")


@query("""SELECT source, CAST(count(*) FILTER (contains(lower(text), 'the')) AS BIGINT) AS with_the,
                 CAST(count(*) FILTER (contains(lower(text), 'les')) AS BIGINT) AS with_les FROM {documents} GROUP BY source""")
def texts_with_words(spark: SparkSession, sf: str) -> DataFrame:
    documents = view(spark, sf, "documents")
    return documents.groupBy("source").agg(
        F.count_if(contains_word(F.col("text"), "the")).alias("with_the"),
        F.count_if(contains_word(F.col("text"), "les")).alias("with_les"),
    )


@query("""
    WITH runs AS (SELECT CAST(p_size % 3 AS INT) AS run_id, 'p' || CAST(p_partkey AS STRING) AS id FROM {part}),
    near AS (SELECT run_id, string_split(cl, ':') AS b FROM runs JOIN {part_papers} USING (id)),
    far AS (SELECT DISTINCT run_id, cl, string_split(cl, ':') AS a FROM {part_papers}, (SELECT DISTINCT run_id FROM runs)),
    scored AS (SELECT run_id, cl, avg(((len(a) + len(b)) / 2 - """ + LCA + """) / ((len(a) + len(b)) / 2)) AS d
               FROM far JOIN near USING (run_id) GROUP BY ALL)
    SELECT run_id, id, round(d, 6) AS avg_distance FROM {part_papers} JOIN scored USING (cl)""")
def average_distance_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every paper against the seeds of several runs, all runs in one job."""
    papers = view(spark, sf, "part_papers").select("id", "cl")
    runs = [0, 1, 2]
    part = view(spark, sf, "part").select(
        (F.col("p_size") % 3).cast("int").alias("run_id"), F.concat(F.lit("p"), "p_partkey").alias("id")
    )
    everyone = union_all([papers.withColumn("run_id", F.lit(r)) for r in runs])
    scored = clusters.average_distance(everyone, part.join(papers, "id"), ["run_id"])
    return rounded(scored.select("run_id", "id", "avg_distance"))
