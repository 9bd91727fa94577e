"""The training-data operators as queries over the test tables, and the statements that check them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedscape.llm import (
    alignment,
    bpe,
    chat,
    decontaminate,
    merkle,
    mixing,
    pii,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    topk,
)
from seedscape.llm.common import read_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), n_shards=8)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, distance=4)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, "vec_id", "vector", k=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limits(token_counts.length_histogram(read_table(spark, sf_dir, "documents"), RANKS, PATTERN))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, RANKS, PATTERN).drop("text"), RANKS)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.pairs_by_last_reply(read_table(spark, sf_dir, "conversations"))
    spans = lambda side: F.array_join(F.transform(f"{side}_trained", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return chat.format_preferences(pairs.withColumn("closing", chat.rendered(F.col("closing")))).select(
        "conv_id",
        "closing",
        "prompt_turns",
        "prompt",
        "chosen",
        "rejected",
        spans("chosen").alias("chosen_trained"),
        spans("rejected").alias("rejected_trained"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "content_score", "metadata_score", "quality", "keep")


#: A fixed key, so that runs can be compared. Whoever uses the operator brings a secret one.
PSEUDONYM_KEY = b"example key of the test queries"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymize(docs, PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join("pii.kind", ",").alias("kinds"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_windows(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, length=100)
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.assign(read_table(spark, sf_dir, "documents"), mixing.word_count("text"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    replaced = {"text": F.when(tampered, lower).otherwise(F.col("text"))}
    made = merkle.manifest(read_table(spark, sf_dir, "documents"), columns, "lang", "doc_id", replaced, keep=["doc_id"])
    return made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest("proof").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, BYTE_BPE, PIECES, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_simhash_near_dedup,
        op3_top_k_search,
        op4_token_counts,
        op5_bpe,
        op6_chat_formatting,
        op7_quality_classifier,
        op8_pii,
        op9_decontamination,
        op10_suffix_dedup,
        op11_source_mixing,
        op12_merkle_manifest,
        op13_tokenizer_alignment,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RUN = "array_to_string(words[i : i + least(13, len(words)) - 1], ' ')"



def _tree(leaves: str, key: str, levels: int) -> str:
    """Common tables that fold ``leaves`` (key, p, h) level by level; ``{leaves}_up`` has each leaf's tops and siblings."""
    made = []
    for i in range(levels):
        below = leaves if i == 0 else f"{leaves}_{i}"
        made.append(
            f"{leaves}_{i + 1} AS (SELECT {key}, p // 8 AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h,"
            f" CAST(ceil(any_value(n) / 8.0) AS BIGINT) AS n FROM {below} GROUP BY {key}, p // 8)"
        )
    siblings = [
        f"(SELECT string_agg(s.h, '' ORDER BY s.p) FROM {leaves if i == 0 else f'{leaves}_{i}'} s"
        f" WHERE s.{key} = x.{key} AND s.p // 8 = x.p // {8 ** (i + 1)} AND s.p <> x.p // {8**i})"
        for i in range(levels)
    ]
    made.append(f"{leaves}_up AS (SELECT x.*, concat({', '.join(siblings)}) AS siblings FROM {leaves} x)")
    return ",\n        ".join(made)


def _folds(levels: int) -> str:
    """Common tables that hash tampered leaves up: ``fold_{levels}`` has the subroot that each of them gives."""
    made = []
    for i in range(levels):
        nodes = "leaves" if i == 0 else f"leaves_{i}"
        made.append(
            f"fold_{i + 1} AS (SELECT f.doc_id, f.tree, f.p // 8 AS p, CASE WHEN any_value(s.n) > 1 THEN"
            f" sha256(string_agg(CASE WHEN s.p = f.p THEN f.h ELSE s.h END, '' ORDER BY s.p)) ELSE any_value(f.h) END AS h"
            f" FROM fold_{i} f JOIN {nodes} s ON s.tree = f.tree AND s.p // 8 = f.p // 8 GROUP BY f.doc_id, f.tree, f.p)"
        )
    return ",\n        ".join(made)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", {0}))"
#: CRC-32 of a decimal number: each digit's byte, then eight steps of one bit, marked by -1.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]"
    " FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b)"
    " WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"
)

ORACLES = {
    "op11_source_mixing": """
        WITH docs AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('11:' || doc_id) AS key FROM documents
        ), sizes AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM docs GROUP BY source
        ), levels AS (
            SELECT *, sum(2 * source_size) OVER o AS filled, sum(weight) OVER () - sum(weight) OVER o AS open,
                   (2 * source_size) / weight AS level, sum(source_size) OVER () * 1.5::DOUBLE AS budget
            FROM sizes WINDOW o AS (ORDER BY (2 * source_size) / weight, source NULLS FIRST)
        ), marked AS (SELECT *, filled + level * open <= budget AS is_full FROM levels),
        targets AS (
            SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (
                (SELECT any_value(budget) - coalesce(sum(2 * source_size) FILTER (is_full), 0) FROM marked)
                / (SELECT sum(weight) FILTER (NOT is_full) FROM marked)) END AS target,
                (SELECT CAST(sum(source_size) AS BIGINT) FROM sizes) AS total
            FROM marked
        ), placed AS (
            SELECT d.*, t.source_size, t.target, t.total, size * 4096 > source_size AS long,
                   CAST(sum(size) OVER (w ORDER BY key) * 2 - size AS BIGINT) AS middle, CAST(sum(size) OVER w AS BIGINT) AS words
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
            WINDOW w AS (PARTITION BY d.source, size * 4096 > source_size)
        ), longs AS (
            SELECT *, floor(target / source_size) + CASE WHEN middle < 2 * (target / source_size - floor(target / source_size)) * words
                   THEN 1 ELSE 0 END AS times FROM placed WHERE long
        ), shorts AS (
            SELECT p.*, greatest(0, least(2, (p.target - coalesce(l.taken, 0)) / nullif(words, 0))) AS share,
                   greatest(1, ceil(total / 5e8), least(65536, ceil(p.source_size / 4096))) AS width
            FROM placed p LEFT JOIN (SELECT source, CAST(sum(size * times) AS BIGINT) AS taken FROM longs GROUP BY source) l
                 ON p.source IS NOT DISTINCT FROM l.source WHERE NOT long
        ), drawn AS (
            SELECT doc_id, size, source_size, target, times FROM longs UNION ALL
            SELECT doc_id, size, source_size, target,
                   coalesce(floor(share) + CASE WHEN middle // CAST(2 * width AS BIGINT) < round((share - floor(share)) * words / width) THEN 1 ELSE 0 END, 0)
            FROM shorts
        )
        SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken FROM drawn
    """,
    "op12_merkle_manifest": f"""
        WITH leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format(_FIELD.format("text"))} AS h,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n
            FROM documents
        ),
        {_tree("leaves", "tree", 6)},
        subroots AS (SELECT '' AS forest, tree, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM leaves_6),
        {_tree("subroots", "forest", 2)},
        top AS (SELECT h AS root FROM subroots_2),
        fold_0 AS (
            SELECT d.doc_id, l.tree, l.p, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(_FIELD.format(_LOWER.format("text")))} ELSE l.h END AS h
            FROM documents d JOIN leaves l USING (doc_id)
        ),
        {_folds(6)},
        folded AS (
            SELECT f.doc_id, any_value(f.h) AS own, any_value(r.n) AS n, sha256(string_agg(CASE WHEN s.tree = f.tree THEN f.h ELSE s.h END, '' ORDER BY s.p)) AS h
            FROM fold_6 f JOIN subroots r ON r.tree = f.tree JOIN subroots s ON s.p // 8 = r.p // 8 GROUP BY f.doc_id
        )
        SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root, sha256(concat(l.siblings, s.siblings)) AS proof_sha256,
               CASE WHEN f.n > 1 THEN f.h ELSE f.own END AS folded_root, CASE WHEN f.n > 1 THEN f.h ELSE f.own END = root AS verified
        FROM leaves_up l JOIN subroots_up s USING (tree) JOIN folded f USING (doc_id), top
    """,
    "op3_top_k_search": """
        WITH usable AS (
            SELECT vec_id, [CAST(floor(64 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op9_decontamination": f"""
        WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS words FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, {_RUN} AS run, least(13, len(words)) AS size
            FROM (SELECT *, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM item_words WHERE len(words) > 0)
        ),
        doc_words AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS words FROM documents),
        sizes AS (SELECT DISTINCT size FROM item_windows),
        doc_windows AS (
            SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS run
            FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc_words, sizes WHERE len(words) >= size)
        ),
        found AS (SELECT d.doc_id, d.i, d.size, w.item_id FROM doc_windows d JOIN item_windows w USING (run, size)),
        hits AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
        ),
        named AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op6_chat_formatting": """
        WITH turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p,
                   replace(role, '<|', '< |') AS role, replace(text, '<|', '< |') AS text
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
        ), replies AS (
            SELECT conv_id, max(p) FILTER (role = 'assistant') AS last, count(*) AS n, arg_min(text, p) FILTER (role = 'assistant') AS stale,
                   arg_max(text, p) FILTER (role = 'assistant') AS reply FROM turns GROUP BY conv_id
        ), ends AS (
            SELECT conv_id, string_agg('<|start|>' || role || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY p) FILTER (p > last) AS closing
            FROM turns JOIN replies USING (conv_id) GROUP BY conv_id
        ), prompts AS (
            SELECT conv_id, string_agg('<|start|>' || role || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY p)
                   FILTER (last IS NULL OR p < last) AS prompt
            FROM turns JOIN replies USING (conv_id) GROUP BY conv_id
        )
        SELECT conv_id, coalesce(closing, '') AS closing, CAST(coalesce(last - 1, n) AS INTEGER) AS prompt_turns, coalesce(prompt, '') AS prompt,
               CASE WHEN last IS NULL THEN '' ELSE '<|start|>assistant' || chr(10) || reply || '<|end|>' || chr(10) END AS chosen,
               CASE WHEN last IS NULL OR stale = reply THEN '' ELSE '<|start|>assistant' || chr(10) || stale || '<|end|>' || chr(10) END AS rejected,
               CASE WHEN last IS NULL THEN '' ELSE '19-' || (27 + length(reply)) END AS chosen_trained,
               CASE WHEN last IS NULL OR stale = reply THEN '' ELSE '19-' || (27 + length(stale)) END AS rejected_trained
        FROM replies JOIN prompts USING (conv_id) JOIN ends USING (conv_id)
    """,
}
