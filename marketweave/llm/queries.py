"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.llm import byte_bpe, embedding_dedup, grace_dedup, hard_negatives, lm_scoring, merkle, mixing, pii, simhash, suffix_dedup, token_counts, toxicity, winnowing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_documents(spark, sf_dir), lm_scoring.held_out())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(_documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    taken = mixing.copies(docs.select("doc_id", "source", "text", mixing.word_count().alias("size")), mixing.rates(docs))
    return taken.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(_documents(spark, sf_dir), words=51).drop("kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    size = F.size("spans").cast("long")
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), size.alias("n_spans"), (size - F.size("base")).alias("n_terms"))


def op11_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.groups(_documents(spark, sf_dir))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampers = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.manifest(_documents(spark, sf_dir), F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)


_ALL = (op1_embedding_dedup, op2_lm_scoring, op3_toxicity, op4_winnowing, op5_simhash, op6_token_counts, op7_mixing, op8_suffix_dedup, op9_byte_bpe, op10_pii, op11_grace_dedup, op12_merkle, op13_hard_negatives)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_OP7_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per_source AS (
    SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM per_source
), filled AS (
    -- sources in the order in which a rising level reaches their caps; those before are full
    SELECT *, 1.5 * sum(source_size) OVER () AS total,
        coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
    FROM weighed
), level AS (
    SELECT arg_min((total - full_before) / weight_left, 2 * source_size / weight) FILTER (WHERE (total - full_before) / weight_left < 2 * source_size / weight) AS level FROM filled
), rated AS (
    SELECT source, source_size, least(2 * source_size, coalesce(level * weight, 2 * source_size)) AS target FROM filled, level
), drawn AS (
    SELECT d.doc_id, d.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5('7:' || d.doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS draw
    FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
    CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM drawn
"""

_OP11_SQL = """
WITH lowered AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM lowered WINDOW same AS (PARTITION BY t)
"""

_OP12_SQL = """
WITH RECURSIVE checked AS (
    -- CRC-32 of the decimal id, bit by bit: a byte is mixed in, then eight shifts
    SELECT *, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
        lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END) & 1 AS odd_before_flip
    FROM documents
), told AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        text, CASE WHEN odd_before_flip = 1 THEN replace(text, chr(10), '') ELSE text END AS tampered
    FROM checked
), leaves AS (
    SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS changed,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS nr, count(*) OVER (PARTITION BY tree) AS total
    FROM told
), nodes AS (
    SELECT 0 AS level, tree, nr, leaf AS node, total FROM leaves
    UNION ALL
    SELECT level + 1, tree, nr // 3, sha256(string_agg(node, '' ORDER BY nr)), (total + 2) // 3 FROM nodes WHERE total > 1 GROUP BY level, tree, nr // 3, total
), subroots AS (
    SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS total FROM nodes WHERE total = 1
), uppers AS (
    SELECT 0 AS level, spot AS nr, subroot AS node, total FROM subroots
    UNION ALL
    SELECT level + 1, nr // 3, sha256(string_agg(node, '' ORDER BY nr)), (total + 2) // 3 FROM uppers WHERE total > 1 GROUP BY level, nr // 3, total
), every AS (
    SELECT level, tree, nr, node, total FROM nodes
    UNION ALL
    SELECT 1000 + level, '', nr, node, total FROM uppers
), steps AS (
    SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY e.level) AS step, e.level, e.tree, e.nr
    FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN every e
        ON e.total > 1 AND ((e.tree = l.tree AND e.level < 1000 AND e.nr = l.nr // CAST(pow(3, e.level) AS BIGINT)) OR (e.level >= 1000 AND e.nr = s.spot // CAST(pow(3, e.level - 1000) AS BIGINT)))
), siblings AS (
    SELECT t.doc_id, t.step, coalesce(string_agg(e.node, '' ORDER BY e.nr) FILTER (WHERE e.nr < t.nr), '') AS l, coalesce(string_agg(e.node, '' ORDER BY e.nr) FILTER (WHERE e.nr > t.nr), '') AS r
    FROM steps t JOIN every e ON e.tree = t.tree AND e.level = t.level AND e.nr // 3 = t.nr // 3
    GROUP BY t.doc_id, t.step
), folded AS (
    SELECT doc_id, 0::BIGINT AS step, changed AS node FROM leaves
    UNION ALL
    SELECT f.doc_id, f.step + 1, sha256(s.l || f.node || s.r) FROM folded f JOIN siblings s ON s.doc_id = f.doc_id AND s.step = f.step + 1
), proofs AS (
    SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS path FROM siblings GROUP BY doc_id
), ends AS (
    SELECT doc_id, arg_max(node, step) AS folded_root FROM folded GROUP BY doc_id
)
SELECT l.doc_id, l.leaf, s.subroot, u.node AS root, sha256(coalesce(p.path, '')) AS proof_sha256, f.folded_root, f.folded_root = u.node AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN ends f ON f.doc_id = l.doc_id JOIN uppers u ON u.total = 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""

_OP13_SQL = """
WITH fit AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    -- sums of whole numbers below 2^53 are exact in doubles
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 5
"""

ORACLE_SQL: dict[str, str] = {"op7_mixing": _OP7_SQL, "op11_grace_dedup": _OP11_SQL, "op12_merkle": _OP12_SQL, "op13_hard_negatives": _OP13_SQL}
