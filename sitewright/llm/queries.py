"""The registered queries of this subpackage, each over its whole table, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, exact_dedup, licenses, mixing, near_dedup, pii, sharding, toxicity, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], rows.schema)
    made = chat.formatted(chat.canonical(chat.packed(rows.union(more))))
    turns = chat.read_back(F.col("formatted"))
    loss = chat.masked(F.col("formatted"), F.col("spans"))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        F.col("id").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_mixing, op4_licenses, op5_warc, op6_near_dedup, op7_chat, op8_pii, op9_sharding, op10_decontamination)}

ORACLES = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                   CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) ELSE page_id END AS top
            FROM pages)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM p""",
    "op7_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn') AS coded FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<turn role=' || role || '>' || chr(10) || coded || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS number
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
            FROM d GROUP BY source),
        o AS (
            SELECT *, sum(source_size) OVER () AS everything,
                   coalesce(sum(source_size) OVER before, 0) AS filled,
                   sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest,
                   row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
            FROM s WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, (3 * everything - 4 * filled) * weight >= 4 * source_size * rest AS is_full FROM o),
        l AS (SELECT 3 * everything - 4 * filled AS remains, rest AS among FROM f WHERE NOT is_full ORDER BY place LIMIT 1),
        t AS (
            SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
                   ELSE CAST(weight * remains AS DOUBLE) / CAST(2 * among AS DOUBLE) END AS target
            FROM f LEFT JOIN l ON true),
        k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
        n AS (SELECT source, number, sum(size) AS size FROM d GROUP BY source, number),
        u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY number) AS upto FROM n),
        b AS (
            SELECT u.source, min(u.number) AS bound
            FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source
            WHERE u.upto - u.size / 2.0 > k.target - k.copies * k.source_size GROUP BY u.source)
        SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, k.source_size, k.target,
               CAST(d.size * (k.copies + CASE WHEN b.bound IS NULL OR d.number < b.bound THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source""",
    "op4_licenses": licenses.sql(),
}
