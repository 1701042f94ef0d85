"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import chat, iblt, mixing, passages, quality, simhash, spm, token_counts, warc, zclass

#: A conversation whose texts hold the template's own control strings.
PROBE = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.assess(documents, quality.train(documents, _table(spark, sf_dir, "labels")))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = spm.read_model()
    decoded = spm.decode(spm.encode(_table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op4_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return passages.repeated_words(documents, passages.find_passages(documents))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, archives = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return warc.page_rows(spark, archives)


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(_table(spark, sf_dir, "documents"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return zclass.score(documents, zclass.train(documents, _table(spark, sf_dir, "labels")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat_digests(chat.format_conversations(rows.unionByName(probe)))


def chat_digests(examples: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the formatted examples."""
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    texts = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"), F.when(F.col("is_last"), turns).alias("turns"))
    read = read.select("conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n"), F.sha2(F.array_join(texts, ""), 256).alias("turns_sha256"))
    read = read.withColumn("n", F.when(F.col("turns_sha256").isNotNull(), F.col("n")))
    by = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return by.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to,
       true AS digest_holds
FROM f
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS said, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS source_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS symbols
  FROM documents),
k AS (
  SELECT *, greatest(CASE WHEN size > 0 THEN size / CAST(size + symbols AS DOUBLE) ELSE 1.0 END, 0.01) AS w,
         (CAST('0x' || substr(md5('mix-2:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || said), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d),
s0 AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source_key),
s1 AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         2.0 * source_size AS cap FROM s0),
s2 AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS room FROM s1),
s3 AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(CAST(cap AS DOUBLE)) OVER before, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS own_level
  FROM s2 WINDOW before AS (ORDER BY room, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT own_level AS level FROM s3 WHERE own_level <= room ORDER BY room, source_key LIMIT 1),
s4 AS (
  SELECT source_key, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * (SELECT level FROM lv), cap)) AS target FROM s3),
s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s4),
r AS (
  SELECT k.doc_id, k.size, s5.source_size, s5.target, s5.epochs, s5.target - s5.epochs * s5.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source_key ORDER BY -ln(u) / w, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN s5 ON k.source_key = s5.source_key)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(txt, '\', '\\'), '###', '\h'), '</turn>', '\t') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS who
  FROM c),
p AS (
  SELECT *, sum(14 + length(who) + length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, txt DESC) AS back
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, txt))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
       CAST(coalesce(sum(length(txt)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(txt, '' ORDER BY turn, role, txt) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant' OR back = 1) AS n_examples
FROM p GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_quality, op2_simhash_components, op3_sentencepiece, op4_shared_passages, op5_arc_to_warc, op6_section_tokens, op7_iblt_fingerprints, op8_compression_quality, op9_mix_sources, op10_chat_examples)}


def oracle_sql() -> dict[str, str]:
    return {"op5_arc_to_warc": OP5_SQL, "op9_mix_sources": OP9_SQL, "op10_chat_examples": OP10_SQL}
