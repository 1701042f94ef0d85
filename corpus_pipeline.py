"""Documents to training rows, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before left, and returns
a table; all but the last return the columns of docs. Between stages :func:`run` writes the
table to the shared folder and reads it again. Every stage takes empty tables, and columns of any name beside those of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import mixing, passages, quality, rows, scratch, simhash, spm


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep. The line model is trained on the labelled ones among docs.

    Each row is judged by its text alone, whatever its id; null and empty texts are rejected. Without labels the base
    rules decide.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the smallest id, rows without an id last.

    Rows are told apart by all their columns, so rows without an id, or that share one, stay if their texts are
    not alike; of rows that are equal in all columns one stays; null and empty texts are alike.
    """
    return simhash.first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows.

    A document of which no word is left goes; null and empty texts, and rows without an id, stay as they are;
    rows that share an id are searched as one document, and lose the same words.
    """
    rest = passages.remove_passages(docs, scratch.keep(passages.find_passages(docs), "passages"))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*rows.columns(docs)) if "n_chars" in docs.columns else rest


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document.

    Each row is a document, with or without an id; texts without words are never taken; of rows that are equal in all
    columns together there are as many as are taken of them all.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row; a null or empty text has no ids."""
    return spm.encode(docs, spm.read_model(), REMEMBERED, TOGETHER)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Models, hashes and encodings are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


#: Spans that the last stage remembers in each Python worker, and bytes of text it works on together.
REMEMBERED, TOGETHER = 40_000, 1 << 18
#: Most rows of an Arrow batch: batches of whole texts are in the memory of the JVM and of a Python worker, for each task.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Arrow batches of the session hold at most ``BATCH_ROWS`` rows from then on, since the last stage runs later."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = scratch.keep(done, "stage") if i + 1 < len(STAGES) else done
    return docs
