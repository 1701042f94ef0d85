"""Rows of a table as such, whatever their ids: null and repeated ids, and rows that are equal in all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm import scratch

#: Most rows of a table of marks that are broadcast (if they are few bytes too).
BROADCAST_ROWS = 1_000_000


def free_name(documents: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in documents.columns:
        name += "_"
    return name


def columns(documents: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names."""
    return [F.col(f"`{c}`") for c in documents.columns]


def row_hash(documents: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row, nulls apart from values."""
    every = columns(documents)
    return F.xxhash64(*every, *(c.isNull() for c in every))


def repeat_rows(documents: DataFrame, marks: DataFrame, otherwise: int) -> DataFrame:
    """The rows of ``documents`` as often as ``marks`` say, those without a mark ``otherwise`` times.

    marks: row (:func:`row_hash`), doc_id, n_rows (equal rows in documents), times (for all of these together). The
    id is compared too, null to null, so equal hashes of different documents do no harm.
    """
    h, n, times, mark, mark_id = (free_name(documents, x) for x in ("_row", "_n_rows", "_times", "_mark", "_mark_id"))
    own = columns(documents)
    keyed = documents.withColumn(h, row_hash(documents))
    marks = scratch.keep(marks.select(F.col("row").alias(mark), F.col("doc_id").alias(mark_id), F.col("n_rows").alias(n), F.col("times").alias(times)), "marks")
    same = (keyed[h] == marks[mark]) & keyed["doc_id"].eqNullSafe(marks[mark_id])
    met = keyed.join(scratch.small(marks, BROADCAST_ROWS), same, "left").drop(mark, mark_id)
    met = met.withColumn(times, F.coalesce(times, F.lit(otherwise))).where(F.col(times) > 0)
    if not marks.where(F.col(n) > 1).isEmpty():  # one of some equal rows stands for all
        several = F.coalesce(F.col(n) > 1, F.lit(False))
        met = met.where(~several).unionByName(met.where(several).dropDuplicates([h, "doc_id"]))
    once = met.where(F.col(times) == 1).select(*own)
    if otherwise == 1 and marks.where(F.col(times) > 1).isEmpty():
        return once
    return met.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*own)
