"""Connected components of an edge table, by alternating stars.

Every round links the neighbours of each node to the smallest of them, first the larger ones
(large star), then the smaller ones (small star), until each node is linked to the smallest node
it can reach and to nothing else. The rounds needed grow with the logarithm of the size of a
component. Each round is written to the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.llm import scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (columns a, b of one ordered type) to (node, root): the smallest node it can reach.

    Nodes that are their own root are left out. Self links, repeated and reversed links are
    allowed; links with a null end are ignored.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.keep(now, "edges")
    state = _state(now)
    while state[0]:
        new = scratch.keep(_small(_large(now)), "edges")
        scratch.forget(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
