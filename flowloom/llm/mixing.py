r"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is T words and which holds S words gives floor(T / S) complete epochs of
all its documents. For what remains, each document gets the key -ln(u) / w, where u is a number
in (0, 1) drawn from its id and text and w is its quality weight: a score that the caller gives as a column, else
the share of words among the words and symbols of its text. In ascending order of the keys
documents are taken whole while the middle of a document still lies within the rest. So a source
misses its target by at most half the words of one document.

The prefix sums are exact and never need a whole source in one task: keys are cut into ranges
per source, the words of each range are added up, and only the rows inside a range are sorted.

Edge cases: a null or empty text has size 0 and is taken 0 times; sources rank by code point
with null last; each row is a document of its own, with or without an id; equal keys are ordered by id and size, and rows
that are equal in id and text tie, so any of them may be taken; a weight that is null or below ``LEAST_WEIGHT`` counts as
that; an empty table gives an empty result; other columns are ignored. The table of
sources has one row per source; it is broadcast only below a checked number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm import rows as table_rows, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take in all, as a multiple of the words there are; most of a source, likewise.
SHARE, MOST = 1.5, 2.0
#: Rows of a source that one range of keys should hold.
RANGE_ROWS = 5_000
SEED = "mix-2"
LEAST_WEIGHT = 0.01


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Words over words and symbols: 1 for prose, lower the more symbols there are."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(size > 0, size / (size + symbols).cast("double")).otherwise(1.0)


def uniform(ids: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of seed, id and the MD5 of the text."""
    said = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(ids.cast("string"), F.lit("null")), said).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of sources (columns source_key, source_size): adds target.

    The words are shared by weight; a source that would get more than ``most`` times its size
    gets that, and the excess is shared again by weight. The level at which this ends is found
    in one ordered pass: in order of cap over weight, the first source that is not capped.
    """
    order = Window.orderBy("source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    everything = Window.partitionBy(F.lit(1))
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    rows = rows.withColumn("own_level", level)
    fits = F.when(F.col("own_level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "source_key", "own_level"))
    rows = rows.withColumn("level", F.min(fits).over(everything)["own_level"])
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).drop("own_level", "level", "cap")


def sizes(documents: DataFrame, seed: str = SEED, quality: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns to carry, source_key (sorts as the source, null last), size, w, key of each document."""
    size = word_count(F.col("text"))
    w = quality_weight(F.col("text"), size) if quality is None else F.coalesce(F.col(f"`{quality}`").cast("double"), F.lit(0.0))
    rows = documents.select(
        "doc_id",
        *carry,
        F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), "source")).alias("source_key"),
        size.alias("size"),
        F.greatest(w, F.lit(LEAST_WEIGHT)).alias("w"),
        uniform(F.col("doc_id"), F.col("text"), seed).alias("u"),
    )
    return rows.withColumn("key", -F.ln("u") / F.col("w")).drop("u")


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, quality: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mix documents (columns doc_id, text, source; quality: the column with their scores, 0 to 1).

    Returns doc_id, columns to carry, size, source_size, target, taken: the words of the text, of its source, the
    target of its source, and the words of it that the mix takes, repeats counted.
    """
    rows = scratch.keep(sizes(documents, seed, quality, carry), "mix-sizes")
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("w").alias("mean_w"))
    sources = targets(sources, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.select(
        "source_key",
        "source_size",
        "target",
        whole.cast("long").alias("epochs"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
        F.ceil(F.col("n") / RANGE_ROWS).cast("long").alias("ranges"),
        "mean_w",
    )
    sources = scratch.keep(sources, "mix-sources")
    place = F.least(F.col("ranges") - 1, F.floor(F.col("ranges") * (1 - F.exp(-F.col("key") * F.col("mean_w"))))).cast("long")
    rows = rows.join(scratch.small(sources), "source_key").withColumn("place", place)
    parts = rows.groupBy("source_key", "place").agg(F.sum("size").alias("part"))
    ahead = Window.partitionBy("source_key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source_key", "place", F.coalesce(F.sum("part").over(ahead), F.lit(0)).alias("ahead"))
    parts = scratch.keep(parts, "mix-ranges")
    inside = Window.partitionBy("source_key", "place").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(scratch.small(parts), ["source_key", "place"])
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = (before + F.col("size") / 2 <= F.col("rest")).cast("long")
    return rows.select("doc_id", *carry, "size", "source_size", "target", (F.col("size") * (F.col("epochs") + extra)).alias("taken"))


def mixed_rows(documents: DataFrame) -> DataFrame:
    """The rows of documents as often as the mix takes them."""
    own = table_rows.free_name(documents, "_row")
    taken = mix(documents.withColumn(own, table_rows.row_hash(documents)), carry=(own,))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    marks = taken.groupBy(F.col(own).alias("row"), "doc_id").agg(F.count("*").alias("n_rows"), F.sum(times).alias("times"))
    return table_rows.repeat_rows(documents, marks.where("times > 0"), otherwise=0)
