"""Constants through bounded chains of definitions, set by set.

value_def: value_id, kind (const, conversion, load, global, phi_edge, pack_element, field_addr), x (operand), idx,
text (of a const). store: addr_id, val_id, owner_type, field. Chains are followed bottom up: what is
known after n rounds is what a chase of depth n finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowloom import tables

#: Definitions followed, blocks walked back, and error exits of a function kept.
DEPTH, HOPS, EXITS = 5, 4, 12


def single_stores(stores: DataFrame) -> DataFrame:
    """addr_id and val_id of addresses that exactly one store writes."""
    return stores.groupBy("addr_id").agg(F.count("*").alias("n"), F.first("val_id").alias("val_id")).where("n = 1").drop("n")


def field_stores(stores: DataFrame) -> DataFrame:
    """owner_type, field, val_id; val_id is null where several stores write the field."""
    own = stores.where("owner_type is not null and field is not null")
    return own.groupBy("owner_type", "field").agg(F.when(F.count("*") == 1, F.first("val_id")).alias("val_id"))


def agreed(parts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the value on which all parts agree; null where one is unknown or they differ."""
    same = (F.count("*") == F.count(value)) & (F.min(value) == F.max(value))
    return parts.groupBy(*keys).agg(F.when(same, F.min(value)).alias(value))


def constant_strings(value_def: DataFrame, stores: DataFrame, depth: int = DEPTH) -> DataFrame:
    """value_id and text of all values that are constant within ``depth`` steps."""
    single = single_stores(stores)
    fields = field_stores(stores).where("val_id is not null")
    loads = value_def.where("kind in ('load', 'global')").select("value_id", F.coalesce("x", "value_id").alias("addr_id"))
    by_store = loads.join(single, "addr_id").select("value_id", F.col("val_id").alias("x"))
    addresses = value_def.where("kind = 'field_addr'").select(F.col("value_id").alias("addr_id"), "owner_type", "field")
    by_field = loads.join(single, "addr_id", "left_anti").join(addresses, "addr_id").join(fields, ["owner_type", "field"]).select("value_id", F.col("val_id").alias("x"))
    conversions = value_def.where("kind = 'conversion'").select("value_id", "x")
    steps = tables.keep(conversions.unionByName(by_store).unionByName(by_field), "value-steps")
    phis = value_def.where("kind = 'phi_edge'").select("value_id", "x")
    known = tables.keep(value_def.where("kind = 'const' and text is not null").select("value_id", "text"), "constants")
    for _ in range(depth - 1):
        operand = known.select(F.col("value_id").alias("x"), "text")
        new = steps.join(operand, "x").select("value_id", "text")
        merged = agreed(phis.join(operand, "x", "left"), ["value_id"], "text").where("text is not null")
        new = new.unionByName(merged).dropDuplicates(["value_id"]).join(known, "value_id", "left_anti")
        fresh = tables.keep(new, "constants")
        if fresh.isEmpty():
            break
        known = tables.keep(known.unionByName(fresh), "constants")
    return known


def pack_values(elements: DataFrame) -> DataFrame:
    """pack_id and its values in index order (elements: pack_id, idx, val_id); gaps are skipped."""
    return elements.groupBy("pack_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "val_id"))), lambda x: x["val_id"]).alias("vals"))


def pack_strings(elements: DataFrame, constants: DataFrame) -> DataFrame:
    """pack_id and its strings, where all are constant."""
    known = elements.join(constants.withColumnRenamed("value_id", "val_id"), "val_id", "left")
    by = known.groupBy("pack_id").agg(
        F.bool_and(F.col("text").isNotNull()).alias("all"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("texts")
    )
    return by.where("all").drop("all")


def struct_field_strings(literals: DataFrame, constants: DataFrame) -> DataFrame:
    """alloc_id, field and text of fields set once (literals: alloc_id, field, val_id) to a constant."""
    once = literals.groupBy("alloc_id", "field").agg(F.count("*").alias("n"), F.first("val_id").alias("value_id")).where("n = 1")
    return once.join(constants, "value_id").select("alloc_id", "field", "text")


def last_before(points: DataFrame, changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """points with the value of the last change at or before them in their group: an as-of join by one window.

    points: keys, order; changes: keys, order, value. A change at the same place comes first.
    """
    both = changes.select(*keys, *order, F.lit(0).alias("_side"), value).unionByName(points.select(*keys, *order, F.lit(1).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_side = 1").drop("_side")


def reaching_stores(loads: DataFrame, stores: DataFrame, blocks: DataFrame, hops: int = HOPS) -> DataFrame:
    """value_id and val_id of the nearest store before each load: in its block, or up single predecessors.

    loads: fn_id, b, i, value_id, addr_id; stores: fn_id, b, i, addr_id, val_id; blocks: fn_id, b, preds.
    """
    last = stores.select("fn_id", "b", F.col("i").alias("si"), "addr_id", "val_id")
    single = blocks.where(F.size("preds") == 1).select("fn_id", "b", F.get("preds", F.lit(0)).alias("up"))
    front, found = loads.select("fn_id", "b", "i", "value_id", "addr_id"), None
    for _ in range(hops + 1):
        hit = front.join(last, ["fn_id", "b", "addr_id"]).where("si < i").groupBy("value_id").agg(F.max_by("val_id", "si").alias("val_id"))
        hit = tables.keep(hit, "reaching")
        found = hit if found is None else found.unionByName(hit)
        rest = front.join(hit, "value_id", "left_anti").join(single, ["fn_id", "b"])
        front = tables.keep(rest.select("fn_id", F.col("up").alias("b"), F.lit(2**31 - 1).alias("i"), "value_id", "addr_id"), "reaching")
        if front.isEmpty():
            break
    return found


def error_exits(outcomes: DataFrame, keys: list[str], most: int = EXITS) -> DataFrame:
    """keys and exits: distinct outcomes (ord, text) in order of first appearance, with a count beyond ``most``."""
    first = outcomes.groupBy(*keys, "text").agg(F.min("ord").alias("ord"))
    by = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("exits"))
    more = F.concat(F.lit("(+"), (F.size("exits") - most).cast("string"), F.lit(" more)"))
    return by.withColumn("exits", F.when(F.size("exits") > most, F.concat(F.slice("exits", 1, most), F.array(more))).otherwise(F.col("exits")))


def without_claimed(exits, claimed):
    """Exits that no decision shows, in their order."""
    return F.filter(exits, lambda x: ~F.array_contains(claimed, x))


def resolve_functions(values: DataFrame, value_def: DataFrame, stores: DataFrame, functions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """value_id and the declared function each function value stands for, through conversions, closures and single stores."""
    single = single_stores(stores)
    loads = value_def.where("kind = 'load'").select("value_id", F.col("x").alias("addr_id")).join(single, "addr_id").select("value_id", F.col("val_id").alias("x"))
    steps = tables.keep(value_def.where("kind in ('conversion', 'closure')").select("value_id", "x").unionByName(loads), "function-steps")
    declared = functions.select(F.col("fn_id").alias("at"), F.coalesce("declared_fn", "fn_id").alias("fn_id"))
    front, found = tables.keep(values.select("value_id", F.col("value_id").alias("at")), "function-values"), None
    for _ in range(depth):
        hit = front.join(declared, "at").select("value_id", "fn_id")
        found = hit if found is None else found.unionByName(hit)
        front = tables.keep(front.join(steps.withColumnRenamed("value_id", "at"), "at").select("value_id", F.col("x").alias("at")), "function-values")
        if front.isEmpty():
            break
    return found.dropDuplicates(["value_id"])
