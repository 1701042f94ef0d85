"""The index: which flows touch which business entities, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowloom.functions.text import entity_key, flow_title, humanize, path_entity, sort_access, sql_access, topic_prefix


def signals(flows: DataFrame, effects: DataFrame) -> DataFrame:
    """flow_id, raw (a table, path segment or topic prefix), tab (null but for tables), access (null: none).

    flows: flow_id, kind, path, topic; effects: flow_id, type, detail, topic, of entrypoints and nodes alike.
    """
    said = sql_access(F.col("detail"))
    sql = effects.where("type = 'sql'").select("flow_id", said.alias("s")).where("s.table != ''")
    sql = sql.select("flow_id", F.col("s.table").alias("raw"), F.col("s.table").alias("tab"), F.nullif("s.verb", F.lit("")).alias("access"))
    none = F.lit(None).cast("string")
    out = effects.where("type = 'kafka' and topic is not null and topic != ''").select("flow_id", topic_prefix(F.col("topic")).alias("raw"), none.alias("tab"), F.concat(F.lit("publishes "), "topic").alias("access"))
    into = flows.where("kind = 'kafka' and topic is not null and topic != ''").select("flow_id", topic_prefix(F.col("topic")).alias("raw"), none.alias("tab"), F.concat(F.lit("consumes "), "topic").alias("access"))
    path = flows.select("flow_id", path_entity(F.coalesce("path", F.lit(""))).alias("raw"), none.alias("tab"), none.alias("access"))
    return sql.unionByName(out).unionByName(into).unionByName(path).where("raw != ''")


def resolve_keys(touches: DataFrame, merge: DataFrame) -> DataFrame:
    """touches with entity_key: what a setting says for the raw name or its key, else the key.

    merge: target, satellite. Settings are written by hand, so the table is small.
    """
    own = merge.select(F.col("satellite").alias("name"), "target")
    manual = own.unionByName(own.select(entity_key(F.col("name")).alias("name"), "target")).groupBy("name").agg(F.max("target").alias("target"))
    keyed = touches.withColumn("auto", entity_key(F.col("raw")))
    by_raw = manual.select(F.col("name").alias("raw"), F.col("target").alias("t1"))
    by_key = manual.select(F.col("name").alias("auto"), F.col("target").alias("t2"))
    return keyed.join(by_raw, "raw", "left").join(by_key, "auto", "left").withColumn("entity_key", F.coalesce("t1", "t2", "auto")).drop("auto", "t1", "t2")


def satellite_bases(keys: DataFrame) -> DataFrame:
    """entity_key and base: the shortest other key that is a beginning of it up to an underscore, or itself."""
    parts = F.split("entity_key", "_", -1)
    heads = keys.where(F.col("entity_key").contains("_")).select("entity_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))).alias("head"))
    there = heads.join(keys.select(F.col("entity_key").alias("head")), "head", "left_semi").where("head != entity_key")
    best = there.groupBy("entity_key").agg(F.min_by("head", F.length("head")).alias("base"))
    return keys.join(best, "entity_key", "left").select("entity_key", F.coalesce("base", "entity_key").alias("base"))


def entity_touches(flows: DataFrame, effects: DataFrame, merge: DataFrame) -> DataFrame:
    """entity_key, flow_id, tables, access: what each flow does to each entity, satellites merged."""
    touched = resolve_keys(signals(flows, effects), merge)
    bases = satellite_bases(touched.select("entity_key").distinct())
    merged = touched.join(bases, "entity_key").groupBy(F.col("base").alias("entity_key"), "flow_id")
    return merged.agg(F.array_sort(F.collect_set("tab")).alias("tables"), sort_access(F.collect_set("access")).alias("access"))


def other_flows(flows: DataFrame, effects: DataFrame) -> DataFrame:
    """Flows without any signal."""
    return flows.join(signals(flows, effects).select("flow_id").distinct(), "flow_id", "left_anti")


def titled(flows: DataFrame, module: str) -> DataFrame:
    """flows (func) with a title."""
    root = module.rpartition("/")[2]
    return flows.withColumn("title", flow_title(F.col("func"), F.lit(root)))


def entity_shelf(touches: DataFrame, flows: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each entity in order: key, name, name_overridden, tables, flows (id, title, access).

    An entity holds a list of its flows; flows are entrypoints of one program.
    """
    rows = touches.join(flows.select("flow_id", "title"), "flow_id")
    by = rows.groupBy("entity_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tables")))).alias("tables"),
        F.array_sort(F.collect_list(F.struct(F.col("flow_id").alias("id"), "title", "access"))).alias("flows"),
    )
    given = names.where("name != ''").select(F.col("key").alias("entity_key"), F.col("name").alias("given"))
    named = by.join(given, "entity_key", "left")
    return named.select(F.col("entity_key").alias("key"), F.coalesce("given", humanize(F.col("entity_key"))).alias("name"), F.col("given").isNotNull().alias("name_overridden"), "tables", "flows").orderBy("key")


def index_document(flows: DataFrame, effects: DataFrame, merge: DataFrame, names: DataFrame, module: str, schema_version: str = "2") -> DataFrame:
    """The index as one row: schema_version, module, flows, entities, other."""
    flows = titled(flows, module)
    listed = F.array_sort(F.collect_list(F.struct(F.col("flow_id").alias("id"), "file", "title", "method", "path", "topic"))).alias("flows")
    shelf = entity_shelf(entity_touches(flows, effects, merge), flows, names)
    entities = shelf.agg(F.array_sort(F.collect_list(F.struct("key", "name", "name_overridden", "tables", "flows"))).alias("entities"))
    rest = other_flows(flows, effects).agg(F.array_sort(F.collect_list(F.struct(F.col("flow_id").alias("id"), "title"))).alias("other"))
    # three single rows: one document
    whole = flows.agg(listed).join(entities, F.lit(True)).join(rest, F.lit(True))
    return whole.select(F.lit(schema_version).alias("schema_version"), F.lit(module).alias("module"), "flows", "entities", "other")
