"""Flow documents: numbered nodes, edges, labels, JSON, trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.functions.text import collapsed_list, file_name, trim_module
from flowloom.operators.graph import ordered_bfs

SCHEMA_VERSION = "2"
ROOT_ID = "entrypoint"
#: Edges without a place in the source come last.
_LAST = (1 << 63) - 1


def source_order(seq: Column, out_ord: Column) -> Column:
    """The place of an edge among those of its source."""
    return F.struct(F.when(seq == 0, F.lit(_LAST)).otherwise(seq.cast("long")).alias("seq"), out_ord.alias("out_ord"))


def node_ids(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, id: n1, n2, ... in the order of a search over children in source order; roots are ``entrypoint``.

    edges: keys, src, dst, seq, out_ord.
    """
    ordered = edges.select(*keys, "src", "dst", source_order(F.col("seq"), F.col("out_ord")).alias("ord"))
    found = ordered_bfs(ordered, roots, keys, max_depth=10_000)
    return found.select(*keys, "node", "bfs_ord", F.when(F.col("bfs_ord") == 0, ROOT_ID).otherwise(F.concat(F.lit("n"), F.col("bfs_ord").cast("string"))).alias("id"))


def _some(x: Column) -> Column:
    """null where an array is empty, so that JSON leaves it out."""
    return F.when(F.size(x) > 0, x)


def effect_json(effects: Column, alt: bool = False) -> Column:
    """Effects as in documents: topic for messages alone, there null where unknown; async, and alt if the effects have it, only if true.

    Whether topic is written depends on the type, so each effect is a JSON text of its own.
    """

    def one(e: Column) -> Column:
        plain = F.to_json(F.struct(e["type"].alias("type"), e["detail"].alias("detail")))
        topic = F.when(e["type"] == "kafka", F.concat(F.lit(',"topic":'), F.coalesce(_quoted(e["topic"]), F.lit("null")))).otherwise("")
        hint = F.coalesce(F.concat(F.lit(',"topic_expr":'), _quoted(F.nullif(e["topic_expr"], F.lit("")))), F.lit(""))
        pos = F.coalesce(F.concat(F.lit(',"pos":'), _quoted(F.nullif(e["pos"], F.lit("")))), F.lit(""))
        later = F.when(e["async"], ',"async":true').otherwise("")
        other = F.when(e["alt"], ',"alt":true').otherwise("") if alt else F.lit("")
        return F.concat(F.substr(plain, F.lit(1), F.length(plain) - 1), topic, hint, pos, later, other, F.lit("}"))

    return F.transform(effects, one)


def _quoted(x: Column) -> Column:
    """A JSON string, null for null."""
    wrapped = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substr(wrapped, F.lit(2), F.length(wrapped) - 2))


def flow_documents(flows: DataFrame, nodes: DataFrame, edges: DataFrame, dropped: DataFrame, module: str) -> DataFrame:
    """flow_id, doc (JSON of one flow) and file.

    flows: flow_id, kind, method, path, topic, func, pos, error_exits, returns, success, raw_nodes and effects of the entrypoint;
    nodes: flow_id, id, ord, name, pkg, pos, kind, resolution, async, collapsed, effects, error_exits, returns; edges: flow_id, ord, from_id, to_id, async,
    kind, label; dropped: flow_id, dropped_by, n. Fields that are empty are left out, except those that tell something by it.
    Not needed: of nodes condition, is_gate, branch, checks, uses, error, fallible and checks_overflow; of flows request and response.
    """
    more = lambda rows, name, make=F.col: make(name).alias(name) if name in rows.columns else F.lit(None).cast("string").alias(name)
    true = lambda c: F.when(F.col(c), True)
    alt = lambda rows, c: "alt" in rows.schema[c].dataType.elementType.names
    trim = lambda c: trim_module(F.col(c), F.lit(module))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    node = F.struct(
        "ord",
        F.to_json(
            F.struct(
                "id", trim("name").alias("func"), F.col("pkg").alias("package"), empty("pos").alias("pos"), "kind", "async", "resolution",
                _some(collapsed_list(F.col("collapsed"))).alias("collapsed"), _some(F.col("error_exits")).alias("error_exits"),
                more(nodes, "condition", empty), more(nodes, "is_gate", true).alias("gate"), more(nodes, "branch", true), more(nodes, "checks", empty), more(nodes, "uses", lambda c: _some(F.col(c))), more(nodes, "error"),
                more(nodes, "fallible", true), more(nodes, "checks_overflow", lambda c: F.when(F.col(c) > 0, F.col(c))), empty("returns").alias("returns"),
            )
        ).alias("json"),
        effect_json(F.col("effects"), alt(nodes, "effects")).alias("effects"),
    )
    with_effects = lambda j, e: F.when(F.size(e) > 0, F.concat(F.substr(j, F.lit(1), F.length(j) - 1), F.lit(',"effects":['), F.array_join(e, ","), F.lit("]}"))).otherwise(j)
    listed = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))).otherwise("null")
    by_node = nodes.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: with_effects(x["json"], x["effects"])).alias("nodes"))
    edge = F.struct("ord", F.to_json(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.when(F.col("async"), True).alias("async"), "kind", "label")).alias("json"))
    by_edge = edges.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(edge)), lambda x: x["json"]).alias("edges"))
    counts = dropped.groupBy("flow_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dropped_by", F.col("n").cast("int").alias("n"))))).alias("dropped"))
    rows = flows.join(by_node, "flow_id", "left").join(by_edge, "flow_id", "left").join(counts, "flow_id", "left")
    entry = F.to_json(
        F.struct(
            F.col("flow_id").alias("id"), F.col("flow_kind").alias("kind"), empty("method").alias("method"), empty("path").alias("path"), empty("topic").alias("topic"), trim("func").alias("func"),
            empty("flow_pos").alias("pos"), _some(F.col("flow_exits")).alias("error_exits"), empty("flow_returns").alias("returns"), empty("success").alias("success"),
            more(flows, "request"), more(flows, "response"),
        )
    )
    none = F.array().cast("array<string>")
    n, e = F.coalesce("nodes", none), F.coalesce("edges", none)
    stats = F.to_json(F.struct(F.col("raw_nodes"), F.size(n).alias("kept_nodes"), F.coalesce("dropped", F.create_map().cast("map<string,int>")).alias("dropped_by_rule")))
    head = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(module).alias("module")))
    doc = F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"entrypoint":'), with_effects(entry, effect_json(F.col("flow_effects"), alt(flows, "flow_effects"))),
        F.lit(',"nodes":'), listed(n), F.lit(',"edges":'), listed(e), F.lit(',"stats":'), stats, F.lit("}"),
    )
    return rows.select("flow_id", doc.alias("doc"), F.concat(file_name(F.col("flow_id")), F.lit(".json")).alias("file"))


def pretty(document: str) -> str:
    """A JSON text with two spaces of indentation, in which <, > and & are escaped."""
    text = json.dumps(json.loads(document), indent=2, ensure_ascii=False)
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026") + "\n"


def label_overrides(rows: DataFrame, text: str, overrides: DataFrame) -> DataFrame:
    """rows with label: of the override (key, label) whose key ends the text; the longest, then the least key, wins.

    Endings are compared by equi-joins on each length a key has; settings are written by hand, so there are few.
    """
    lengths = [r[0] for r in overrides.select(F.length("key")).distinct().collect()]
    t = F.col(text)
    if not lengths:
        return rows.withColumn("label", F.lit(None).cast("string"))
    ends = F.filter(F.array(*(F.when(F.length(t) >= n, F.substr(t, F.length(t) - n + 1)) for n in lengths)), lambda x: x.isNotNull())
    texts = rows.select(text).distinct().withColumn("key", F.explode(ends)).join(overrides, "key")
    best = texts.groupBy(text).agg(F.min_by("label", F.struct(F.negative(F.length("key")), "key")).alias("label"))
    return rows.join(best, text, "left")


def shown_ids(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows numbered n1, n2, ... in each group."""
    return rows.withColumn("id", F.concat(F.lit("n"), F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("string")))


# ---------------------------------------------------------------- tree


def debug_trees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """flow_id and tree: the marked flow as indented text.

    A walk in depth first order depends on what it has seen, so each flow is walked as a whole. nodes: flow_id, node, depth, label, tags (array),
    effects; edges: flow_id, src, dst, seq, out_ord.
    """
    node = F.struct("node", "depth", "label", "tags", F.transform(F.coalesce("effects", F.array()), lambda e: F.struct(*(e[c].alias(c) for c in ("type", "detail", "topic", "async")))).alias("effects"))
    whole = nodes.groupBy("flow_id").agg(F.to_json(F.collect_list(node), {"ignoreNullFields": "false"}).alias("nodes"))
    ways = edges.groupBy("flow_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(source_order(F.col("seq"), F.col("out_ord")).alias("o"), "src", "dst")))).alias("edges"))

    def walk(ns: list[dict], es: list[dict]) -> str:
        by, out = {n["node"]: n for n in ns}, {}
        for e in es:
            out.setdefault(e["src"], []).append(e["dst"])
        root = next(n["node"] for n in ns if n["depth"] == 0)
        lines, seen, path, todo = [], set(), set(), [("in", root, 0)]
        while todo:
            step, name, depth = todo.pop()
            n, pad = by[name], "  " * depth
            if step == "out":
                path.discard(name)
                continue
            if name in path:
                lines.append(f"{pad}{n['label']}  (cycle)")
                continue
            line = pad + n["label"] + "".join(f"{'  ' if i == 0 else ' '}[{t}]" for i, t in enumerate(n["tags"] or []))
            if name in seen and out.get(name):
                lines.append(f"{line}  (subtree shown above)")
                continue
            seen.add(name)
            lines.append(line)
            for e in n["effects"]:
                what = f"topic={e['topic']}" if e["type"] == "kafka" and e["topic"] else e["detail"]
                lines.append(f"{pad}  · {e['type']}: {what}" + ("  [async]" if e["async"] else ""))
            path.add(name)
            todo.append(("out", name, depth))
            todo += [("in", child, depth + 1) for child in reversed(out.get(name, []))]
        return "\n".join(lines) + "\n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees = [walk(json.loads(n), json.loads(e) if e else []) for n, e in zip(batch["nodes"], batch["edges"], strict=True)]
            yield pd.DataFrame({"flow_id": batch["flow_id"], "tree": trees})

    return whole.join(ways, "flow_id", "left").mapInPandas(run, "flow_id string, tree string")


def tree_tags(async_: Column, resolution: Column, dropped_by: Column, collapse: Column) -> Column:
    """The marks behind a node of a tree."""
    tags = F.array(
        F.when(async_, "async"),
        F.when(resolution.isin("static-multi", "dynamic", "truncated"), resolution),
        F.when(dropped_by.isNotNull(), F.concat(F.when(collapse, "collapsed: ").otherwise("dropped: "), dropped_by)),
    )
    return F.filter(tags, lambda t: t.isNotNull())
