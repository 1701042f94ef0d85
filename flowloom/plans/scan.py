"""From facts to flow documents and the index: the whole scan as one plan over all entrypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom import tables
from flowloom.functions.text import collapsed_name, file_name, trim_module
from flowloom.operators import documents, effects, entities, entrypoints, graph, guards, rules, values
from flowloom.plans import annotate
from flowloom.sources.rules import Rule, default_rules


def flow_documents(
    entry: DataFrame, sites: DataFrame, callees: DataFrame, functions: DataFrame, module: str, ruleset: list[Rule] | None = None, outcomes: DataFrame | None = None, responses: DataFrame | None = None,
    overrides: DataFrame | None = None, branches: DataFrame | None = None, blocks: DataFrame | None = None, contracts: DataFrame | None = None, fields: DataFrame | None = None,
) -> DataFrame:
    """flow_id, doc and file of all entrypoints in ``entry`` (id, kind, method, path, topic, fn_id).

    sites: caller, site, ord, seq, async, block, pos, dynamic_name and what effects.detect reads; callees: site, callee,
    callee_ord, resolution; functions: fn_id, display_name, pos_text, returns, visit, file_class and what the heuristics read. Not needed: outcomes (fn_id, ord, text: what
    functions fail with), responses (fn_id, ord, status), overrides (key, label: names for functions that end with a key), branches and blocks (annotate.FOUND and
    annotate.BLOCKS: decisions are shown), contracts (fn_id, side: request or response, type, format) and fields (fn_id, side and what guards.data_contract reads).
    """
    spark = functions.sparkSession
    if overrides is not None:
        functions = documents.label_overrides(functions, "display_name", overrides).withColumn("display_name", F.coalesce("label", "display_name")).drop("label")
    exits = spark.createDataFrame([], "fn_id string, exits array<string>") if outcomes is None else values.error_exits(outcomes, ["fn_id"])
    success = spark.createDataFrame([], "fn_id string, success string") if responses is None else guards.success_response(responses)
    said = tables.keep(functions.select("fn_id").join(exits, "fn_id", "left").join(success, "fn_id", "left"), "outcomes").withColumnRenamed("fn_id", "node")
    found = tables.keep(effects.detect(sites), "detected")
    roots = entry.select(F.col("id").alias("flow_id"), "fn_id")
    nodes, edges = graph.extract(found.withColumn("effect", F.to_json("effect")), callees, functions.select("fn_id", "visit"), roots)
    nodes, edges = tables.keep(nodes, "raw-nodes"), tables.keep(edges, "raw-edges")

    uses = found.where("effect is not null").select(F.col("caller").alias("node"), "effect.*", F.col("ord").alias("use_ord"), "pos", "async", "block")
    first = {c: F.min_by(c, "use_ord").alias(c) for c in ("topic_expr", "pos", "block")}
    kept_uses = uses.groupBy("node", "type", "detail", "topic").agg(F.min("use_ord").alias("use_ord"), F.bool_or("async").alias("async"), *first.values()).withColumn("alt", F.lit(False))
    if blocks is not None:
        at = blocks.select(F.col("fn_id").alias("node"), F.col("b").alias("block"), "pre", "post")
        kept_uses = guards.alternatives(kept_uses.drop("alt").join(at, ["node", "block"], "left"), ["node"], "use_ord")
    lists = kept_uses.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("use_ord", "type", "detail", "topic", "topic_expr", "pos", "async", "alt", "block"))).alias("effects"))
    facts = functions.withColumnRenamed("fn_id", "node").drop("visit")
    whole = nodes.join(facts, "node", "left").join(lists, "node", "left")
    has = F.coalesce(F.size("effects") > 0, F.lit(False))
    whole = whole.withColumns(
        {
            "name": F.coalesce("display_name", "node"), "has_effects": has, "kept": has | (F.col("resolution") == "dynamic") | (F.col("depth") == 0), "dropped_by": graph.class_mark(F.col("file_class")), "gate": F.lit(False),
            "inline_name": F.coalesce(collapsed_name(F.col("pkg"), F.col("short_name")), trim_module(F.coalesce("display_name", "node"), F.lit(module))),
        }
    )
    ordered = edges.withColumns({"ord": F.col("seq").cast("int"), "kind": F.lit(None).cast("string"), "label": F.lit(None).cast("string"), "seq": F.col("seq").cast("long")})
    marked = tables.keep(rules.mark(whole, ordered, default_rules() if ruleset is None else ruleset, module), "marked")
    badges = None
    if branches is not None and blocks is not None:
        shown = annotate.annotate(marked, ordered, branches, blocks)
        marked, badges = shown.nodes, shown.badges
        ordered = shown.edges.withColumn("ord", F.col("seq"))
    pruned = tables.keep(rules.prune(marked, ordered), "pruned")

    left = pruned.select("flow_id", F.explode("nodes").alias("n")).select("flow_id", "n.node", "n.collapsed", "n.effects")
    ways = pruned.select("flow_id", F.explode("edges").alias("e")).select("flow_id", "e.*").withColumnRenamed("ord", "out_ord")
    roots = roots.select("flow_id", F.col("fn_id").alias("node"))
    ids = tables.keep(documents.node_ids(ways, roots, ["flow_id"]), "ids")
    cards = [c for c in annotate.SHOWN if c in marked.columns]
    described = left.join(ids, ["flow_id", "node"]).join(marked.select("flow_id", "node", "name", "pkg", "pos_text", "kind", "resolution", "returns", *cards), ["flow_id", "node"]).join(said, "node", "left")
    none = F.array().cast("array<string>")
    if badges is not None:
        described = described.join(badges, ["flow_id", "node"], "left").withColumn("exits", annotate.exits_left(F.coalesce("exits", none), F.col("claimed")))
        cards += ["fallible", "checks_overflow"]
    body = described.where("bfs_ord > 0").select("flow_id", "id", F.col("bfs_ord").alias("ord"), "name", F.coalesce("pkg", F.lit("")).alias("pkg"), F.col("pos_text").alias("pos"), "kind", "resolution", F.lit(False).alias("async"), "collapsed", "effects", F.coalesce("exits", none).alias("error_exits"), "returns", *cards)
    to = ids.select("flow_id", F.col("node").alias("dst"), F.col("id").alias("to_id"))
    place = F.struct("bfs_ord", documents.source_order(F.col("seq"), F.col("out_ord")))
    lines = ways.join(ids.select("flow_id", F.col("node").alias("src"), F.col("id").alias("from_id"), "bfs_ord"), ["flow_id", "src"]).join(to, ["flow_id", "dst"]).select("flow_id", place.alias("ord"), "from_id", "to_id", "async", "kind", "label")
    counts = pruned.select("flow_id", F.explode("dropped").alias("dropped_by", "n"))
    raw = nodes.groupBy("flow_id").agg(F.count_if(F.col("depth") > 0).cast("int").alias("raw_nodes"))
    own = described.where("bfs_ord = 0").select("flow_id", F.col("name").alias("func"), F.col("pos_text").alias("flow_pos"), F.col("effects").alias("flow_effects"), F.col("returns").alias("flow_returns"), F.coalesce("exits", none).alias("flow_exits"), "success")
    flows = entry.select(F.col("id").alias("flow_id"), F.col("kind").alias("flow_kind"), "method", "path", "topic").join(own, "flow_id").join(raw, "flow_id")
    if contracts is not None and fields is not None:
        flows = _with_contracts(flows, entry.select(F.col("id").alias("flow_id"), "fn_id"), contracts, fields)
    return documents.flow_documents(flows, body, lines, counts, module)


def _with_contracts(flows: DataFrame, roots: DataFrame, contracts: DataFrame, fields: DataFrame) -> DataFrame:
    """flows with request and response (type, format, fields, truncated) of the function at the root."""
    held = contracts.join(guards.data_contract(fields, ["fn_id", "side"]), ["fn_id", "side"], "left").join(roots, "fn_id")
    one = F.struct("type", F.nullif("format", F.lit("")).alias("format"), "fields", F.when(F.col("truncated"), True).alias("truncated"))
    sides = {side: F.first(F.when(F.col("side") == side, one), ignorenulls=True).alias(side) for side in ("request", "response")}
    return flows.join(held.groupBy("flow_id").agg(*sides.values()), "flow_id", "left")


_EFFECTS = "array<struct<type:string,detail:string,topic:string>>"
_DOC = f"struct<entrypoint:struct<id:string,kind:string,method:string,path:string,topic:string,func:string,effects:{_EFFECTS}>,nodes:array<struct<effects:{_EFFECTS}>>>"


def index_of(docs: DataFrame, merge: DataFrame, names: DataFrame, module: str) -> DataFrame:
    """The index document of flow documents (flow_id, doc), read back from their JSON."""
    read = docs.select("flow_id", F.from_json("doc", _DOC).alias("d"))
    flows = read.select("flow_id", "d.entrypoint.kind", "d.entrypoint.method", "d.entrypoint.path", "d.entrypoint.topic", "d.entrypoint.func", F.concat(file_name(F.col("flow_id")), F.lit(".json")).alias("file"))
    none = F.from_json(F.lit("[]"), _EFFECTS)
    every = F.concat(F.coalesce("d.entrypoint.effects", none), F.flatten(F.transform(F.coalesce("d.nodes", F.array()), lambda n: F.coalesce(n["effects"], none))))
    return entities.index_document(flows, read.select("flow_id", F.explode(every).alias("e")).select("flow_id", "e.*"), merge, names, module)


_RESULT = "struct<pkg:string,type:string,is_error:boolean,is_bool:boolean>"
_TYPED = "type_pkg string, type_name string, method string, fn_id string"
#: Tables of a folder that can be scanned, as Parquet or JSON lines; the first three are needed.
TABLES = {
    "function": "fn_id string, display_name string, short_name string, pkg string, pos int, pos_text string, returns string, visit boolean, file_class string, recv_type string, recv_chain array<string>, parent_fn string, "
    f"params array<struct<pkg:string,type:string>>, results array<{_RESULT}>, n_blocks int, n_instrs int, n_calls int, n_control int, n_invoke int, n_module_calls int, n_unknown_calls int, call_pkgs array<string>, has_recv boolean, "
    "in_module boolean, has_body boolean",
    "site": "caller string, site string, ord int, seq int, async boolean, block int, pos string, dynamic_name string, callee_pkg string, callee_type string, callee_name string, "
    "text_args array<struct<is_string:boolean,value:string,template:string>>, topic string, topic_source string",
    "callee": "site string, callee string, callee_ord int, resolution string",
    "entrypoint": "id string, kind string, method string, path string, topic string, fn_id string",
    "registration": f"encl_fn string, site string, pos int, callee_pkg string, callee_type string, callee_name string, is_static boolean, args array<{entrypoints.ARG}>, reader_topic string, iface_pkg string, iface_name string",
    "method": _TYPED,
    "interface": "iface_pkg string, iface_name string, method string, exported boolean",
    "callback": "fn_id string, outer_fn string, prefix string",
    "chain": "site string, path string, methods string, resolved boolean",
    "forward": "site string, methods string",
    "prefix": "site string, prefix string",
    "outcome": "fn_id string, ord int, text string",
    "response": "fn_id string, ord int, status int",
    "override": "key string, label string",
    "branch": annotate.FOUND,
    "block": annotate.BLOCKS,
    "contract": "fn_id string, side string, type string, format string",
    "field": "fn_id string, side string, ord int, name string, tag string, type string, exported boolean, embedded_struct boolean, rules string",
    "merge": "target string, satellite string",
    "entity_name": "key string, name string",
}
NEEDED = ["function", "site", "callee"]


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder by name, those that are not there empty; needed ones raise."""
    found = {}
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, schema in TABLES.items():
        there = [fmt for fmt in ("parquet", "json") if system.exists(at(f"{folder}/{name}.{fmt}"))]
        if not there and name in NEEDED:
            raise FileNotFoundError(f"{folder}/{name}.parquet or {name}.json")
        found[name] = spark.read.schema(schema).format(there[0]).load(f"{folder}/{name}.{there[0]}") if there else spark.createDataFrame([], schema)
    return found


def entrypoints_of(t: dict[str, DataFrame], module: str) -> DataFrame:
    """The entrypoints that are given, and those that registrations tell."""
    found = entrypoints.discover(t["registration"], t["function"], t["method"], t["interface"], t["callback"], t["chain"], t["forward"], t["prefix"], module)
    given = t["entrypoint"]
    return given.unionByName(found.select(given.columns).join(given.select("id"), "id", "left_anti"))


def scan(t: dict[str, DataFrame], module: str, ruleset: list[Rule] | None = None, entry: DataFrame | None = None) -> DataFrame:
    """Documents of all entrypoints of the tables ``t`` (see TABLES), or of those in ``entry``."""
    entry = tables.keep(entrypoints_of(t, module) if entry is None else entry, "entrypoints")
    return flow_documents(
        entry, t["site"], t["callee"], t["function"], module, ruleset, outcomes=t["outcome"], responses=t["response"], overrides=t["override"], branches=t["branch"], blocks=t["block"],
        contracts=t["contract"], fields=t["field"],
    )


def example(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Documents and index of a program of five functions, to show what facts look like."""
    module = "example.com/shop"
    result = "array<struct<pkg:string,type:string,is_error:boolean,is_bool:boolean>>"
    fn = lambda i, pkg, name, blocks, calls: (i, f"{pkg}.{name}", name, pkg, f"{i}.go:1", "", True, "normal", None, [], None, [], [], blocks, 20, calls, 1 if blocks > 1 else 0, 0, calls, 0, [pkg], False)
    functions = spark.createDataFrame(
        [fn("h", f"{module}/api", "Handle", 3, 2), fn("c", f"{module}/order", "Create", 4, 3), fn("w", f"{module}/order", "forward", 1, 1), fn("s", f"{module}/order", "Save", 3, 1), fn("l", f"{module}/logger", "Write", 2, 0)],
        "fn_id string, display_name string, short_name string, pkg string, pos_text string, returns string, visit boolean, file_class string, recv_type string, recv_chain array<string>, parent_fn string, params array<struct<pkg:string,type:string>>, "
        f"results {result}, n_blocks int, n_instrs int, n_calls int, n_control int, n_invoke int, n_module_calls int, n_unknown_calls int, call_pkgs array<string>, has_recv boolean",
    )
    call = lambda caller, site, n, pos: (caller, site, n, n, False, 0, pos, None, None, None, None, [], None, None)
    query = ("s", "s5", 1, 1, False, 0, "o.go:7", None, "database/sql", "DB", "Exec", [(True, "INSERT INTO  orders VALUES (1)", None)], None, None)
    sites = spark.createDataFrame(
        [call("h", "s1", 1, "h.go:2"), call("h", "s2", 2, "h.go:3"), call("c", "s3", 1, "c.go:2"), call("w", "s4", 1, "w.go:2"), query],
        "caller string, site string, ord int, seq int, async boolean, block int, pos string, dynamic_name string, callee_pkg string, callee_type string, callee_name string, text_args array<struct<is_string:boolean,value:string,template:string>>, topic string, topic_source string",
    )
    callees = spark.createDataFrame([("s1", "l", 1, "static"), ("s2", "c", 1, "static"), ("s3", "w", 1, "static"), ("s4", "s", 1, "static")], "site string, callee string, callee_ord int, resolution string")
    entry = spark.createDataFrame([("http:POST:/orders", "http", "POST", "/orders", None, "h")], "id string, kind string, method string, path string, topic string, fn_id string")
    docs = tables.keep(flow_documents(entry, sites, callees, functions, module), "documents")
    nothing = spark.createDataFrame([], "target string, satellite string"), spark.createDataFrame([], "key string, name string")
    return docs, index_of(docs, *nothing, module)
