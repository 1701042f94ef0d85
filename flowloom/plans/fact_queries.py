"""Registered queries over derived facts: discovery, call graphs, guards, values and documents.

As in :mod:`flowloom.plans.queries`, rows of the given tables stand in for functions, call sites and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom import tables
from flowloom.functions import predicates, text
from flowloom.operators import documents, effects, entrypoints, graph, guards, rules, values
from flowloom.plans import annotate
from flowloom.plans.queries import K, _k, _t, query
from flowloom.sources import facts

M = "example.com/shop"
#: The place of a line in its order; line numbers repeat.
_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
_LINES = f"(SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag || l_linestatus AS flags, CAST({_NTH} AS INT) AS n FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.concat("l_returnflag", "l_linestatus").alias("flags")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", flags, F.expr(_NTH).cast("int").alias("n"))

# ---------------------------------------------------------------- entrypoints

#: What a part registers, by its number.
_REG = {
    "pkg": "CASE k WHEN 0 THEN 'net/http' WHEN 1 THEN 'net/http' WHEN 2 THEN 'github.com/gin-gonic/gin' WHEN 3 THEN 'github.com/labstack/echo/v4' WHEN 4 THEN 'github.com/go-chi/chi/v5' WHEN 5 THEN 'github.com/gofiber/fiber/v2' WHEN 6 THEN 'github.com/gofiber/fiber/v3' WHEN 7 THEN 'github.com/segmentio/kafka-go' WHEN 8 THEN 'github.com/confluentinc/confluent-kafka-go/kafka' WHEN 9 THEN 'github.com/IBM/sarama' WHEN 10 THEN 'example.com/shop/pb' WHEN 11 THEN 'github.com/gorilla/mux' ELSE 'example.com/other' END",
    "type": "CASE k WHEN 0 THEN '' WHEN 1 THEN 'ServeMux' WHEN 2 THEN 'RouterGroup' WHEN 3 THEN 'Echo' WHEN 4 THEN 'Mux' WHEN 5 THEN 'App' WHEN 6 THEN 'Group' WHEN 7 THEN 'Reader' WHEN 8 THEN 'Consumer' WHEN 9 THEN 'ConsumerGroup' WHEN 10 THEN '' WHEN 11 THEN 'Router' ELSE 'Router' END",
    "name": "CASE k WHEN 0 THEN 'HandleFunc' WHEN 1 THEN 'Handle' WHEN 2 THEN 'PUT' WHEN 3 THEN 'Any' WHEN 4 THEN 'Post' WHEN 5 THEN 'Get' WHEN 6 THEN 'All' WHEN 7 THEN 'FetchMessage' WHEN 8 THEN 'Poll' WHEN 9 THEN 'Consume' WHEN 10 THEN 'RegisterStockServer' WHEN 11 THEN 'HandleFunc' ELSE 'GET' END",
    "path": "CASE WHEN k = 0 THEN 'POST /p' || n ELSE '/p' || n || '/:id' END",
}


@query(f"""
WITH p AS (SELECT p_partkey, p_partkey % 13 AS k, p_size % 20 AS n FROM part),
r AS (SELECT *, {_REG["path"]} AS path, p_partkey % 97 AS f FROM p),
x AS (
  SELECT p_partkey, CASE WHEN k IN (7, 8, 9) THEN 'kafka' WHEN k = 10 THEN 'grpc' ELSE 'http' END AS kind,
    CASE k WHEN 0 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 4 THEN 'POST' WHEN 5 THEN 'GET' WHEN 10 THEN 'Get' WHEN 11 THEN 'PUT,PATCH' WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE '' END AS method,
    CASE k WHEN 0 THEN '/p' || n WHEN 1 THEN path WHEN 4 THEN '/v1' || path WHEN 5 THEN '/api/p' || n || '/{{id}}' WHEN 6 THEN '/p' || n || '/{{id}}' WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN 'Stock/Get' WHEN 11 THEN '/shop' || path ELSE '/p' || n || '/{{id}}' END AS path,
    CASE k WHEN 7 THEN 't' || n WHEN 9 THEN 'a,b' || n END AS topic,
    CASE WHEN k IN (7, 8) THEN 'e' WHEN k = 9 THEN 'claim' WHEN k = 10 THEN 'get' WHEN k = 1 THEN 'serve' WHEN k = 6 THEN 'first' ELSE 'f' || f END AS fn_id
  FROM r WHERE k < 12),
d AS (SELECT DISTINCT kind, method, path, topic, fn_id FROM x),
i AS (SELECT *, CASE kind WHEN 'grpc' THEN 'grpc:' || path WHEN 'kafka' THEN 'kafka:' || coalesce(topic, '?') || ':' || fn_id ELSE 'http:' || CASE WHEN method = '' THEN 'ANY' ELSE method END || ':' || path END AS base,
  CASE fn_id WHEN 'e' THEN 1001 WHEN 'claim' THEN 1002 WHEN 'get' THEN 1003 WHEN 'serve' THEN 1004 WHEN 'first' THEN 1005 ELSE CAST(substr(fn_id, 2) AS INT) END AS pos FROM d),
j AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos, fn_id) AS nth FROM i)
SELECT base || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS id, kind, method, path, topic, fn_id FROM j""")
def q47_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts register handlers with twelve libraries; groups, chains and callbacks give prefixes."""
    p = _t(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 13 AS k", "p_size % 20 AS n")
    p = p.withColumns({c: F.expr(v) for c, v in _REG.items()})
    none, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    own = F.concat(F.lit("f"), (F.col("p_partkey") % 97).cast("string"))

    def arg(text=none, all_=texts, fn=none, fns=texts, pkg=none, type_=none):
        return F.struct(text.alias("text"), all_.alias("texts"), fn.alias("fn"), fns.alias("fns"), pkg.alias("type_pkg"), type_.alias("type_name")).cast(entrypoints.ARG)

    handler = arg(fn=own, fns=F.array(own))
    several = arg(fn=own, fns=F.array(F.lit("middle"), own))
    typed = lambda name: arg(pkg=F.lit(M), type_=F.lit(name))
    path = arg(F.col("path"))
    args = (
        F.when(F.col("k") == 1, F.array(path, typed("Server"))).when(F.col("k") == 2, F.array(path, several)).when(F.col("k") == 6, F.array(path, arg(fn=F.lit("first")), handler))
        .when(F.col("k").isin(7, 8), F.array().cast(f"array<{entrypoints.ARG}>")).when(F.col("k") == 9, F.array(arg(), arg(all_=F.array(F.lit("a"), F.concat(F.lit("b"), F.col("n").cast("string")))), typed("Group")))
        .when(F.col("k") == 10, F.array(arg(), typed("Stock"))).otherwise(F.array(path, handler))
    )
    site = F.col("p_partkey").cast("string")
    sites = p.select(
        F.when(F.col("k") == 4, "inner").otherwise("e").alias("encl_fn"), site.alias("site"), F.col("p_partkey").alias("pos"), F.col("pkg").alias("callee_pkg"), F.col("type").alias("callee_type"), F.col("name").alias("callee_name"),
        F.lit(True).alias("is_static"), args.alias("args"), F.concat(F.lit("t"), F.col("n").cast("string")).alias("reader_topic"), F.lit(f"{M}/pb").alias("iface_pkg"), F.lit("StockServer").alias("iface_name"),
    )
    named = spark.createDataFrame([("e", 1001), ("claim", 1002), ("get", 1003), ("serve", 1004), ("first", 1005), ("inner", 1006)] + [(f"f{i}", i) for i in range(97)], "fn_id string, pos int")
    functions = named.withColumns({"display_name": F.col("fn_id"), "file_class": F.lit("normal"), "in_module": F.lit(True), "has_body": F.lit(True)})
    methods = spark.createDataFrame([(M, "Server", "ServeHTTP", "serve"), (M, "Group", "ConsumeClaim", "claim"), (M, "Stock", "Get", "get"), (M, "Stock", "hidden", "e")], "type_pkg string, type_name string, method string, fn_id string")
    interfaces = spark.createDataFrame([(f"{M}/pb", "StockServer", "Get", True), (f"{M}/pb", "StockServer", "hidden", False)], "iface_pkg string, iface_name string, method string, exported boolean")
    callbacks = spark.createDataFrame([("inner", "e", "/v1")], "fn_id string, outer_fn string, prefix string")
    shop = p.where("k = 11").select(site.alias("site"))
    links = spark.createDataFrame([("sub", "pre", "plain", None), ("pre", "put", "prefix", "/shop"), ("put", None, "methods", "PUT,PATCH")], "at string, next string, kind string, text string")
    chains = entrypoints.fold_chain(links, shop.withColumn("at", F.lit("sub")), entrypoints.GORILLA_HOPS)
    forward = spark.createDataFrame([], "site string, methods string")
    router = spark.createDataFrame([("api", "app", entrypoints.FIBER + "/v2", "Group", "/api")], "at string, next string, callee_pkg string, callee_name string, p string")
    calls = router.withColumn("args", F.array(arg(F.col("p")))).drop("p")
    nothing = spark.createDataFrame([], "at string, next string, text string")
    prefixes = entrypoints.fiber_prefixes(entrypoints.fiber_links(calls, nothing.drop("text"), nothing), p.where("k = 5").select(site.alias("site"), F.lit("api").alias("at")))
    found = entrypoints.discover(sites, functions, methods, interfaces, callbacks, chains, forward, prefixes, M)
    return found.select("id", "kind", "method", "path", "topic", "fn_id")


@query("SELECT 'o' || l_orderkey AS callee, 's' || min(l_suppkey % 3) AS site FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey % 3) = 1")
def q48_single_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("callee"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("site")).distinct()
    return entrypoints.callers(sites)


# ---------------------------------------------------------------- call graphs


@query("""
WITH m AS (SELECT DISTINCT l_suppkey % 200 AS t, l_linenumber AS method FROM lineitem WHERE l_linenumber <= 3 UNION SELECT DISTINCT l_suppkey % 200, 4 FROM lineitem WHERE l_quantity > 48),
i AS (SELECT * FROM (VALUES ('A', 1), ('A', 2), ('B', 3), ('B', 4), ('C', 4)) v(iface, method)),
fits AS (SELECT iface, t FROM i JOIN m USING (method) GROUP BY iface, t HAVING count(*) = (SELECT count(*) FROM i j WHERE j.iface = i.iface)),
c AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS iface, CASE o_custkey % 4 WHEN 0 THEN 2 ELSE 4 END AS method, o_custkey FROM orders)
SELECT o_orderkey AS site, count(*) AS n, min(callee) AS lo, max(callee) AS hi FROM (
  SELECT o_orderkey, 'fn' || o_custkey AS callee FROM c WHERE iface IS NULL
  UNION SELECT o_orderkey, t || '.' || method FROM c JOIN fits USING (iface)) GROUP BY o_orderkey""")
def q49_class_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are call sites, suppliers types whose methods are the line numbers they deliver."""
    lines = _t(spark, sf_dir, "lineitem")
    type_ = (F.col("l_suppkey") % 200).cast("string")
    have = lines.where("l_linenumber <= 3").select(type_.alias("t"), F.col("l_linenumber").cast("string").alias("method")).union(lines.where("l_quantity > 48").select(type_, F.lit("4"))).distinct()
    methods = have.select(F.lit("m").alias("type_pkg"), F.col("t").alias("type_name"), "method", F.concat_ws(".", "t", "method").alias("fn_id"))
    interfaces = spark.createDataFrame([("m", i, m) for i, m in (("A", "1"), ("A", "2"), ("B", "3"), ("B", "4"), ("C", "4"))], "iface_pkg string, iface_name string, method string")
    kind = F.col("o_custkey") % 4
    sites = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("site"), F.when(kind == 3, "static").otherwise("invoke").alias("mode"), F.when(kind == 3, F.concat(F.lit("fn"), F.col("o_custkey").cast("string"))).alias("callee_fn"), F.lit("m").alias("callee_pkg"),
        F.when(kind == 0, "A").when(kind == 1, "B").otherwise("C").alias("callee_type"), F.when(kind == 0, "2").otherwise("4").alias("callee_name"),
    )
    found = graph.class_hierarchy(sites, methods, interfaces)
    return found.groupBy("site").agg(F.count("*").alias("n"), F.min("callee").alias("lo"), F.max("callee").alias("hi"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_type, {K} AS k, lag({K}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
f AS (SELECT DISTINCT user_id % 20 AS u, before AS src, k AS dst FROM e WHERE before % 10 = k % 10),
s AS (SELECT DISTINCT user_id % 20 AS u, k AS value, event_type AS t FROM e WHERE k < 10),
r(u, value, t) AS (SELECT * FROM s UNION SELECT r.u, f.dst, r.t FROM r JOIN f ON f.u = r.u AND f.src = r.value)
SELECT u || ':' || value AS value, t AS type FROM r""")
def q50_type_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of events are values; a number flows to the next of its user if both end alike."""
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "events").select("user_id", "event_type", _k().alias("k"), F.lag(_k()).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    at = lambda c: F.concat_ws(":", (F.col("user_id") % 20).cast("string"), F.col(c).cast("string"))
    flows = e.where("before % 10 = k % 10").select(at("before").alias("src"), at("k").alias("dst"))
    return graph.type_flow(flows, e.where("k < 10").select(at("k").alias("value"), F.col("event_type").alias("type")))


@query("""
WITH c AS (SELECT o_orderkey AS site, o_custkey % 7 AS t FROM orders), k AS (SELECT site, t, unnest([0, 1, 2, 3, 4]) AS callee FROM c)
SELECT site, 'm' || callee AS callee FROM k WHERE site % 3 = 0 OR t % 5 = callee OR (t = 6 AND callee = 0)""")
def q51_refine_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site may call five methods; two of three are interface calls, where the type that flows there tells."""
    sites = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), (F.col("o_custkey") % 7).alias("t"))
    coarse = sites.select("site", F.explode(F.array(*(F.lit(f"m{i}") for i in range(5)))).alias("callee"))
    receivers = sites.where("site % 3 > 0").select("site", F.col("t").alias("value"))
    types = sites.select(F.col("t").alias("value"), F.concat(F.lit("T"), (F.col("t") % 5).cast("string")).alias("type")).distinct()
    more = spark.createDataFrame([(6, "T0")], "value int, type string").select(F.col("value").cast(types.schema["value"].dataType), "type")
    methods = spark.createDataFrame([(f"m{i}", f"T{i}") for i in range(5)], "fn_id string, type string")
    return graph.refine_calls(coarse, receivers, types.union(more), methods)


@query("""
WITH e AS (SELECT DISTINCT o_custkey % 50 AS src, 1000 + l_partkey % 300 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT DISTINCT 1000 + p_partkey % 300, 2000 + p_size FROM part),
l AS (SELECT * FROM e WHERE src % 9 > 0 AND dst % 9 > 0)
SELECT node FROM (SELECT 1 AS node UNION SELECT a.dst FROM l a WHERE a.src = 1 UNION SELECT b.dst FROM l a JOIN l b ON b.src = a.dst WHERE a.src = 1)""")
def q52_kept_after_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    first = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select((F.col("o_custkey") % 50).cast("long").alias("src"), (1000 + F.col("l_partkey") % 300).cast("long").alias("dst"))
    second = _t(spark, sf_dir, "part").select((1000 + F.col("p_partkey") % 300).cast("long"), (2000 + F.col("p_size")).cast("long"))
    edges = first.union(second).distinct()
    dropped = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node % 9 = 0").distinct()
    return rules.kept_after_drop(edges, dropped, spark.range(1, 2).select(F.col("id").alias("node"))).select("node")


@query("""
SELECT fn AS fn_id, CASE k % 4 WHEN 0 THEN 'decl' || k WHEN 1 THEN 'orig' || k % 7 ELSE fn END AS canonical, CASE WHEN k % 6 = 0 THEN 'generated' WHEN k % 6 = 1 THEN 'vendor' ELSE 'normal' END AS file_class,
  CASE WHEN k % 6 = 0 THEN 'excluded:generated-file' WHEN k % 6 = 1 THEN 'excluded:vendor' END AS mark, k % 5 < 3 AS in_module, k % 2 = 0 AND k % 5 < 3 AS visit, 'f' || k % 6 || '.go:' || k AS pos, k % 3 = 0 AS handler, k % 7 = 0 AS skipped
FROM (SELECT p_partkey AS k, 'fn' || p_partkey AS fn FROM part)""")
def q53_function_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of a function: the declared one, class of its file, membership, position, shape."""
    k = F.col("p_partkey")
    made = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    pkg = made(f"{M}/p", k % 5)
    param = F.struct(F.lit("net/http").alias("pkg"), F.when(k % 3 == 0, "ResponseWriter").otherwise("Writer").alias("type"))
    request = F.struct(F.lit("net/http").alias("pkg"), F.lit("*Request").alias("type"))
    functions = _t(spark, sf_dir, "part").select(
        made("fn", k).alias("fn_id"), F.when(k % 4 == 0, made("decl", k)).alias("declared_fn"), F.when(k % 4 <= 1, made("orig", k % 7)).alias("origin_fn"), pkg.alias("pkg"), F.concat(made("f", k % 6), F.lit(".go")).alias("file"),
        k.alias("line"), (k % 2 == 0).alias("has_body"), F.array(param, request).alias("params"), F.when(k % 7 == 0, "invoke").otherwise("static").alias("mode"),
    )
    files = spark.createDataFrame([(f"f{i}.go", c) for i, c in enumerate(["generated", "vendor", "normal", "normal", "normal"])], "file string, class string")
    mods = spark.createDataFrame([(f"{M}/p{i}",) for i in (0, 1, 2, 2)], "pkg string")
    rows = facts.module_functions(facts.function_classes(functions, files), mods).join(graph.canonical(functions), "fn_id")
    return rows.select(
        "fn_id", "canonical", "file_class", graph.class_mark(F.col("file_class")).alias("mark"), "in_module", predicates.worth_visiting().alias("visit"), text.position(F.col("file"), F.col("line")).alias("pos"),
        predicates.handler_shaped().alias("handler"), graph.skipped_site(F.col("mode"), F.lit(None).cast("string"), F.lit("error")).alias("skipped"),
    )


# ---------------------------------------------------------------- values


@query(f"""
WITH e AS (SELECT l_orderkey, n, CASE WHEN l_partkey % 8 > 0 THEN flags END AS t FROM {_LINES})
SELECT l_orderkey AS pack_id, list(t ORDER BY n) AS texts FROM e GROUP BY l_orderkey HAVING count(t) = count(*)""")
def q54_pack_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a list of the flags of its lines, where all are constants."""
    lines = _lines(spark, sf_dir).withColumn("val_id", F.concat_ws("-", "l_orderkey", "n"))
    elements = lines.select(F.col("l_orderkey").alias("pack_id"), F.col("n").alias("idx"), "val_id")
    constants = lines.where("l_partkey % 8 > 0").select(F.col("val_id").alias("value_id"), F.col("flags").alias("text"))
    return values.pack_strings(elements, constants)


@query(f"""
SELECT l_orderkey AS alloc_id, flags AS field, CAST(min(l_partkey) AS VARCHAR) AS text FROM {_LINES} GROUP BY l_orderkey, flags HAVING count(*) = 1 AND min(l_partkey) % 4 > 0""")
def q55_struct_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    constants = lines.where("l_partkey % 4 > 0").select(F.col("l_partkey").alias("value_id"), F.col("l_partkey").cast("string").alias("text")).distinct()
    return values.struct_field_strings(lines.select(F.col("l_orderkey").alias("alloc_id"), F.col("flags").alias("field"), F.col("l_partkey").alias("val_id")), constants)


# ---------------------------------------------------------------- guards


@query(f"""
WITH e AS (SELECT event_id AS id, {K} AS k, event_type AS t, CAST(floor(value) AS INT) % 6 AS s FROM events)
SELECT id, CASE WHEN t = 'error' THEN 'sentinel' WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN 'sentinel' ELSE 'unknown' END ELSE 'message' END AS kind,
  CASE WHEN t = 'error' THEN 'ErrA' || k WHEN k % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN 'ErrLast' ELSE 'error' END ELSE '"no row ' || k || ': %w"' END AS display,
  CASE s WHEN 4 THEN 'HTTP 404 · gone' WHEN 5 THEN 'HTTP 503 (Load failed)' END AS rejected, CASE s WHEN 0 THEN '200' WHEN 1 THEN '201 Created' WHEN 2 THEN '204 No Content' WHEN 3 THEN '302' WHEN 4 THEN '404' ELSE '503' END AS success,
  k % 2 = 0 AND (s < 2 OR (s < 4 AND k % 3 = 0)) AS mechanical FROM e""")
def q56_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who an exit is, what a rejection and a success say, and which checks only pass an error on."""
    k, s = F.col("k"), F.col("s")
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _k().alias("k"), F.col("event_type").alias("t"), (F.floor("value").cast("int") % 6).alias("s"))
    named = F.when(F.col("t") == "error", F.concat(F.lit("ErrA"), k.cast("string")))
    message = F.when(k % 4 == 0, ": %w").otherwise(F.concat(F.lit("no row "), k.cast("string"), F.lit(": %w")))
    x = guards.exit_identity(named, message, F.when(k % 3 == 0, "ErrLast"))
    status = F.element_at(F.array(*map(F.lit, (200, 201, 204, 302, 404, 503))), s + 1)
    pkg, name = F.when(k % 3 == 0, "fmt").otherwise("log"), F.lit("Errorf")
    return e.withColumn("x", x).select(
        "id", "x.kind", guards.exit_display(F.col("x")).alias("display"), guards.rejection(status, F.when(s == 4, "gone"), F.when(s == 5, "Load")).alias("rejected"), guards.success_text(status).alias("success"),
        guards.is_mechanical(k % 2 == 0, F.lit(True), F.when(s < 2, "bare").when(s < 4, "call").otherwise("new"), pkg, name).alias("mechanical"),
    )


@query(f"""
WITH i AS (SELECT l_orderkey AS f, n, l_partkey % 3 AS e FROM {_LINES})
SELECT f AS fn_id, n AS b, CASE e WHEN 0 THEN true WHEN 1 THEN false END AS fail_when, CASE WHEN e = 0 THEN 'then' WHEN e = 1 THEN 'else' END AS exit, e = 2 AS gate FROM i""")
def q57_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are functions, their lines branches: the then side, the else side, or none ends after one or two blocks in a row."""
    e = F.col("l_partkey") % 3
    i = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("fn_id"), "n", e.alias("e"), (F.col("l_quantity") > 25).alias("two"))
    at = lambda k: F.col("n") * 10 + k
    none = F.array().cast("array<int>")
    ifs = i.select("fn_id", F.col("n").alias("b"), at(1).alias("then_b"), at(2).alias("else_b"), F.col("n").alias("stmt_pos"), F.col("n").alias("order_pos"), F.lit("x").alias("cond_text"))
    # a block goes on to the next but one if the way is two blocks long
    ahead = i.select("fn_id", F.explode(F.array(*(F.struct(at(k).cast("int").alias("b"), F.when(F.col("two"), F.array(at(k + 2).cast("int"))).otherwise(none).alias("succs")) for k in (1, 2)))).alias("x")).select("fn_id", "x.*")
    last = F.when(F.col("e") == 0, at(1)).otherwise(at(2)) + F.when(F.col("two"), 2).otherwise(0)
    name = F.when(F.col("e") == 0, "then").otherwise("else")
    ends = i.where("e < 2").select("fn_id", last.alias("b"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("name"), name.alias("message"), F.col("n").alias("pos"), F.lit(False).alias("tail"))
    found = guards.guards(ifs, ahead, ends)
    return found.select("fn_id", "b", "fail_when", F.col("exit.message").alias("exit"), "gate")


@query(f"""
WITH l AS (SELECT l_orderkey AS k, n, l_partkey % 6 AS m FROM {_LINES}), a AS (SELECT k, n - 1 AS depth, m FROM l),
u AS (SELECT k, m, min(depth) AS d FROM a WHERE m < 4 GROUP BY k, m), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM u)
SELECT k AS key, list('fn' || m ORDER BY i) AS uses FROM r WHERE i <= 3 AND d < 4 GROUP BY k""")
def q58_condition_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition of an order is fed by its lines, one behind the other; some are calls."""
    l = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), "n", (F.col("l_partkey") % 6).alias("m"))  # noqa: E741
    at = lambda n: F.concat_ws("-", F.col("k").cast("string"), n.cast("string"))
    starts = l.select(F.col("k").alias("key"), at(F.lit(1)).alias("at")).distinct()
    operands = l.select(at(F.col("n")).alias("at"), at(F.col("n") + 1).alias("next"), F.lit(0).alias("ord"))
    calls = l.where("m < 4").select(at(F.col("n")).alias("at"), F.concat(F.lit("fn"), F.col("m").cast("string")).alias("name"))
    return guards.condition_uses(starts, operands, calls)


@query(f"""
WITH d AS (SELECT l_orderkey AS f, n, l_partkey % 3 = 0 AS gate, l_quantity > 25 AS fail_when, l_partkey % 7 < 3 AS shown FROM {_LINES}),
c AS (SELECT f, 'd' || n AS dst, n, last_value(CASE WHEN NOT gate THEN 'd' || n END IGNORE NULLS) OVER w AS src, last_value(CASE WHEN NOT gate THEN NOT fail_when END IGNORE NULLS) OVER w AS label FROM d WHERE shown
  WINDOW w AS (PARTITION BY f ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT c.f, 'call' || c.n AS dst, arg_max(d.n, d.n) AS n, arg_max(d.gate, d.n) AS gate, arg_max(d.fail_when, d.n) AS fail_when FROM d c JOIN d ON d.f = c.f AND d.shown AND d.n <= c.n GROUP BY c.f, c.n)
SELECT f AS fn_id, src, dst, CASE WHEN src IS NOT NULL THEN 'pass' END AS kind, CAST(label AS VARCHAR) AS label FROM c
UNION ALL SELECT f, 'd' || n, dst, 'pass', CASE WHEN NOT gate THEN CAST(NOT fail_when AS VARCHAR) END FROM t""")
def q59_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are decisions of their order, each dominating what comes behind, and calls behind them."""
    l = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("fn_id"), F.col("n").alias("ord"), (F.col("l_partkey") % 3 == 0).alias("gate"), (F.col("l_quantity") > 25).alias("fail_when"), (F.col("l_partkey") % 7 < 3).alias("shown"))  # noqa: E741
    none = F.lit(None).cast("int")
    chosen = l.where("shown").select("fn_id", F.concat(F.lit("d"), F.col("ord").cast("string")).alias("decision"), "ord", "gate", F.lit(False).alias("branch"), "fail_when", F.col("ord").alias("pre"), (-F.col("ord")).alias("post"), none.alias("skip_pre"), none.alias("skip_post"))
    calls = l.select("fn_id", F.concat(F.lit("call"), F.col("ord").cast("string")).alias("call"), F.col("ord").alias("b_pre"), (-F.col("ord")).alias("b_post"))
    chain, targets = guards.attach(chosen, calls, ["fn_id"])
    return chain.unionByName(targets.select("fn_id", F.col("decision").alias("src"), F.col("call").alias("dst"), "kind", "label"))


@query(f"""
SELECT l_orderkey AS type, l_suppkey % 6 AS field, string_agg(CASE n % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'min length(' || l_partkey || ')' WHEN 2 THEN 'length(' || l_suppkey || ', ' || l_partkey || ')' ELSE 'email' END, ', ' ORDER BY n) AS rules
FROM {_LINES} GROUP BY l_orderkey, l_suppkey % 6""")
def q60_validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n") % 4
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    name = F.when(n == 0, "Required").when(n == 1, "MinLength").when(n == 2, "Length").otherwise("Email")
    constants = F.when(n == 1, F.array(part)).when(n == 2, F.array(supp, part)).otherwise(F.array().cast("array<string>"))
    calls = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("type"), (F.col("l_suppkey") % 6).alias("field"), F.col("n").alias("ord"), name.alias("name"), constants.alias("constants"))
    return guards.validation_rules(calls, ["type"])


# ---------------------------------------------------------------- decisions of whole flows


@query(f"""
WITH l AS (SELECT l_orderkey AS f, n, l_partkey % 3 AS e, l_quantity > 25 AS fail_when, 'call' || n AS call FROM {_LINES}),
o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY e, n) AS place FROM l WHERE e > 0), sc AS (SELECT * FROM o WHERE place <= 8),
c AS (SELECT f, n, e, fail_when, last_value(n) OVER w AS before, last_value(NOT fail_when) OVER w AS label FROM sc WINDOW w AS (PARTITION BY f ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT l.f, l.call, max(sc.n) AS n, arg_max(sc.fail_when, sc.n) AS fail_when FROM l LEFT JOIN sc ON sc.f = l.f AND sc.n < l.n GROUP BY l.f, l.call)
SELECT f AS flow_id, CASE WHEN before IS NULL THEN 'entry' || f ELSE 'decision:entry' || f || ':' || before END AS src, 'decision:entry' || f || ':' || n AS dst, CASE WHEN before IS NOT NULL THEN 'pass' END AS kind, CAST(label AS VARCHAR) AS label FROM c
UNION ALL SELECT f, 'decision:entry' || f || ':' || n, CASE WHEN e = 1 THEN 'exit:ErrA' ELSE 'exit:"no ' || n || '"' END, 'fail', CAST(fail_when AS VARCHAR) FROM c
UNION ALL SELECT f, CASE WHEN n IS NULL THEN 'entry' || f ELSE 'decision:entry' || f || ':' || n END, call, CASE WHEN n IS NOT NULL THEN 'pass' END, CASE WHEN n IS NOT NULL THEN CAST(NOT fail_when AS VARCHAR) END FROM t""")
def q61_annotated_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a flow: its lines are calls of the entry in a row, each followed by a check of its result; a third of the checks has no name."""
    l = tables.keep(_lines(spark, sf_dir).select(F.col("l_orderkey").alias("flow_id"), "n", (F.col("l_partkey") % 3).alias("e"), (F.col("l_quantity") > 25).alias("fail_when")), "lines")  # noqa: E741
    entry = F.concat(F.lit("entry"), F.col("flow_id").cast("string"))
    call = F.concat(F.lit("call"), F.col("n").cast("string"))
    none = F.lit(None).cast("string")
    no_effects = F.lit(None).cast("array<struct<type:string,block:int>>")
    shape = {"pkg": F.lit(M), "kind": F.lit("step"), "dropped_by": none, "collapse": F.lit(False), "kept": F.lit(True), "has_effects": F.lit(False), "gate": F.lit(False), "effects": no_effects}
    nodes = l.select("flow_id", entry.alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("bfs_ord")).distinct().unionByName(l.select("flow_id", call.alias("node"), F.lit(1).alias("depth"), F.col("n").alias("bfs_ord")))
    nodes = nodes.withColumns(shape | {"name": F.col("node"), "inline_name": F.col("node"), "pos_text": F.lit(""), "resolution": F.lit("static")})
    edges = l.select("flow_id", entry.alias("src"), call.alias("dst"), F.col("n").cast("long").alias("seq"), F.lit(False).alias("async"), (F.col("n") * 2).cast("int").alias("site"), none.alias("kind"), none.alias("label"))
    outcome = F.struct(
        F.when(F.col("e") == 1, "sentinel").when(F.col("e") == 2, "message").otherwise("unknown").alias("kind"), F.when(F.col("e") == 1, "ErrA").alias("name"), F.when(F.col("e") == 2, F.concat(F.lit("no "), F.col("n").cast("string"))).alias("message"),
        F.lit("").alias("pos"), F.col("n").cast("long").alias("at"),
    )
    empty = F.array().cast("array<string>")
    found = l.select(
        entry.alias("fn_id"), F.col("n").cast("string").alias("decision"), F.col("n").cast("long").alias("order_pos"), F.lit(False).alias("gate"), F.lit(False).alias("mechanical"), "fail_when", outcome.cast(annotate.EXIT).alias("exit"),
        F.lit("err != nil").alias("cond_text"), empty.alias("uses"), empty.alias("uses_fns"), none.alias("checks"), (F.col("n") * 2 + 1).cast("int").alias("pass_b"), F.lit(-1).alias("skip_b"), none.alias("failed_fn"),
    )
    blocks = l.select(entry.alias("fn_id"), F.explode(F.array((F.col("n") * 2).cast("int"), (F.col("n") * 2 + 1).cast("int"))).alias("b")).select("fn_id", "b", F.col("b").alias("pre"), (-F.col("b")).alias("post"), F.lit(1).alias("n_preds"))
    return annotate.annotate(nodes, edges, found, blocks).edges.select("flow_id", "src", "dst", "kind", "label")


@query(f"""
SELECT event_id, '{{"type":"' || CASE event_type WHEN 'click' THEN 'kafka' ELSE 'sql' END || '","detail":"d' || {K} || '"' || CASE WHEN event_type = 'click' THEN ',"topic":' || CASE WHEN {K} % 3 = 0 THEN 'null' ELSE '"t' || {K} || '"' END ELSE '' END
  || CASE WHEN {K} % 3 = 0 THEN ',"topic_expr":"x"' ELSE '' END || CASE WHEN {K} % 2 = 0 THEN ',"pos":"f:' || {K} || '"' ELSE '' END || CASE WHEN {K} % 5 = 0 THEN ',"async":true' ELSE '' END || CASE WHEN {K} % 7 = 0 THEN ',"alt":true' ELSE '' END || '}}' AS doc
FROM events""")
def q62_effect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    made = lambda p: F.concat(F.lit(p), k.cast("string"))
    one = F.struct(
        F.when(F.col("event_type") == "click", "kafka").otherwise("sql").alias("type"), made("d").alias("detail"), F.when((F.col("event_type") == "click") & (k % 3 > 0), made("t")).alias("topic"), F.when(k % 3 == 0, "x").alias("topic_expr"),
        F.when(k % 2 == 0, made("f:")).alias("pos"), (k % 5 == 0).alias("async"), (k % 7 == 0).alias("alt"),
    )
    e = _t(spark, sf_dir, "events").withColumn("k", _k())
    return e.select("event_id", F.array_join(documents.effect_json(F.array(one), alt=True), ",").alias("doc"))


@query(f"""
SELECT event_id, 'WriteMessages' AS detail, CASE WHEN {K} % 3 > 0 THEN 't' || {K} END AS topic, CASE WHEN {K} % 3 = 0 THEN 'cfg.Topics[' || event_type || ']' END AS topic_expr FROM events""")
def q63_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose topic is constant or told by an expression."""
    k = _k()
    none = F.lit(None).cast("string")
    sites = _t(spark, sf_dir, "events").select(
        "event_id", F.lit("github.com/segmentio/kafka-go").alias("callee_pkg"), F.lit("Writer").alias("callee_type"), F.lit("WriteMessages").alias("callee_name"),
        F.array().cast("array<struct<is_string:boolean,value:string,template:string>>").alias("text_args"), F.when(k % 3 > 0, F.concat(F.lit("t"), k.cast("string"))).otherwise(none).alias("topic"),
        F.concat(F.lit("cfg.Topics["), F.col("event_type"), F.lit("]")).alias("topic_source"),
    )
    return effects.detect(sites).select("event_id", "effect.detail", "effect.topic", "effect.topic_expr")
