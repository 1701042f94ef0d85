"""Hand-made flows through the filter, contraction, documents and trees."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.operators import documents, graph, rules
from flowloom.sources import sinks
from flowloom.sources.rules import parse_rules

_NODE = "flow_id string, node string, name string, pkg string, short_name string, kind string, depth int, bfs_ord long, has_effects boolean, kept boolean, dropped_by string, gate boolean, inline_name string, effects array<struct<use_ord:int,type:string,detail:string,topic:string,topic_expr:string,pos:string,async:boolean>>"
_EDGE = "flow_id string, src string, dst string, ord int, seq long, async boolean, kind string, label string"
NOISE = parse_rules("rules:\n  - {id: noise, action: drop, match: {pkg: 'm/noise*'}}\n  - {id: again, action: collapse, match: {pkg: 'm/noise*'}}\n  - {id: wrap, action: collapse, match: {func: 'wrap*'}}\n")


def flow(spark, edges, effects=(), terminals=(), gates=(), asyncs=(), pkgs=None):
    """Tables of one flow from edges a-b; r is the root, a name's first letter n means noise and w a wrapper."""
    pairs = [e.split("-") for e in edges.split()]
    order, depth = ["r"], {"r": 0}
    for n in order:
        for a, b in pairs:
            if a == n and b not in depth:
                depth[b] = depth[n] + 1
                order.append(b)
    eff = lambda n: [(0, "sql", f"Q{n}", None, None, "f:1", n in asyncs)] if n in effects else []
    pkg = lambda n: (pkgs or {}).get(n, "m/noise" if n[0] == "n" else "m/x")
    rows = [("f", n, f"m/x.{n}", pkg(n), f"wrap{n}" if n[0] == "w" else n, "terminal" if n in terminals else "step", depth[n], i, n in effects, n in effects or n in terminals or n == "r", None, n in gates, f"x.{n}", eff(n)) for i, n in enumerate(order)]
    ways = [("f", a, b, i, i + 1, f"{a}-{b}" in asyncs, None, None) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, _NODE), spark.createDataFrame(ways, _EDGE)


def run(spark, *args, **kwargs):
    nodes, edges = flow(spark, *args, **kwargs)
    marked = rules.mark(nodes, edges, NOISE, "m").cache()
    out = rules.prune(marked, edges).first()
    return {r.node: r.dropped_by for r in marked.collect()}, [n.node for n in out.nodes], {(e.src, e.dst): e for e in out.edges}, out.dropped, {n.node: n for n in out.nodes}


def test_drop_goes_with_its_subtree(spark):
    marks, left, _, dropped, _ = run(spark, "r-a r-n1 n1-n2 a-e", effects="e")
    assert left == ["r", "a", "e"] and dropped == {"noise": 2} and marks["n1"] == "noise"


def test_a_path_to_an_effect_is_protected(spark):
    marks, left, *_ = run(spark, "r-n1 n1-n2 n2-e", effects="e")
    assert left == ["r", "n1", "n2", "e"] and marks["n1"] is None


def test_a_terminal_protects_nothing(spark):
    _, left, _, dropped, _ = run(spark, "r-n1 n1-t", terminals="t")
    assert left == ["r"] and dropped == {"noise": 1}


def test_effect_free_subtrees_go_below_the_narrative(spark):
    marks, left, *_ = run(spark, "r-a a-b b-c c-d a-e", effects="e")
    assert marks["c"] == marks["d"] == rules.NO_EFFECT and left == ["r", "a", "b", "e"]


def test_a_cycle_reaches_effects_through_its_other_nodes(spark):
    marks, *_ = run(spark, "r-a a-b b-c c-d d-c d-e c-f", effects="e")
    assert marks["c"] is None and marks["d"] is None and marks["f"] == rules.NO_EFFECT


def test_collapse_chain_and_diamond(spark):
    _, left, edges, dropped, nodes = run(spark, "r-a a-w1 w1-w2 w2-b a-w3 w3-b b-e", effects="e")
    assert left == ["r", "a", "b", "e"] and dropped == {"wrap": 3} and set(edges) == {("r", "a"), ("a", "b"), ("b", "e")}
    assert sorted(set(nodes["a"].collapsed)) == ["x.w1", "x.w2", "x.w3"]
    assert edges["a", "b"].seq == 2


def test_async_and_effects_survive_a_collapse(spark):
    _, left, edges, _, nodes = run(spark, "r-a a-w1 w1-b b-e", effects=("e", "w1"), asyncs=("a-w1",))
    assert ("a", "b") in edges or "w1" in left
    _, left, edges, _, nodes = run(spark, "r-a a-w1 w1-b b-e", effects=("e",), asyncs=("a-w1",))
    assert edges["a", "b"]["async"]


def test_the_budget_collapses_what_is_deeper(spark):
    chain = "r-a0 " + " ".join(f"a{i}-a{i + 1}" for i in range(60)) + " a60-e"
    marks, left, _, dropped, nodes = run(spark, chain, effects=("e", "a50"))
    assert len(left) == 41 and dropped == {rules.BEYOND: 22} and {e.detail for e in nodes["a39"].effects} == {"Qe", "Qa50"} and not nodes["a39"].collapsed


def test_an_empty_gate_goes(spark):
    _, left, _, dropped, _ = run(spark, "r-g g-w1 r-e", effects="e", gates="g")
    assert left == ["r", "e"] and dropped == {"wrap": 1, rules.EMPTY_GATE: 1}


def test_set_form_of_contraction(spark):
    nodes, edges = flow(spark, "r-a a-w1 w1-w2 w2-w1 w2-b a-w3 w3-b")
    got = rules.splice(edges, nodes.where("node like 'w%'").select("flow_id", "node"), ["flow_id"]).collect()
    assert {(r.src, r.dst): r.via for r in got} == {("r", "a"): [], ("a", "b"): ["w1", "w2", "w3"]}


def test_search_order_and_ids(spark):
    edges = spark.createDataFrame([("f", "r", "b", 5, 0), ("f", "r", "a", 0, 1), ("f", "b", "c", 2, 0), ("f", "a", "d", 1, 0), ("f", "c", "r", 1, 0)], "flow_id string, src string, dst string, seq long, out_ord int")
    roots = spark.createDataFrame([("f", "r")], "flow_id string, node string")
    assert {r.node: r.id for r in documents.node_ids(edges, roots, ["flow_id"]).collect()} == {"r": "entrypoint", "b": "n1", "a": "n2", "c": "n3", "d": "n4"}
    assert {r.node for r in graph.reachable(edges, roots, ["flow_id"], reverse=True).collect()} == {"r", "c", "b"}
    assert {r.node: r.depth for r in graph.bfs(edges, roots, ["flow_id"], max_depth=1).collect()} == {"r": 0, "b": 1, "a": 1}


def test_trees(spark):
    nodes, edges = flow(spark, "r-a a-b b-a r-b", effects="b")
    rows = nodes.withColumn("label", F.col("name")).withColumn("tags", F.when(F.col("node") == "a", F.array(F.lit("async"))))
    tree = documents.debug_trees(rows, edges.withColumn("out_ord", F.col("ord"))).first().tree
    assert tree == "m/x.r\n  m/x.a  [async]\n    m/x.b\n      · sql: Qb\n      m/x.a  (cycle)\n  m/x.b  (subtree shown above)\n"


def test_documents(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("http:GET:/a", "n1", 1, "m/x.Do", "m/x", "f.go:1", "step", "static", False, ["z", "z", "a"], [(0, "kafka", "Send", None, "t0", "f:2", True), (1, "sql", "a < b", None, None, "", False)], [], "T")],
        "flow_id string, id string, ord int, name string, pkg string, pos string, kind string, resolution string, async boolean, collapsed array<string>, effects array<struct<use_ord:int,type:string,detail:string,topic:string,topic_expr:string,pos:string,async:boolean>>, error_exits array<string>, returns string",
    )
    edges = spark.createDataFrame([("http:GET:/a", 0, "entrypoint", "n1", False, None, None)], "flow_id string, ord int, from_id string, to_id string, async boolean, kind string, label string")
    flows = spark.createDataFrame(
        [("http:GET:/a", "http", "GET", "/a", None, "m/x.H", "f.go:9", ["E"], "", "201 Created", 3, [])], "flow_id string, flow_kind string, method string, path string, topic string, func string, flow_pos string, flow_exits array<string>, flow_returns string, success string, raw_nodes int, "
        "flow_effects array<struct<use_ord:int,type:string,detail:string,topic:string,topic_expr:string,pos:string,async:boolean>>",
    )
    more = flows.withColumn("flow_id", F.lit("func:m/x.Z"))
    dropped = spark.createDataFrame([("http:GET:/a", "noise", 2)], "flow_id string, dropped_by string, n long")
    docs = documents.flow_documents(flows.unionByName(more), nodes, edges, dropped, "m").cache()
    by = {r.flow_id: json.loads(r.doc) for r in docs.collect()}
    one = by["http:GET:/a"]
    assert one["nodes"][0] == {"id": "n1", "func": "x.Do", "package": "m/x", "pos": "f.go:1", "kind": "step", "async": False, "resolution": "static", "collapsed": ["a", "z"], "returns": "T",
        "effects": [{"type": "kafka", "detail": "Send", "topic": None, "topic_expr": "t0", "pos": "f:2", "async": True}, {"type": "sql", "detail": "a < b"}]}
    assert one["edges"] == [{"from": "entrypoint", "to": "n1"}] and one["stats"] == {"raw_nodes": 3, "kept_nodes": 1, "dropped_by_rule": {"noise": 2}}
    assert one["entrypoint"] == {"id": "http:GET:/a", "kind": "http", "method": "GET", "path": "/a", "func": "x.H", "pos": "f.go:9", "error_exits": ["E"], "success": "201 Created"}
    assert by["func:m/x.Z"]["nodes"] is None and by["func:m/x.Z"]["edges"] is None
    names = sinks.write_files(docs, str(tmp_path / "out"))
    assert sorted(names) == ["func-m-x.Z.json", "http-GET--a.json"] and "a \\u003c b" in (tmp_path / "out" / "http-GET--a.json").read_text()
    page = sinks.html_page([(r.flow_id, r.doc) for r in docs.collect()], None)
    assert "</script>" in page and page.count("<script>") == 1
    with pytest.raises(ValueError):
        sinks.html_page([], None)


def test_extraction(spark):
    sites = spark.createDataFrame(
        [("r", "s1", 1, 10, False, 0, None, None), ("r", "s2", 2, 20, True, 1, None, None), ("a", "s3", 1, 30, False, 0, "sql", None), ("a", "s4", 2, 40, False, 0, None, "dynamic:I.M"), ("b", "s5", 1, 50, False, 0, None, None)],
        "caller string, site string, ord int, seq long, async boolean, block int, effect string, dynamic_name string",
    )
    callees = spark.createDataFrame([("s1", "a", 1, "static"), ("s2", "a", 1, "static-multi"), ("s2", "b", 2, "static-multi"), ("s5", "lib", 1, "static"), ("s3", "lib", 1, "static"), ("s5", "b", 2, "static")], "site string, callee string, callee_ord int, resolution string")
    fns = spark.createDataFrame([("r", True), ("a", True), ("b", True), ("lib", False)], "fn_id string, visit boolean")
    roots = spark.createDataFrame([("f1", "r"), ("f2", "a")], "flow_id string, fn_id string")
    nodes, edges = graph.extract(sites, callees, fns, roots)
    got = {(r.flow_id, r.node): (r.kind, r.resolution, r.depth) for r in nodes.collect()}
    assert got == {("f1", "r"): ("step", "static", 0), ("f1", "a"): ("step", "static-multi", 1), ("f1", "b"): ("step", "static-multi", 1), ("f1", "dynamic:I.M"): ("terminal", "dynamic", 2), ("f2", "a"): ("step", "static", 0), ("f2", "dynamic:I.M"): ("terminal", "dynamic", 1)}
    ways = {(r.flow_id, r.src, r.dst): (r.seq, r["async"], r.site) for r in edges.collect()}
    assert ways == {("f1", "r", "a"): (10, True, 0), ("f1", "r", "b"): (20, True, 1), ("f1", "a", "dynamic:I.M"): (40, False, 0), ("f2", "a", "dynamic:I.M"): (40, False, 0)}


def test_call_graphs(spark):
    sites = spark.createDataFrame([("s1", "static", "f", None, None, None), ("s2", "invoke", None, "p", "I", "M")], "site string, mode string, callee_fn string, callee_pkg string, callee_type string, callee_name string")
    methods = spark.createDataFrame([("p", "A", "M", "A.M"), ("p", "A", "N", "A.N"), ("p", "B", "M", "B.M"), ("p", "C", "M", "C.M"), ("p", "C", "N", "C.N")], "type_pkg string, type_name string, method string, fn_id string")
    interfaces = spark.createDataFrame([("p", "I", "M"), ("p", "I", "N")], "iface_pkg string, iface_name string, method string")
    coarse = graph.class_hierarchy(sites, methods, interfaces)
    assert sorted(map(tuple, coarse.collect())) == [("s1", "f"), ("s2", "A.M"), ("s2", "C.M")]
    types = graph.type_flow(spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x")], "src string, dst string"), spark.createDataFrame([("x", "p.A")], "value string, type string"))
    assert {r.value for r in types.collect()} == {"x", "y", "z"}
    own = methods.select("fn_id", F.concat_ws(".", "type_pkg", "type_name").alias("type"))
    fine = graph.refine_calls(coarse, spark.createDataFrame([("s2", "z")], "site string, value string"), types, own)
    assert sorted(map(tuple, fine.collect())) == [("s1", "f"), ("s2", "A.M")]
    cone = spark.range(3)
    assert graph.build_call_graph(coarse, lambda: fine, cone)[1] == "vta" and graph.build_call_graph(coarse, lambda: fine, cone, max_cone=2)[1:] == ("cha", ["more than 2 functions are reachable; the coarse call graph is used"])
    assert graph.build_call_graph(coarse, lambda: 1 / 0, cone, "vta")[1] == "cha"
    with pytest.raises(ValueError):
        graph.build_call_graph(coarse, lambda: fine, cone, "x")


def test_calls_of_several_ways_are_one_pair_and_pairs_are_not_shuffled(spark):
    rows = [("s1", "invoke", None, "p", "I", "M"), ("s1", "invoke", None, "p", "J", "M"), ("s1", "invoke", "A.M", None, None, None), ("s1", "invoke", None, "p", "J", "M"), ("s2", "invoke", "B.N", "p", "I", "M"), ("s3", "invoke", None, "p", "None", "M"), ("s4", "static", None, "p", "I", "M")]
    sites = spark.createDataFrame(rows, "site string, mode string, callee_fn string, callee_pkg string, callee_type string, callee_name string")
    methods = spark.createDataFrame([("p", t, m, f"{t}.{m}") for t, m in (("A", "M"), ("A", "N"), ("B", "M"), ("C", "M"), ("C", "N"))], "type_pkg string, type_name string, method string, fn_id string")
    interfaces = spark.createDataFrame([("p", "I", "M"), ("p", "I", "N"), ("p", "J", "M")], "iface_pkg string, iface_name string, method string")
    found = graph.class_hierarchy(sites, methods, interfaces)
    assert sorted(map(tuple, found.collect())) == [("s1", "A.M"), ("s1", "B.M"), ("s1", "C.M"), ("s2", "A.M"), ("s2", "B.N"), ("s2", "C.M")]
    plan = found.groupBy("site").agg(F.min("callee"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") == 1 and plan.count(" Sort ") == 1


def test_type_flow_beyond_its_rounds_falls_back_with_a_warning(spark):
    flows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a", "p.A")], "value string, type string")
    coarse = spark.createDataFrame([("s", "f")], "site string, callee string")
    calls, algo, warnings = graph.build_call_graph(coarse, lambda: graph.type_flow(flows, seeds, max_rounds=2), coarse, algo="vta")
    assert calls is coarse and algo == "cha" and "RuntimeError" in warnings[0]
    assert graph.type_flow(flows, seeds, max_rounds=4).count() == 4


def test_a_node_reached_async_makes_all_its_ways_async(spark):
    _, left, edges, *_ = run(spark, "r-a r-b a-w1 b-w1 w1-c c-e", effects="e", asyncs=("a-w1",))
    assert left == ["r", "a", "b", "c", "e"] and edges["a", "c"]["async"] and edges["b", "c"]["async"] and not edges["r", "b"]["async"]
    nodes, edges = flow(spark, "r-a r-b a-w1 b-w1 w1-w2 w2-c b-w3 w3-c b-d", asyncs=("a-w1",))
    got = {(r.src, r.dst): (r["async"], r.via) for r in rules.splice(edges, nodes.where("node like 'w%'").select("flow_id", "node"), ["flow_id"]).collect()}
    assert got == {("r", "a"): (False, []), ("r", "b"): (False, []), ("a", "c"): (True, ["w1", "w2"]), ("b", "c"): (True, ["w1", "w2", "w3"]), ("b", "d"): (False, [])}


def test_contraction_keeps_one_row_for_each_pair(spark):
    """Nine layers of two collapsed nodes: 512 ways, one edge."""
    layers = [["r"], *[[f"w{i}a", f"w{i}b"] for i in range(9)], ["z"]]
    pairs = " ".join(f"{x}-{y}" for a, b in zip(layers, layers[1:]) for x in a for y in b)
    nodes, edges = flow(spark, pairs)
    (row,) = rules.splice(edges, nodes.where("node like 'w%'").select("flow_id", "node"), ["flow_id"]).collect()
    assert (row.src, row.dst, row.seq, len(row.via)) == ("r", "z", 1, 18)


def test_extraction_stops_at_the_node_limit(spark):
    calls = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("c", "f"), ("d", "g"), ("f", "h")]
    none = None
    sites = spark.createDataFrame([(x, f"{x}{y}", i, i, False, 0, none, none) for i, (x, y) in enumerate(calls)], "caller string, site string, ord int, seq long, async boolean, block int, effect string, dynamic_name string")
    callees = spark.createDataFrame([(f"{x}{y}", y, 1, "static") for x, y in calls], "site string, callee string, callee_ord int, resolution string")
    fns = spark.createDataFrame([(x, True) for x in "rabcdefgh"], "fn_id string, visit boolean")
    roots = spark.createDataFrame([("f1", "r")], "flow_id string, fn_id string")
    nodes, edges = graph.extract(sites, callees, fns, roots, max_nodes=3)
    assert {r.node: r.resolution for r in nodes.collect()} == {"r": "static", "a": "static", "b": "truncated", "c": "truncated"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("r", "a"), ("r", "b"), ("a", "c")}
    nodes, edges = graph.extract(sites, callees, fns, roots)
    assert nodes.count() == 9 and edges.count() == 8
