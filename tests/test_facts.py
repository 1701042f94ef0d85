"""Discovery, values, guards, entities and effects over small fact tables."""

import json

from pyspark.sql import functions as F

from flowloom.operators import effects, entities, entrypoints, graph, guards, values
from flowloom.plans import scan


def A(text=None, texts=None, fn=None, fns=None, type_pkg=None, type_name=None):
    return (text, texts, fn, fns, type_pkg, type_name)


_SITE = f"site string, encl_fn string, callee_pkg string, callee_type string, callee_name string, is_static boolean, args array<{entrypoints.ARG}>, reader_topic string, iface_pkg string, iface_name string"
SITES = [
    ("s1", "main", "net/http", "ServeMux", "HandleFunc", True, [A("GET /x/{id}"), A(fn="hx")], None, None, None),
    ("s2", "main", "net/http", "", "Handle", True, [A("/y"), A(type_pkg="m/h", type_name="H")], None, None, None),
    ("s3", "main", "github.com/gin-gonic/gin", "Engine", "POST", True, [A("/o/:id"), A(fns=["mw", "ho"])], None, None, None),
    ("s4", "main", "github.com/labstack/echo/v4", "Echo", "Any", True, [A("/e/*"), A(fn="he")], None, None, None),
    ("s5", "cb2", "github.com/go-chi/chi/v5", "Router", "Get", True, [A("/login"), A(fn="hl")], None, None, None),
    ("s6", "main", "github.com/gorilla/mux", "Router", "HandleFunc", True, [A("/g"), A(fn="hg")], None, None, None),
    ("s7", "main", "github.com/gofiber/fiber/v2", "App", "Get", True, [A("/f/:n"), A(fns=["mw", "hf"])], None, None, None),
    ("s8", "main", "github.com/gofiber/fiber/v3", "App", "Get", True, [A("/f3"), A(fn="hf3"), A(fns=["mw"])], None, None, None),
    ("s9", "main", "m/pb", "", "RegisterOrdersServer", True, [A(), A(type_pkg="m/s", type_name="S")], None, "m/pb", "OrdersServer"),
    ("s10", "run", "github.com/segmentio/kafka-go", "Reader", "ReadMessage", True, [], "orders.created", None, None),
    ("s11", "main", "github.com/IBM/sarama", "ConsumerGroup", "Consume", True, [A(), A(texts=["a", "b"]), A(type_pkg="m/c", type_name="C")], None, None, None),
    ("s12", "main", "net/http", "", "HandleFunc", True, [A("/x2"), A(fn="outside")], None, None, None),
    ("s13", "main", "net/http", "", "HandleFunc", True, [A("GET /x/{id}"), A(fn="hx2")], None, None, None),
]


def tables(spark):
    sites = spark.createDataFrame(SITES, _SITE)
    names = ["main", "hx", "hx2", "hy", "ho", "he", "hl", "hg", "hf", "hf3", "mw", "cb1", "cb2", "run", "gm", "cc"]
    functions = spark.createDataFrame([(n, f"m/x.{n}", i, "normal", True, True) for i, n in enumerate(names)] + [("outside", "lib.O", 99, "normal", False, True)], "fn_id string, display_name string, pos int, file_class string, in_module boolean, has_body boolean")
    methods = spark.createDataFrame([("m/h", "H", "ServeHTTP", "hy"), ("m/s", "S", "GetOrder", "gm"), ("m/c", "C", "ConsumeClaim", "cc")], "type_pkg string, type_name string, method string, fn_id string")
    interfaces = spark.createDataFrame([("m/pb", "OrdersServer", "GetOrder", True), ("m/pb", "OrdersServer", "mustEmbed", False)], "iface_pkg string, iface_name string, method string, exported boolean")
    callbacks = spark.createDataFrame([("cb2", "cb1", "/auth"), ("cb1", "main", "/api")], "fn_id string, outer_fn string, prefix string")
    links = spark.createDataFrame([("v1", "v2", "prefix", "/sub"), ("v2", "v3", "methods", "GET,PUT"), ("v3", None, "plain", None)], "at string, next string, kind string, text string")
    chains = entrypoints.fold_chain(links, spark.createDataFrame([("s6", "v1")], "site string, at string"), entrypoints.GORILLA_HOPS)
    forward = spark.createDataFrame([], "site string, methods string")
    prefixes = spark.createDataFrame([("s7", "/v1")], "site string, prefix string")
    return sites, functions, methods, interfaces, callbacks, chains, forward, prefixes


def test_discovery(spark):
    rows = entrypoints.discover(*tables(spark), module="m").collect()
    assert {(r.id, r.fn_id) for r in rows} == {
        ("http:GET:/x/{id}", "hx"), ("http:GET:/x/{id}#2", "hx2"), ("http:ANY:/y", "hy"), ("http:POST:/o/{id}", "ho"), ("http:ANY:/e/{*}", "he"), ("http:GET:/api/auth/login", "hl"), ("http:GET,PUT:/sub/g", "hg"),
        ("http:GET:/v1/f/{n}", "hf"), ("http:GET:/f3", "hf3"), ("grpc:Orders/GetOrder", "gm"), ("kafka:orders.created:x.run", "run"), ("kafka:a,b:x.cc", "cc"),
    }
    assert [r.id for r in rows] == sorted(r.id for r in rows)


def test_chains_that_are_not_understood(spark):
    links = spark.createDataFrame([("v1", "v2", "prefix", None), ("w1", "w1", "plain", None)], "at string, next string, kind string, text string")
    got = {r.site: r.resolved for r in entrypoints.fold_chain(links, spark.createDataFrame([("a", "v1"), ("b", "w1"), ("c", None)], "site string, at string"), 5).collect()}
    assert got == {"a": False, "b": False, "c": True}


def test_resolving_and_examples(spark):
    wanted = spark.createDataFrame([("Do",), ("x.Run",), ("none",)], "w string")
    names = spark.createDataFrame([("m/x.Do",), ("m/y.Do",), ("m/x.Run",)], "n string")
    assert {r.w: (r.status, r.candidates) for r in entrypoints.resolve(wanted, names, "m").collect()} == {"Do": ("many", ["m/x.Do", "m/y.Do"]), "x.Run": ("one", ["m/x.Run"]), "none": ("none", [])}
    fns = spark.createDataFrame([("m/a", "A", False), ("m/handlers", "Z", False), ("m/b", "(T).M", True)], "pkg string, display_name string, is_method boolean")
    assert {r.is_method: r.example for r in entrypoints.example_handlers(fns).collect()} == {False: "Z", True: "(T).M"}
    calls = spark.createDataFrame([("f", "s1"), ("g", "s2"), ("g", "s3")], "callee string, site string")
    assert [tuple(r) for r in entrypoints.callers(calls).collect()] == [("f", "s1")]


_VALUE = "value_id string, kind string, x string, idx int, text string, owner_type string, field int"
_STORE = "fn_id string, b int, i int, addr_id string, val_id string, owner_type string, field int"


def test_constants(spark):
    v = [("c", "const", None, None, "hi", None, None), ("d", "const", None, None, "other", None, None), ("conv", "conversion", "c", None, None, None, None), ("ld", "load", "addr", None, None, None, None), ("ld2", "load", "addr2", None, None, None, None),
         ("fa", "field_addr", None, None, None, "T", 1), ("fl", "load", "fa", None, None, None, None), ("p1", "phi_edge", "conv", 0, None, None, None), ("p1", "phi_edge", "c", 1, None, None, None), ("p2", "phi_edge", "c", 0, None, None, None), ("p2", "phi_edge", "d", 1, None, None, None),
         ("g", "global", None, None, None, None, None), ("k1", "conversion", "c", None, None, None, None), ("k2", "conversion", "k1", None, None, None, None), ("k3", "conversion", "k2", None, None, None, None), ("k4", "conversion", "k3", None, None, None, None), ("k5", "conversion", "k4", None, None, None, None)]
    s = [("f", 0, 0, "addr", "conv", None, None), ("f", 0, 1, "addr2", "c", None, None), ("f", 0, 2, "addr2", "d", None, None), ("f", 0, 3, "other", "c", "T", 1), ("f", 0, 4, "g", "d", None, None)]
    got = {r.value_id: r.text for r in values.constant_strings(spark.createDataFrame(v, _VALUE), spark.createDataFrame(s, _STORE)).collect()}
    assert got == {"c": "hi", "d": "other", "conv": "hi", "ld": "hi", "fl": "hi", "p1": "hi", "g": "other", "k1": "hi", "k2": "hi", "k3": "hi", "k4": "hi"}


def test_packs_fields_and_functions(spark):
    elements = spark.createDataFrame([("p", 2, "b"), ("p", 0, "a"), ("q", 0, "a"), ("q", 1, "z")], "pack_id string, idx int, val_id string")
    constants = spark.createDataFrame([("a", "A"), ("b", "B")], "value_id string, text string")
    assert {r.pack_id: r.texts for r in values.pack_strings(elements, constants).collect()} == {"p": ["A", "B"]}
    assert {r.pack_id: r.vals for r in values.pack_values(elements).collect()} == {"p": ["a", "b"], "q": ["a", "z"]}
    literals = spark.createDataFrame([("l", "Topic", "a"), ("l", "X", "a"), ("l", "X", "b")], "alloc_id string, field string, val_id string")
    assert [tuple(r) for r in values.struct_field_strings(literals, constants).collect()] == [("l", "Topic", "A")]
    defs = spark.createDataFrame([("v", "conversion", "w", None, None, None, None), ("w", "load", "ad", None, None, None, None), ("cl", "closure", "fn", None, None, None, None)], _VALUE)
    stores = spark.createDataFrame([("f", 0, 0, "ad", "fn", None, None)], _STORE)
    fns = spark.createDataFrame([("fn", "real")], "fn_id string, declared_fn string")
    got = values.resolve_functions(spark.createDataFrame([("v",), ("cl",), ("none",)], "value_id string"), defs, stores, fns)
    assert {r.value_id: r.fn_id for r in got.collect()} == {"v": "real", "cl": "real"}


def test_reaching_stores(spark):
    loads = spark.createDataFrame([("f", 3, 1, "l1", "a"), ("f", 2, 5, "l2", "a"), ("f", 9, 0, "l3", "a")], "fn_id string, b int, i int, value_id string, addr_id string")
    stores = spark.createDataFrame([("f", 1, 0, "a", "v0"), ("f", 2, 1, "a", "v1"), ("f", 2, 4, "a", "v2"), ("f", 2, 6, "a", "v3")], "fn_id string, b int, i int, addr_id string, val_id string")
    blocks = spark.createDataFrame([("f", 1, []), ("f", 2, [1]), ("f", 3, [2]), ("f", 9, [2, 3])], "fn_id string, b int, preds array<int>")
    assert {r.value_id: r.val_id for r in values.reaching_stores(loads, stores, blocks).collect()} == {"l1": "v3", "l2": "v2"}


def test_guards(spark):
    ifs = spark.createDataFrame([("f", 0, 1, 2, 10, 11, "err != nil"), ("f", 2, 3, 4, 20, 21, "x > 1"), ("f", 5, 6, 7, 10, 31, "err != nil")], "fn_id string, b int, then_b int, else_b int, stmt_pos int, order_pos int, cond_text string")
    blocks = spark.createDataFrame([("f", 1, [8]), ("f", 2, [3, 4]), ("f", 3, [5]), ("f", 4, [5]), ("f", 6, [8]), ("f", 7, [9])], "fn_id string, b int, succs array<int>")
    exits = spark.createDataFrame([("f", 8, "sentinel", "ErrX", None, "f:8", False), ("f", 9, "message", None, "no", "f:9", True)], "fn_id string, b int, kind string, name string, message string, pos string, tail boolean")
    rows = guards.guards(ifs, blocks, exits).orderBy("stmt_pos").collect()
    assert [(r.stmt_pos, r.gate, r.fail_when, r.pass_b) for r in rows] == [(10, False, True, 2), (20, True, None, 3)]
    assert rows[0].exit.name == "ErrX"
    texts = spark.createDataFrame([("ErrA", "x", None), (None, "bad id %d", "ErrL"), (None, "%w: %w", "ErrL"), (None, "", None)], "s string, m string, l string")
    got = [tuple(r.e) for r in texts.select(guards.exit_identity(F.col("s"), F.col("m"), F.col("l")).alias("e")).collect()]
    assert got == [("sentinel", "ErrA", None), ("message", None, "bad id %d"), ("sentinel", "ErrL", None), ("unknown", None, None)]
    said = spark.createDataFrame([(400, "bad", "F"), (404, None, "Find"), (500, None, None), (200, "x", None)], "s int, m string, f string")
    assert [r[0] for r in said.select(guards.rejection(F.col("s"), F.col("m"), F.col("f"))).collect()] == ["HTTP 400 · bad", "HTTP 404 (Find failed)", "HTTP 500", None]
    ok = spark.createDataFrame([("f", 2, 201), ("f", 1, 404), ("g", 1, 200)], "fn_id string, ord int, status int")
    assert {r.fn_id: r.success for r in guards.success_response(ok).collect()} == {"f": "201 Created", "g": "200"}


def test_attaching(spark):
    chosen = spark.createDataFrame(
        [("n", "d1", 1, False, False, True, 10, 90, 5, 6), ("n", "g1", 2, True, True, False, 20, 30, 40, 50), ("n", "d2", 3, False, False, False, 60, 80, 1, 2)],
        "node string, decision string, ord int, gate boolean, branch boolean, fail_when boolean, pre int, post int, skip_pre int, skip_post int",
    )
    calls = spark.createDataFrame([("n", "a", 25, 26), ("n", "b", 45, 46), ("n", "c", 70, 71), ("n", "out", 95, 96)], "node string, call string, b_pre int, b_post int")
    chain, targets = guards.attach(chosen, calls, ["node"])
    assert {r.dst: (r.src, r.kind, r.label) for r in chain.collect()} == {"d1": (None, None, None), "g1": ("d1", "pass", "false"), "d2": ("d1", "pass", "false")}
    assert {r.call: (r.decision, r.label) for r in targets.collect()} == {"a": ("g1", "yes"), "b": ("d1", "false"), "c": ("d2", "true")}


def test_uses_and_rules(spark):
    conditions = spark.createDataFrame([("k", "c")], "key string, at string")
    operands = spark.createDataFrame([("c", "x", 0), ("c", "y", 1), ("x", "z", 0), ("y", "w", 0)], "at string, next string, ord int")
    calls = spark.createDataFrame([("y", "First"), ("z", "Second"), ("w", "First")], "at string, name string")
    assert guards.condition_uses(conditions, operands, calls).first().uses == ["First", "Second"]
    rows = spark.createDataFrame([("t", "Name", 1, "Length", ["4", "64"]), ("t", "Name", 0, "Required", []), ("t", "Age", 0, "Min", ["1"])], "t string, field string, ord int, name string, constants array<string>")
    assert {r.field: r.rules for r in guards.validation_rules(rows, ["t"]).collect()} == {"Name": "required, length(4, 64)", "Age": "min(1)"}
    steps = spark.createDataFrame([("a", "b"), ("b", "c")], "at string, next string")
    ends = spark.createDataFrame([("c", "Call")], "at string, name string")
    assert [r.name for r in guards.follow(spark.createDataFrame([("k", "a")], "key string, at string"), steps, ends).collect()] == ["Call"]


def test_effect_details(spark):
    none = (False, None, None)
    rows = [
        (1, "database/sql", "DB", "QueryContext", [none, (True, "SELECT  1\n FROM t", None)], None, "t0"), (2, "database/sql", "DB", "Query", [(True, None, None)], None, "t0"), (3, "net/http", "", "NewRequestWithContext", [none, (True, "PUT", None), (True, None, "%s/x")], None, "t0"),
        (4, "net/http", "Client", "Get", [(True, "http://a/b", None)], None, "t0"), (5, "github.com/segmentio/kafka-go", "Writer", "WriteMessages", [], "orders", "t0"), (6, "github.com/IBM/sarama", "SyncProducer", "SendMessages", [], "orders", "t" * 80),
        (7, "github.com/IBM/sarama", "AsyncProducer", "Input", [], None, "t0"), (8, "example.com/x", "DB", "Query", [], None, "t0"), (9, None, None, None, [], None, None),
    ]
    sites = spark.createDataFrame(rows, "i int, callee_pkg string, callee_type string, callee_name string, text_args array<struct<is_string:boolean,value:string,template:string>>, topic string, topic_source string")
    got = {r.i: r.effect and tuple(r.effect) for r in effects.detect(sites).collect()}
    assert got == {
        1: ("sql", "SELECT 1 FROM t", None, None), 2: ("sql", "Query", None, None), 3: ("http", "PUT %s/x", None, None), 4: ("http", "Get http://a/b", None, None), 5: ("kafka", "WriteMessages", "orders", None),
        6: ("kafka", "SendMessages", None, "t" * 57 + "..."), 7: ("kafka", "Input", None, None), 8: None, 9: None,
    }


def test_index_document(spark):
    flows = spark.createDataFrame(
        [("f1", "http", "POST", "/orders", None, "(*m/x.H).CreateOrder", "f1.json"), ("f2", "kafka", None, None, "order.paid", "m/consumer.Run", "f2.json"), ("f3", "http", "GET", "/healthz", None, "m/x.Health", "f3.json")],
        "flow_id string, kind string, method string, path string, topic string, func string, file string",
    )
    eff = spark.createDataFrame([("f1", "sql", "INSERT INTO order_items (a) VALUES (1)", None), ("f1", "sql", "SELECT 1 FROM audit_log", None), ("f2", "kafka", "Send", "order.done")], "flow_id string, type string, detail string, topic string")
    merge = spark.createDataFrame([("order", "audit_log")], "target string, satellite string")
    names = spark.createDataFrame([("order", "Sale")], "key string, name string")
    doc = entities.index_document(flows, eff, merge, names, "m").first()
    (one,) = doc.entities
    assert (one.key, one.name, one.name_overridden, one.tables) == ("order", "Sale", True, ["audit_log", "order_items"])
    assert [(f.id, f.title, f.access) for f in one.flows] == [("f1", "Create order", ["creates", "reads"]), ("f2", "Run consumer", ["publishes order.done", "consumes order.paid"])]
    assert [o.id for o in doc.other] == ["f3"] and len(doc.flows) == 3


def test_a_scan_from_facts_to_documents(spark):
    docs, index = scan.example(spark)
    got = {r.flow_id: json.loads(r.doc) for r in docs.collect()}
    one = got["http:POST:/orders"]
    assert [n["func"] for n in one["nodes"]] == ["order.Create", "order.Save"] and one["nodes"][1]["effects"] == [{"type": "sql", "detail": "INSERT INTO orders VALUES (1)", "pos": "o.go:7"}]
    assert one["stats"] == {"raw_nodes": 4, "kept_nodes": 2, "dropped_by_rule": {"default:logging-packages": 1, "default:trivial-wrapper": 1}}
    assert index.first().entities[0].key == "order"


def test_arguments_become_what_discovery_reads(spark):
    sites = spark.createDataFrame([("s1", "main", 1, ["recv", "c1", "f1"]), ("s2", "main", 0, ["c1", "pk"]), ("s3", "main", 1, ["recv"])], "site_id string, fn_id string, arg_offset int, args array<string>")
    constants = spark.createDataFrame([("c1", "/x")], "value_id string, text string")
    texts = spark.createDataFrame([("pk", ["a", "b"])], "pack_id string, texts array<string>")
    fns = spark.createDataFrame([("f1", "hx")], "value_id string, fn_id string")
    packs = spark.createDataFrame([("pk", ["hx", "hy"])], "pack_id string, fns array<string>")
    types = spark.createDataFrame([("f1", "m/h", "H")], "value_id string, type_pkg string, type_name string")
    got = {r.site: [tuple(a) for a in r.args] for r in entrypoints.resolved_sites(sites, constants, texts, fns, packs, types).collect()}
    assert got == {"s1": [("/x", None, None, None, None, None), (None, None, "hx", None, "m/h", "H")], "s2": [("/x", None, None, None, None, None), (None, ["a", "b"], None, ["hx", "hy"], None, None)], "s3": []}


def test_forward_methods_and_bindings(spark):
    starts = spark.createDataFrame([("s", "r0"), ("t", "q0"), ("u", "z0")], "site string, at string")
    uses = spark.createDataFrame([("r0", "r1", "link", None), ("r1", "r2", "methods", "GET"), ("q0", "q1", "methods", None), ("q0", "q2", "methods", "PUT"), ("r1", "r3", "link", None)], "at string, next string, kind string, text string")
    assert {r.site: r.methods for r in entrypoints.forward_methods(starts, uses).collect()} == {"s": "GET", "t": "PUT"}
    bindings = spark.createDataFrame([("v", "a"), ("w", "b"), ("w", "c")], "free_var string, bound string")
    assert [tuple(r) for r in entrypoints.closure_bindings(bindings).collect()] == [("v", "a")]


_CALL = "at string, next string, callee_pkg string, callee_name string, args array<" + entrypoints.ARG + ">"


def test_router_chains(spark):
    """Prefixes and methods of chains of groups, subrouters and builders."""
    arg = lambda text=None, texts=None: [(text, texts, None, None, None, None)]
    mux, fiber = entrypoints.GORILLA, "github.com/gofiber/fiber/v2"
    calls = spark.createDataFrame(
        [
            ("r", None, mux, "NewRouter", []), ("p", "r", mux, "PathPrefix", arg("/api")), ("s", "p", mux, "Subrouter", []), ("m", "s", mux, "Methods", arg(None, ["GET", "PUT"])), ("n", "m", mux, "Name", arg("x")),
            ("d", "s", mux, "Path", arg()), ("u", "s", mux, "Walk", []),
        ],
        _CALL,
    )
    moves = spark.createDataFrame([("v", "n"), ("loop", "loop")], "at string, next string")
    starts = spark.createDataFrame([(x, x) for x in ("v", "s", "r", "d", "u", "loop", "else")], "site string, at string")
    got = {r.site: (r.path, r.methods, r.resolved) for r in entrypoints.fold_chain(entrypoints.gorilla_links(calls, moves), starts, entrypoints.GORILLA_HOPS).collect()}
    assert got["v"] == ("/api", "GET,PUT", True) and got["s"] == ("/api", None, True) and got["r"] == got["else"] == ("", None, True)
    assert not got["d"][2] and not got["u"][2] and not got["loop"][2]
    calls = spark.createDataFrame([("app", None, fiber, "New", []), ("g", "app", fiber, "Group", arg("/api")), ("h", "g2", fiber, "Get", arg("/x")), ("w", "h", fiber, "Group", arg("/v1")), ("q", "g", fiber, "Group", arg())], _CALL)
    moves = spark.createDataFrame([("g2", "g")], "at string, next string")
    callbacks = spark.createDataFrame([("param", "w", "/admin")], "at string, next string, text string")
    starts = spark.createDataFrame([(x, x) for x in ("app", "g", "w", "q", "param", "else")], "site string, at string")
    got = {r.site: r.prefix for r in entrypoints.fiber_prefixes(entrypoints.fiber_links(calls, moves, callbacks), starts).collect()}
    assert got == {"app": "", "g": "/api", "w": "/api/v1", "q": "/api", "param": "/api/v1/admin", "else": ""}


def test_canonical_functions_and_skipped_sites(spark):
    rows = spark.createDataFrame([("f", None, None), ("g[int]", "g", None), ("w", "g", "h")], "fn_id string, origin_fn string, declared_fn string")
    assert {r.fn_id: r.canonical for r in graph.canonical(rows).collect()} == {"f": "f", "g[int]": "g", "w": "h"}
    sites = spark.createDataFrame([("builtin", None, "len"), ("invoke", None, "error"), ("invoke", "m/x", "error"), ("static", "m", "T")], "mode string, pkg string, type string")
    assert [r.s for r in sites.select(graph.skipped_site(F.col("mode"), F.col("pkg"), F.col("type")).alias("s")).collect()] == [True, True, False, False]


def test_documents_hold_outcomes_and_names(spark):
    """The example with what its functions fail with, a success, and a name from the settings."""
    import json

    from flowloom.plans import scan

    given = {}
    real = scan.flow_documents

    def with_more(entry, sites, callees, functions, module):
        outcomes = spark.createDataFrame([("c", 2, "ErrB"), ("c", 1, "ErrA"), ("c", 3, "ErrA"), ("h", 1, "ErrH")], "fn_id string, ord int, text string")
        responses = spark.createDataFrame([("h", 1, 500), ("h", 2, 201), ("h", 3, 204)], "fn_id string, ord int, status int")
        overrides = spark.createDataFrame([("order.Create", "Make an order")], "key string, label string")
        given["docs"] = real(entry, sites, callees, functions, module, outcomes=outcomes, responses=responses, overrides=overrides)
        return given["docs"]

    scan.flow_documents = with_more
    try:
        docs, _ = scan.example(spark)
    finally:
        scan.flow_documents = real
    doc = json.loads(docs.first().doc)
    assert doc["entrypoint"]["success"] == "201 Created" and doc["entrypoint"]["error_exits"] == ["ErrH"]
    made = [n for n in doc["nodes"] if n["func"] == "Make an order"]
    assert made and made[0]["error_exits"] == ["ErrA", "ErrB"]
