import pytest
from pyspark.sql import functions as F

from flowloom.functions import text
from flowloom.functions.predicates import REGISTRY, handler_shaped, heuristic
from flowloom.sources import facts
from flowloom.sources.rules import default_rules, parse_rules, read_settings, rules_table, settings_tables

CASES = {
    "singular": (text.singular, [("companies", "company"), ("statuses", "status"), ("boxes", "box"), ("address", "address"), ("houses", "hous"), ("bus", "bus"), ("analysis", "analysis"), ("ties", "ty"), ("s", "s"), ("", "")]),
    "entity_key": (text.entity_key, [("Order_Items", "order_item"), ("products", "product"), ("_ids", "_id"), ("a__b", "a__b")]),
    "path_entity": (text.path_entity, [("/products/{id}", "product" + "s"), ("/api/v2/users/1", "users"), ("/auth/login", ""), ("/:id/x", ""), ("/{id}", ""), ("", ""), ("/a-b/c", ""), ("Orders/GetOrder", "orders")]),
    "topic_prefix": (text.topic_prefix, [("order.created", "order"), ("orders", ""), ("Order-x_y", "order"), ("é.x", ""), ("..a.b", "a")]),
    "normalize_route": (text.normalize_route, [("/a/:id/*rest", "/a/{id}/{*rest}"), ("/{id}/x:y", "/{id}/x:y"), ("/", "/"), ("+", "{+}")]),
    "normalize_id": (text.normalize_id, [("http:GET:/a/:id#2", "http:GET:/a/{id}#2"), ("func:x.Y", "func:x.Y"), ("http:GET", "http:GET")]),
    "file_name": (text.file_name, [("http:GET:/a/{id}", "http-GET--a--id-")]),
    "strip_version": (text.strip_version, [("a.com/x/v2", "a.com/x"), ("a.com/v2/x", "a.com/v2/x")]),
    "camel_words": (text.camel_words, [("MinLength", "min length"), ("required", "required")]),
    "humanize": (text.humanize, [("order_item", "Order item")]),
}


@pytest.mark.parametrize("name", CASES)
def test_string_functions(spark, name):
    f, pairs = CASES[name]
    rows = spark.createDataFrame(pairs, "x string, want string").select("x", "want", f(F.col("x")).alias("got")).collect()
    assert {r.x: r.got for r in rows} == {r.x: r.want for r in rows}


def test_sql_access(spark):
    cases = {
        "SELECT a FROM public.users WHERE x": ("reads", "users"), "  insert into `Orders`(a)": ("creates", "orders"), "UPDATE t SET a": ("updates", "t"), "DELETE FROM x": ("deletes", "x"),
        'SELECT 1 FROM "public"."users"': ("reads", ""), "WITH c AS (SELECT 1 FROM a) SELECT * FROM c": ("reads", "a"), "Find": ("", ""), "SELECT 1": ("reads", ""), "x; UPDATE t SET a": ("", ""),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "q string").select("q", text.sql_access(F.col("q")).alias("s")).collect()
    assert {r.q: (r.s.verb, r.s.table) for r in rows} == cases


def test_titles(spark):
    cases = {
        "(*m/chiapi.Handler).CreateProduct": "Create product", "m/consumer.Run": "Run consumer", "main.Run": "Run main", "shop.Run": "Run", "(*m/x.UseCase).Approve": "Approve",
        "m/x.getUserID": "Get user ID", "m/x.parseJSONBody": "Parse JSON body", "Solo": "Solo",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "f string").select("f", text.flow_title(F.col("f"), F.lit("shop")).alias("t")).collect()
    assert {r.f: r.t for r in rows} == cases


def test_compact_query_never_cuts_a_character(spark):
    texts = ["a  b\n c", "é" * 3000, "x" * 4000, "x" * 4001]
    rows = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.compact_query(F.col("t")).alias("c")).collect()]
    assert rows[0] == "a b c" and rows[1] == "é" * 1998 + "..." and rows[2] == texts[2] and rows[3] == "x" * 3997 + "..."


@pytest.mark.parametrize(
    ("pattern", "package", "want"),
    [("*", "a/b", True), ("a/*", "a/b/c", True), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/b/c", False), ("std:*", "net/http", True), ("std:*", "x.com/a", False), ("dep:*", "x.com/a", True), ("dep:*", "example.com/shop/a", False),
     ("dep:x.com/*", "y.com/a", False), ("a?", "ab", True), ("a?", "a/", False), ("[ab]c", "bc", True), ("a[", "a[", True), ("std:*", "", False)],
)
def test_package_patterns(spark, pattern, package, want):
    row = spark.createDataFrame([(package,)], "p string").select(text.package_matches(F.col("p"), pattern, F.lit("example.com/shop")).alias("m")).first()
    assert row.m is want


FUNCTION = {
    "pkg": "example.com/shop/order", "short_name": "Do", "recv_type": None, "recv_chain": [], "parent_fn": None, "params": [], "results": [], "n_blocks": 4, "n_instrs": 30, "n_calls": 3, "n_control": 2, "n_invoke": 1,
    "n_module_calls": 2, "n_unknown_calls": 1, "call_pkgs": ["x"], "has_recv": False,
}
_ROW = "pkg string, short_name string, recv_type string, recv_chain array<string>, parent_fn string, params array<struct<pkg:string,type:string>>, results array<struct<pkg:string,type:string,is_error:boolean,is_bool:boolean>>, n_blocks int, n_instrs int, n_calls int, n_control int, n_invoke int, n_module_calls int, n_unknown_calls int, call_pkgs array<string>, has_recv boolean"
ERROR, VALUE = ("", "error", True, False), ("m", "T", False, False)


@pytest.mark.parametrize(
    ("name", "change"),
    [
        ("logger-method", {"short_name": "Infof", "recv_type": "myLogger"}), ("logger-package", {"pkg": "x/zap"}), ("logger-factory", {"results": [("a/slog", "Logger", False, False)]}), ("metrics-tracing", {"recv_chain": ["scoringTimings"]}),
        ("metrics-tracing", {"pkg": "go.opentelemetry.io/x"}), ("config-reader", {"pkg": "m/cfg"}), ("validation-helper", {"short_name": "checkName", "results": [ERROR]}), ("trivial-wrapper", {"n_blocks": 1, "n_calls": 1, "n_control": 0}),
        ("dto-mapper", {"short_name": "ToModel", "results": [VALUE]}), ("respond-helper", {"short_name": "RespondJSON", "params": [("net/http", "ResponseWriter")]}), ("inline-closure", {"parent_fn": "p", "n_invoke": 0, "n_module_calls": 1}),
        ("trivial-constructor", {"short_name": "NewX", "n_blocks": 1, "n_instrs": 5, "n_calls": 0, "results": [VALUE]}), ("getter", {"short_name": "GetX", "has_recv": True, "n_blocks": 1, "n_instrs": 3, "n_calls": 0}),
        ("error-wrapper", {"n_blocks": 2, "results": [ERROR], "call_pkgs": ["fmt"], "n_unknown_calls": 0}),
    ],
)
def test_heuristics(spark, name, change):
    rows = spark.createDataFrame([tuple(FUNCTION.values()), tuple((FUNCTION | change).values())], _ROW)
    assert [r[0] for r in rows.select(heuristic(name)).collect()] == [False, True]


def test_heuristics_without_facts_are_false(spark):
    row = spark.createDataFrame([tuple(None for _ in FUNCTION)], _ROW).select(*(heuristic(n).alias(n) for n in REGISTRY), handler_shaped().alias("h")).first()
    assert not any(row)


@pytest.mark.parametrize(
    ("rule", "says"),
    [("{action: drop, match: {pkg: a}}", "no id"), ("{id: a, action: drop, match: {pkg: a}}\n  - {id: a, action: drop, match: {pkg: a}}", "twice"), ("{id: a, action: x, match: {pkg: a}}", "drop or collapse"), ("{id: a, action: drop}", "matches nothing"),
     ("{id: a, action: drop, match: {heuristic: x}}", "no heuristic")],
)
def test_bad_rules_are_refused(rule, says):
    with pytest.raises(ValueError, match=says):
        parse_rules(f"rules:\n  - {rule}\n")


def test_rules_and_settings(spark, tmp_path):
    assert [r.id for r in default_rules()][:3] == ["default:context", "default:stdlib", "default:third-party"] and len(default_rules()) == 16
    assert rules_table(spark, default_rules()).count() == 16
    (tmp_path / "s.yaml").write_text("entities: {order: Sale}\nmerge: {order: [a, b]}\n")
    settings, warnings = read_settings(str(tmp_path / "s.yaml"))
    assert settings.entities == {"order": "Sale"} and not warnings
    assert settings_tables(spark, settings)["merge"].count() == 2
    (tmp_path / "bad.yaml").write_text("[")
    assert read_settings(str(tmp_path / "bad.yaml"))[1] and read_settings(str(tmp_path / "none.yaml")) == (type(settings)(), [])


def test_files_and_functions(spark):
    files = spark.createDataFrame([("a.go", "p", "package p"), ("vendor/x.go", "v", ""), ("b.pb.go", "p", ""), ("c.go", "p", "// Code generated by x. DO NOT EDIT."), ("d_test.go", "p", "")], "file string, pkg string, header string")
    classes = facts.classify_files(files)
    assert {r.file: r["class"] for r in classes.collect()} == {"a.go": "normal", "vendor/x.go": "vendor", "b.pb.go": "generated", "c.go": "generated"}
    row = facts.generated_ratio(classes).first()
    assert (row.generated, row.total, row.pct, row.warn) == (2, 4, 50, False)
    fns = spark.createDataFrame([("f", "a.go", None, "T"), ("g", None, "f", None), ("h", "b.pb.go", "g", "U")], "fn_id string, file string, parent_fn string, recv_type string")
    assert {r.fn_id: r.file_class for r in facts.function_classes(fns, classes).collect()} == {"f": "normal", "g": "normal", "h": "generated"}
    assert {r.fn_id: r.recv_chain for r in facts.receiver_chains(fns).collect()} == {"f": ["T"], "g": ["T"], "h": ["U", "T"]}
