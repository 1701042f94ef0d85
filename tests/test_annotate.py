"""Decisions, exits, gates and contracts in documents, and the command over a folder of tables."""

import json
from types import SimpleNamespace

import pytest

from flowloom import tables
from flowloom.__main__ import main
from flowloom.plans import annotate, fact_queries, scan
from tests.conftest import SMALL

M = "example.com/shop"


def fn(i, pkg, name, **more):
    row = {
        "fn_id": i, "display_name": f"{M}/{pkg}.{name}", "short_name": name, "pkg": f"{M}/{pkg}", "pos": 1, "pos_text": f"{i}.go:1", "visit": True, "file_class": "normal", "params": [], "results": [],
        "n_blocks": 4, "n_instrs": 30, "n_calls": 3, "n_control": 2, "n_invoke": 0, "n_module_calls": 2, "n_unknown_calls": 0, "call_pkgs": [f"{M}/{pkg}"], "has_recv": False, "in_module": True, "has_body": True,
    }
    return row | more


def call(caller, site, ord_, block, pos, **more):
    return {"caller": caller, "site": site, "ord": ord_, "seq": ord_ * 10, "async": False, "block": block, "pos": pos, "text_args": []} | more


def branch(f, decision, order, **more):
    return {"fn_id": f, "decision": decision, "order_pos": order, "gate": False, "mechanical": False, "fail_when": True, "uses": [], "uses_fns": []} | more


TABLES = {
    "function": [fn("h", "api", "Handle"), fn("c", "order", "Create"), fn("s", "order", "Save"), fn("k", "api", "verifyInput", results=[{"pkg": "", "type": "error", "is_error": True, "is_bool": False}])],
    "site": [
        call("h", "s1", 1, 0, "h.go:2"), call("h", "s2", 3, 2, "h.go:6"), call("c", "s3", 3, 2, "c.go:9"),
        call("c", "s4", 1, 1, "c.go:5", callee_pkg="github.com/segmentio/kafka-go", callee_type="Writer", callee_name="WriteMessages", topic="order.made"),
        call("s", "s5", 1, 0, "s.go:2", callee_pkg="database/sql", callee_type="DB", callee_name="Exec", text_args=[{"is_string": True, "value": "INSERT INTO orders VALUES (1)"}]),
    ],
    "callee": [{"site": a, "callee": b, "callee_ord": 1, "resolution": "static"} for a, b in (("s1", "k"), ("s2", "c"), ("s3", "s"))],
    "entrypoint": [{"id": "http:POST:/orders", "kind": "http", "method": "POST", "path": "/orders", "fn_id": "h"}],
    "branch": [
        branch("h", "h.go:3", 20, exit={"kind": "message", "message": "HTTP 400 · bad", "pos": "h.go:4", "at": 21}, cond_text="err != nil", uses=["verifyInput"], uses_fns=["k"], pass_b=2, skip_b=1),
        branch("h", "h.go:7", 40, exit={"kind": "unknown"}, cond_text="err != nil", pass_b=3, skip_b=4),
        branch("c", "c.go:4", 5, gate=True, fail_when=False, cond_text="notify", pass_b=1, skip_b=2),
        branch("c", "c.go:10", 50, mechanical=True, exit={"kind": "sentinel", "name": "ErrGone"}, cond_text="err != nil", failed_fn="s"),
    ],
    "block": [
        {"fn_id": f, "b": b, "pre": pre, "post": post, "n_preds": n}
        for f, b, pre, post, n in (("h", 0, 0, 9, 0), ("h", 1, 1, 2, 1), ("h", 2, 3, 8, 1), ("h", 3, 4, 5, 1), ("h", 4, 6, 7, 1), ("c", 0, 0, 5, 0), ("c", 1, 1, 2, 1), ("c", 2, 3, 4, 2), ("s", 0, 0, 1, 0))
    ],
    "outcome": [{"fn_id": "h", "ord": 1, "text": '"HTTP 400 · bad"'}, {"fn_id": "h", "ord": 2, "text": "error"}, {"fn_id": "c", "ord": 1, "text": "ErrGone"}],
    "response": [{"fn_id": "h", "ord": 1, "status": 201}],
    "contract": [{"fn_id": "h", "side": "request", "type": "api.Order", "format": "json"}],
    "field": [{"fn_id": "h", "side": "request", "ord": i, "name": n, "tag": t, "type": "string", "exported": True, "embedded_struct": False, "rules": r} for i, n, t, r in ((1, "Name", 'json:"name" validate:"required"', "length(1, 9)"), (2, "X", 'json:"-"', None))],
}


@pytest.fixture
def folder(tmp_path):
    for name, rows in TABLES.items():
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    return tmp_path


def test_decisions_in_documents(spark, folder):
    t = scan.read_tables(spark, str(folder))
    doc = json.loads(scan.scan(t, M).first().doc)
    by = {n["func"]: n for n in doc["nodes"]}
    names = {n["id"]: n["func"] for n in doc["nodes"]} | {"entrypoint": "entry"}
    edges = {(names[e["from"]], names[e["to"]]): (e.get("kind"), e.get("label")) for e in doc["edges"]}
    first, gate, out = "decision:api.Handle:h.go:3", "decision:order.Create:c.go:4", 'exit:"HTTP 400 · bad"'
    # the call that a shown condition uses is there although a rule drops it
    assert edges == {
        ("entry", "api.verifyInput"): (None, None), ("entry", first): (None, None), (first, out): ("fail", "true"), (first, "order.Create"): ("pass", "false"),
        ("order.Create", gate): (None, None), ("order.Create", "order.Save"): (None, None),
    }
    assert by[first]["condition"] == "err != nil" and by[first]["uses"] == ["verifyInput"] and "gate" not in by[first]
    assert by[out]["error"] == {"kind": "message", "message": "HTTP 400 · bad", "pos": "h.go:4"}
    assert by[gate]["gate"] and [e["topic"] for e in by[gate]["effects"]] == ["order.made"] and "effects" not in by["order.Create"]
    assert by["order.Save"]["fallible"] and "error_exits" not in by["order.Create"]
    entry = doc["entrypoint"]
    assert entry["error_exits"] == ["error"] and entry["success"] == "201 Created"
    assert entry["request"] == {"type": "api.Order", "format": "json", "fields": [{"name": "Name", "tag": "name", "type": "string", "rules": "required, length(1, 9)"}]}
    assert doc["stats"]["raw_nodes"] == 3 and doc["stats"]["kept_nodes"] == 6


def test_the_command(spark, folder, capsys, tmp_path):
    facts, out = str(folder), str(tmp_path / "out")
    assert main(["scan", facts, "--module", M]) == 0 and capsys.readouterr().out == f"http:POST:/orders\t{M}/api.Handle\th.go:1\n"
    assert main(["scan", facts, "--module", M, "--out", out, "--entry", "/orders", "--html", str(tmp_path / "p.html")]) == 0
    assert capsys.readouterr().out == "http-POST--orders.json\n"
    index = json.loads((tmp_path / "out" / "index.json").read_text())
    assert [e["key"] for e in index["entities"]] == ["order"] and "http:POST:/orders" in (tmp_path / "p.html").read_text()
    assert main(["scan", facts, "--module", M, "--entry", "nothing"]) == 2
    (folder / "callee.json").unlink()
    with pytest.raises(FileNotFoundError):
        main(["scan", facts, "--module", M])


def test_no_table_of_flows_goes_through_the_driver(spark, monkeypatch):
    plans = []

    def keep(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return tables.keep(df, label)

    monkeypatch.setattr(annotate, "tables", SimpleNamespace(keep=keep))
    assert fact_queries.q61_annotated_flows(spark, SMALL).count() > 0
    assert len(plans) > 10 and [label for label, plan in plans if "Broadcast" in plan] == []
