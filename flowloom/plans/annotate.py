"""Decisions in flows: a marked flow gets its decisions and exits as nodes, between marking and contraction.

A step leads to its decisions in source order, a decision fails to an exit and passes to what its passing block
dominates; a gate has no exit and holds the work of its block. All flows are annotated together: what one step
gets depends on that step's branches, calls and effects alone, and on the room that is left in its flow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowloom import tables
from flowloom.operators import graph, guards
from flowloom.operators.values import without_claimed

AT = ["flow_id", "node"]
EXIT = "struct<kind:string,name:string,message:string,pos:string,at:bigint>"
#: Branches of functions that :func:`annotate` reads. decision is the position of the statement, order_pos its order; cond_text
#: is null where no ``if`` stands in the source; uses are names shown, uses_fns and failed_fn functions.
FOUND = (
    f"fn_id string, decision string, order_pos bigint, gate boolean, mechanical boolean, fail_when boolean, exit {EXIT}, cond_text string, "
    "uses array<string>, uses_fns array<string>, checks string, pass_b int, skip_b int, failed_fn string"
)
BLOCKS = "fn_id string, b int, pre int, post int, n_preds int"
#: What the document shows of a decision or an exit.
SHOWN = ["condition", "uses", "checks", "is_gate", "branch", "error"]


@dataclass(frozen=True)
class Annotated:
    """nodes and edges as before with those of decisions, and per node the exits shown elsewhere (claimed), fallible, overflow."""

    nodes: DataFrame
    edges: DataFrame
    badges: DataFrame


def _apart(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sorting: Parquet and shuffled rows of flows are many times smaller than in memory, so Spark would take them for small and send them through the driver."""
    return df.hint("merge")


def _sides(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (fn_id, pass_b, skip_b) with the numbers of both blocks; alone: a block that nothing else leads to."""
    for name in ("pass", "skip"):
        one = blocks.select("fn_id", F.col("b").alias(f"{name}_b"), F.col("pre").alias(f"{name}_pre"), F.col("post").alias(f"{name}_post"), (F.col("n_preds") <= 1).alias(f"{name}_alone"))
        rows = rows.join(_apart(one), ["fn_id", f"{name}_b"], "left")
    return rows


def _within(side: str) -> Column:
    return F.coalesce((F.col(f"{side}_pre") <= F.col("b_pre")) & (F.col("b_post") <= F.col(f"{side}_post")), F.lit(False))


def _swapped(rows: DataFrame, swap: Column) -> DataFrame:
    """rows with the two sides exchanged where ``swap`` holds."""
    ends = ("b", "pre", "post", "alone")
    new = {}
    for a, b in (("pass", "skip"), ("skip", "pass")):
        new |= {f"{a}_{e}": F.when(swap, F.col(f"{b}_{e}")).otherwise(F.col(f"{a}_{e}")) for e in ends}
    return rows.withColumns(new)


def worth_showing(rows: DataFrame, calls: DataFrame, work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unshown): branches that have something to tell, and how many of each node have no name for it.

    rows: flow_id, node and FOUND with sides; calls: flow_id, node, b_pre, b_post and below (an effect under the callee); work:
    flow_id, node, b_pre, b_post of calls and effects that are seen. A gate needs work on a side: on both it is a branch, on the skipping side
    alone the sides change places. Other branches need a named outcome and a condition in the source. bonus: 1 where a branch keeps an effect.
    """
    side = lambda s: F.bool_or(_within(s) & F.col(f"{s}_alone"))
    gates = rows.where("gate")
    works = gates.join(_apart(work), AT).groupBy(*AT, "decision").agg(side("pass").alias("p"), side("skip").alias("s"))
    sides = guards.gate_sides(F.coalesce("p", F.lit(False)), F.coalesce("s", F.lit(False)))
    gates = gates.join(_apart(works), [*AT, "decision"], "left").withColumn("_g", sides).where("_g.keep")
    swap = F.col("_g.fail_when")
    gates = _swapped(gates.withColumn("fail_when", F.when(F.col("_g.branch"), F.col("fail_when")).otherwise(swap)).withColumn("branch", F.col("_g.branch")), swap).drop("_g", "p", "s")
    gates = gates.withColumn("bonus", F.lit(0))
    named = F.coalesce((F.col("exit.kind") != "unknown") & F.col("cond_text").isNotNull(), F.lit(False))
    others = rows.where("not gate").withColumn("named", named)
    keeps = others.where("named").join(_apart(calls.where("below")), AT).where(_within("pass")).select(*AT, "decision").distinct().withColumn("bonus", F.lit(1))
    told = others.where("named").drop("named").withColumn("branch", F.lit(False)).join(_apart(keeps), [*AT, "decision"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0)))
    return gates.unionByName(told), others.where("not named").groupBy(*AT).agg(F.count("*").alias("unshown"))


def annotate(marked: DataFrame, edges: DataFrame, found: DataFrame, blocks: DataFrame) -> Annotated:
    """marked (of rules.mark, with name, pkg, effects that hold block) and edges (with site, a block) with the decisions of ``found``.

    found: FOUND; blocks: BLOCKS. Functions that a shown decision uses come back if they were dropped. Of equal exits a flow has one.
    """
    found = tables.keep(_sides(found, blocks), "branches")
    alive = marked.where("kind = 'step' and dropped_by is null").select(*AT, "name", "pkg", "depth", "bfs_ord")
    rows = tables.keep(alive.join(_apart(found.withColumnRenamed("fn_id", "node")), "node"), "branches")
    effective = marked.where("has_effects").select(*AT)
    above = graph.strictly_above(edges, effective, ["flow_id"]).select("flow_id", F.col("node").alias("dst"), F.lit(True).alias("below"))
    seen = marked.select("flow_id", F.col("node").alias("dst"), (F.col("dropped_by").isNull() | F.col("has_effects")).alias("seen"))
    at = blocks.select(F.col("fn_id").alias("node"), F.col("b").alias("site"), F.col("pre").alias("b_pre"), F.col("post").alias("b_post"))
    calls = edges.withColumnRenamed("src", "node").join(_apart(rows.select(*AT).distinct()), AT, "left_semi").join(_apart(at), ["node", "site"]).join(_apart(seen), ["flow_id", "dst"]).join(_apart(above), ["flow_id", "dst"], "left")
    calls = tables.keep(calls.withColumn("below", F.coalesce("below", F.lit(False))).withColumn("seen", F.col("seen") | F.col("below")), "calls")
    uses = marked.select(*AT, F.explode("effects").alias("effect")).withColumn("site", F.col("effect.block")).join(_apart(at), ["node", "site"], "left")
    uses = tables.keep(uses.join(_apart(rows.select(*AT).distinct()), AT, "left_semi"), "uses")
    work = calls.where("seen").select(*AT, "b_pre", "b_post").unionByName(uses.where("b_pre is not null").select(*AT, "b_pre", "b_post")).distinct()

    told, unshown = worth_showing(rows.where("not mechanical"), calls, work)
    used = marked.groupBy("flow_id").agg((1 + F.count_if((F.col("depth") > 0) & F.col("dropped_by").isNull())).alias("used"))
    fits, left = guards.fit_decisions(told.withColumn("exit_kind", F.col("exit.kind")), used)
    own = F.concat(F.lit("decision:"), "name", F.lit(":"), "decision")
    chosen = tables.keep(fits.withColumn("id", own), "chosen")

    # decisions of a step in order, and where its calls go
    short = chosen.select(*AT, F.col("id").alias("decision"), F.col("order_pos").alias("ord"), "gate", "branch", "fail_when", F.col("pass_pre").alias("pre"), F.col("pass_post").alias("post"), "skip_pre", "skip_post")
    chain, targets = guards.attach(short, calls.select(*AT, F.col("dst").alias("call"), "b_pre", "b_post"), AT)
    chain = tables.keep(chain, "chain")
    targets = tables.keep(targets.select("flow_id", F.col("node").alias("src"), F.col("call").alias("dst"), "decision", F.col("kind").alias("to_kind"), F.col("label").alias("to_label")), "targets")
    exit_of = lambda c: F.concat(F.lit("exit:"), guards.exit_display(F.col(c)))
    exits = chosen.where("not gate").withColumn("exit_id", exit_of("exit"))

    moved = edges.join(_apart(targets), ["flow_id", "src", "dst"], "left")
    to = F.col("decision").isNotNull()
    moved = moved.withColumns({"src": F.coalesce("decision", "src"), "kind": F.when(to, F.col("to_kind")).otherwise(F.col("kind")), "label": F.when(to, F.col("to_label")).otherwise(F.col("label"))})
    plain = moved.select("flow_id", "src", "dst", F.col("seq").cast("long").alias("seq"), "async", "kind", "label")
    first = F.when(F.col("src").isNull(), F.col("node")).otherwise(F.col("src"))
    places = chosen.select("flow_id", F.col("id").alias("dst"), F.col("order_pos").alias("seq"))
    links = chain.join(_apart(places), ["flow_id", "dst"]).select("flow_id", first.alias("src"), "dst", "seq", F.lit(False).alias("async"), "kind", "label")
    fails = exits.select("flow_id", F.col("id").alias("src"), F.col("exit_id").alias("dst"), F.coalesce("exit.at", F.lit(0)).cast("long").alias("seq"), F.lit(False).alias("async"), F.lit("fail").alias("kind"), F.col("fail_when").cast("string").alias("label"))
    ways = tables.keep(plain.unionByName(links).unionByName(fails), "ways")

    # effects of a gated block move to the first gate that holds it
    gates = chosen.where("gate").select(*AT, "id", "order_pos", "pass_pre", "pass_post")
    held = uses.join(_apart(gates), AT).where(_within("pass")).groupBy(*AT, "effect").agg(F.min_by("id", F.struct("order_pos", "id")).alias("id"))
    held = tables.keep(held, "held")
    ordered = lambda by: F.array_sort(F.collect_list("effect"))
    moved_to = held.groupBy("flow_id", "id").agg(ordered("effect").alias("effects"))
    taken = held.groupBy(*AT).agg(F.collect_list("effect").alias("taken"))

    shown = F.struct(F.col("exit.kind"), F.col("exit.name"), F.col("exit.message"), F.nullif(F.col("exit.pos"), F.lit("")).alias("pos"))
    none = lambda t: F.lit(None).cast(t)
    error = "struct<kind:string,name:string,message:string,pos:string>"
    cards = chosen.join(_apart(moved_to), ["flow_id", "id"], "left").select(
        "flow_id", F.col("id").alias("node"), F.lit("decision").alias("kind"), (F.col("depth") + 1).alias("depth"), "pkg", F.col("decision").alias("pos_text"), "effects", "gate",
        F.col("cond_text").alias("condition"), "uses", "checks", F.col("gate").alias("is_gate"), "branch", none(error).alias("error"),
    )
    begin = F.struct("depth", "bfs_ord", "order_pos")
    ends = exits.groupBy("flow_id", "exit_id").agg(F.min_by(F.struct((F.col("depth") + 2).alias("depth"), "pkg", F.col("exit.pos").alias("pos_text"), shown.cast(error).alias("error")), begin).alias("e"))
    ends = ends.select(
        "flow_id", F.col("exit_id").alias("node"), F.lit("exit").alias("kind"), "e.depth", "e.pkg", "e.pos_text", none(marked.schema["effects"].dataType).alias("effects"), F.lit(False).alias("gate"),
        none("string").alias("condition"), none("array<string>").alias("uses"), none("string").alias("checks"), F.lit(False).alias("is_gate"), F.lit(False).alias("branch"), "e.error",
    )
    busy = ways.select("flow_id", F.col("src").alias("node")).distinct().withColumn("_busy", F.lit(True))
    cards = cards.join(_apart(busy), AT, "left").where("not gate or _busy or effects is not null").drop("_busy")
    last = 2**30  # behind all nodes of the search; their order is that of their edges in the end
    new = cards.unionByName(ends).withColumns(
        {
            "resolution": F.lit("static"), "bfs_ord": F.lit(last), "name": F.col("node"), "inline_name": F.col("node"), "dropped_by": none("string"), "collapse": F.lit(False), "kept": F.lit(True),
            "has_effects": F.coalesce(F.size("effects") > 0, F.lit(False)),
        }
    )

    evidence = chosen.select("flow_id", F.explode("uses_fns").alias("node")).distinct().withColumn("_evidence", F.lit(True))
    old = marked.join(_apart(taken), AT, "left").join(_apart(evidence), AT, "left")
    back = F.col("_evidence") & (F.col("depth") > 0)
    rest = F.when(F.col("taken").isNull(), F.col("effects")).otherwise(F.filter("effects", lambda e: ~F.array_contains(F.col("taken"), e)))
    old = old.withColumns({"effects": rest, "dropped_by": F.when(~F.coalesce(back, F.lit(False)), F.col("dropped_by")), "collapse": F.col("collapse") & ~F.coalesce(back, F.lit(False))}).drop("taken", "_evidence")
    nodes = tables.keep(old.unionByName(new, allowMissingColumns=True), "annotated")
    ways = ways.join(_apart(nodes.select("flow_id", F.col("node").alias("dst"))), ["flow_id", "dst"], "left_semi").join(_apart(nodes.select("flow_id", F.col("node").alias("src"))), ["flow_id", "src"], "left_semi")

    mechanical = rows.where("mechanical")
    failing = mechanical.select("flow_id", F.col("node").alias("caller"), "failed_fn").where("failed_fn is not null").distinct()
    there = marked.where("depth > 0").select("flow_id", F.col("node").alias("failed_fn"), F.col("node").alias("hit"))
    fallible = failing.join(_apart(there), ["flow_id", "failed_fn"], "left").select("flow_id", F.coalesce("hit", "caller").alias("node")).distinct().withColumn("fallible", F.lit(True))
    told_exits = chosen.where("not gate").select(*AT, F.trim(guards.exit_display(F.col("exit"))).alias("k")).unionByName(mechanical.where("exit.kind != 'unknown'").select(*AT, F.trim(guards.exit_display(F.col("exit"))).alias("k")))
    claimed = told_exits.groupBy(*AT).agg(F.collect_set("k").alias("claimed"))
    overflow = unshown.join(_apart(left), AT, "full").select(*AT, (F.coalesce("unshown", F.lit(0)) + F.coalesce("overflow", F.lit(0))).cast("int").alias("checks_overflow"))
    badges = claimed.join(_apart(fallible), AT, "full").join(_apart(overflow), AT, "full")
    return Annotated(nodes, tables.keep(ways, "ways"), tables.keep(badges, "badges"))


def exits_left(exits: Column, claimed: Column) -> Column:
    """Exits of a node that no decision shows."""
    return F.when(claimed.isNull(), exits).otherwise(without_claimed(exits, claimed))
