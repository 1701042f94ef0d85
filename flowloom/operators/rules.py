"""The filter: ordered rules, passes over whole flows, contraction and accounting.

nodes: flow_id, node, name, pkg, short_name, kind, depth, bfs_ord, has_effects, kept (immune), dropped_by
(null, or what the node came with), and the facts that heuristics read. edges: flow_id, src, dst,
seq, async, kind, label. The root has depth 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import tables
from flowloom.functions.predicates import heuristic
from flowloom.functions.text import function_base_name, glob, package_matches
from flowloom.operators.graph import reachable, strictly_above
from flowloom.sources.rules import Rule

NO_EFFECT, BEYOND, EMPTY_GATE = "engine:no-effect-subtree", "engine:beyond-narrative", "engine:empty-gate"
#: Levels that stay without an effect below them, and most nodes of a flow to be read.
NARRATIVE_DEPTH, NARRATIVE_NODES = 2, 40


def rule_applies(rule: Rule, module: Column) -> Column:
    """Whether all criteria of a rule hold for a node."""
    found = F.lit(True)
    if rule.pkg:
        found = found & F.greatest(*(package_matches(F.coalesce("pkg", F.lit("")), p, module) for p in rule.pkg), F.lit(False))
    if rule.func:
        name = function_base_name(F.col("short_name"), F.col("name"))
        found = found & F.greatest(*(glob(name, p) for p in rule.func), F.lit(False))
    if rule.heuristic:
        found = found & heuristic(rule.heuristic)
    return F.coalesce(found, F.lit(False))


def first_match(rules: list[Rule], module: Column) -> Column:
    """(id, action) of the first rule that applies, null if none: rules are few, so they are compiled into one expression."""
    cases = [F.when(rule_applies(r, module), F.struct(F.lit(r.id).alias("id"), F.lit(r.action).alias("action"))) for r in rules]
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<id:string,action:string>")


def apply_rules(nodes: DataFrame, rules: list[Rule], module: str) -> DataFrame:
    """Marks nodes that are neither immune nor marked: dropped_by, collapse."""
    free = ~F.col("kept") & F.col("dropped_by").isNull() & (F.col("depth") > 0)
    match = nodes.withColumn("_rule", F.when(free, first_match(rules, F.lit(module))))
    return match.withColumn("collapse", F.coalesce(F.col("_rule.action") == "collapse", F.lit(False))).withColumn("dropped_by", F.coalesce("dropped_by", "_rule.id")).drop("_rule")


def _flag(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """nodes with a boolean: whether (flow_id, node) is in ``found``."""
    return nodes.join(found.select("flow_id", "node", F.lit(True).alias(name)), ["flow_id", "node"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mark_without_effect(nodes: DataFrame, edges: DataFrame, depth: int = NARRATIVE_DEPTH) -> DataFrame:
    """Unmarked steps below ``depth`` that have no effect under them go."""
    anchored = strictly_above(edges, nodes.where("has_effects").select("flow_id", "node"), ["flow_id"])
    rows = _flag(nodes, anchored, "_anchored")
    goes = ~F.col("kept") & F.col("dropped_by").isNull() & ~F.col("_anchored") & (F.col("depth") > depth) & (F.col("kind") != "terminal")
    return rows.withColumn("dropped_by", F.when(goes, NO_EFFECT).otherwise(F.col("dropped_by"))).drop("_anchored")


def protect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dropped nodes that lead to what is kept are kept: effects, or unmarked nodes that are no terminals."""
    base = nodes.where("has_effects or (dropped_by is null and kind != 'terminal')").select("flow_id", "node")
    rows = _flag(nodes, strictly_above(edges, base, ["flow_id"]), "_above")
    saved = F.col("dropped_by").isNotNull() & ~F.col("collapse") & F.col("_above")
    return rows.withColumn("dropped_by", F.when(~saved, F.col("dropped_by"))).drop("_above")


def budget_depth(nodes: DataFrame, keys: list[str], most: int = NARRATIVE_NODES) -> DataFrame:
    """keys and fit_depth: for flows of more than ``most`` nodes (keys, depth), the largest depth up to which they fit, 1 at least."""
    levels = nodes.groupBy(*keys, "depth").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    levels = levels.withColumn("run", F.sum("n").over(w.orderBy("depth"))).withColumn("total", F.sum("n").over(w))
    # levels are cut at the first that does not fit, so later ones cannot fit again
    return levels.where(F.col("total") > most).groupBy(*keys).agg(F.greatest(F.lit(1), F.coalesce(F.max(F.when(F.col("run") <= most, F.col("depth"))), F.lit(1))).alias("fit_depth"))


def fit_to_budget(nodes: DataFrame, most: int = NARRATIVE_NODES) -> DataFrame:
    """Surviving nodes beyond the depth that fits are collapsed, those with effects too."""
    alive = nodes.where("dropped_by is null and depth > 0").select("flow_id", "depth")
    rows = nodes.join(budget_depth(alive, ["flow_id"], most), "flow_id", "left")
    beyond = F.coalesce(F.col("dropped_by").isNull() & (F.col("depth") > F.col("fit_depth")), F.lit(False))
    return rows.withColumns({"dropped_by": F.when(beyond, BEYOND).otherwise(F.col("dropped_by")), "collapse": F.col("collapse") | beyond}).drop("fit_depth")


def mark(nodes: DataFrame, edges: DataFrame, rules: list[Rule], module: str) -> DataFrame:
    """All passes in order: rules, effect-free subtrees, protection, budget."""
    marked = tables.keep(apply_rules(nodes, rules, module), "marked")
    marked = tables.keep(mark_without_effect(marked, edges), "marked")
    return fit_to_budget(tables.keep(protect(marked, edges), "marked"))


# ---------------------------------------------------------------- contraction


def splice(edges: DataFrame, collapsed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges between surviving nodes once collapsed ones (keys, node) are contracted: a set form.

    Each surviving source is joined to what it reaches through collapsed nodes alone; seq of the first hop, and the
    collapsed nodes on the way; async if a hop is, or if a node on the way is reached async from anywhere. edges: keys,
    src, dst, seq, async. A round holds one row for each source and node, however many ways lead there; only rows
    that changed go on.
    """
    keys = keys or []
    pair = [*keys, "src", "dst"]
    gone = tables.keep(collapsed.select(*keys, "node").distinct(), "collapsed")
    at_gone = lambda c: gone.withColumnRenamed("node", c)
    edges = tables.keep(edges.groupBy(*pair).agg(F.min("seq").alias("seq"), F.bool_or("async").alias("async")), "splice-edges")
    inner = edges.join(at_gone("src"), [*keys, "src"], "left_semi")
    late = edges.where("async").select(*keys, F.col("dst").alias("node")).join(gone, [*keys, "node"], "left_semi")
    late = reachable(inner.join(at_gone("dst"), [*keys, "dst"], "left_semi"), late, keys).withColumns({"src": F.col("node"), "late": F.lit(True)}).drop("node")
    inner = inner.join(late, [*keys, "src"], "left").select(*keys, F.col("src").alias("mid"), F.col("dst").alias("next"), (F.col("async") | F.coalesce("late", F.lit(False))).alias("later"))
    inner = tables.keep(inner, "splice-inner")

    def merged(rows: DataFrame) -> DataFrame:
        names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("via"))))
        return rows.groupBy(*pair).agg(F.min("seq").alias("seq"), F.bool_or("async").alias("async"), names.alias("via"))

    start = edges.join(at_gone("src"), [*keys, "src"], "left_anti").withColumn("via", F.array().cast("array<string>"))
    whole = start.join(at_gone("dst"), [*keys, "dst"], "left_anti").select(*pair, "seq", "async", "via")
    state = front = tables.keep(start.join(at_gone("dst"), [*keys, "dst"], "left_semi").select(*pair, "seq", "async", "via"), "splice")
    while not front.isEmpty():
        ahead = front.withColumnRenamed("dst", "mid").join(inner, [*keys, "mid"])
        ahead = ahead.select(*keys, "src", F.col("next").alias("dst"), "seq", (F.col("async") | F.col("later")).alias("async"), F.array_union("via", F.array(F.col("mid").cast("string"))).alias("via"))
        new = merged(ahead.join(at_gone("dst"), [*keys, "dst"], "left_semi").select(*pair, "seq", "async", "via").unionByName(state))
        new = tables.keep(new, "splice")
        old = state.select(*pair, F.struct("seq", "async", F.size("via").alias("n")).alias("_old"))
        same = F.coalesce(F.col("_old") == F.struct("seq", "async", F.size("via").alias("n")), F.lit(False))
        front, state = tables.keep(new.join(old, pair, "left").where(~same).drop("_old"), "splice"), new
    ends = state.withColumnRenamed("dst", "mid").join(inner, [*keys, "mid"])
    ends = ends.select(*keys, "src", F.col("next").alias("dst"), "seq", (F.col("async") | F.col("later")).alias("async"), F.array_union("via", F.array(F.col("mid").cast("string"))).alias("via"))
    return merged(whole.unionByName(ends.join(at_gone("dst"), [*keys, "dst"], "left_anti").select(*whole.columns)).where("src != dst"))


_EFFECT = "struct<type:string,detail:string,topic:string,topic_expr:string,pos:string,async:boolean,alt:boolean>"
PRUNED = (
    f"flow_id string, nodes array<struct<node:string,ord:int,collapsed:array<string>,effects:array<{_EFFECT}>>>, "
    "edges array<struct<src:string,dst:string,ord:int,seq:long,async:boolean,kind:string,label:string>>, dropped map<string,int>"
)


class _Flow:
    """One marked flow, contracted step by step: the order of the steps matters here."""

    def __init__(self, nodes: list[dict], edges: list[dict]) -> None:
        self.nodes = {n["node"]: n for n in sorted(nodes, key=lambda n: n["bfs_ord"])}
        self.out: dict[str, dict[str, dict]] = {n: {} for n in self.nodes}
        self.into: dict[str, dict[str, None]] = {n: {} for n in self.nodes}
        for e in sorted(edges, key=lambda e: e["ord"]):
            if e["src"] in self.out and e["dst"] in self.out:
                self.out[e["src"]][e["dst"]] = {k: e[k] for k in ("seq", "async", "kind", "label")}
                self.into[e["dst"]][e["src"]] = None
        #: Nodes that are reached async on some way.
        self.late = {n for n in self.nodes if any(self.out[p][n]["async"] for p in self.into[n])}
        self.counts: dict[str, int] = {}

    def detach(self, node: str, rule: str) -> None:
        self.counts[rule] = self.counts.get(rule, 0) + 1
        for parent in self.into[node]:
            self.out[parent].pop(node, None)
        for child in self.out[node]:
            self.into[child].pop(node, None)
        self.out[node], self.into[node] = {}, {}

    def inline(self, node: str) -> None:
        """Hand the callees, effects and names of a collapsed node to its callers."""
        own = self.nodes[node]
        for parent in list(self.into[node]):
            upper = self.nodes[parent]
            if upper["dropped_by"] and not upper["collapse"]:
                continue
            if own["dropped_by"] != BEYOND:
                upper["collapsed"] += [own["inline_name"], *own["collapsed"]]
            have = {(e["type"], e["detail"], e["topic"]): e for e in upper["effects"]}
            for e in own["effects"]:
                if (known := have.get((e["type"], e["detail"], e["topic"]))) is not None:
                    known["async"] = known["async"] or e["async"]
                else:
                    upper["effects"].append(dict(e))
            hop = self.out[parent][node]
            for child, way in list(self.out[node].items()):
                if child == parent:
                    continue
                edge = self.out[parent].setdefault(child, {"seq": 0, "async": False, "kind": None, "label": None})
                self.into[child].setdefault(parent)
                edge["async"] = edge["async"] or hop["async"] or way["async"] or node in self.late
                if edge["async"]:
                    self.late.add(child)
                edge["seq"] = min((s for s in (edge["seq"], hop["seq"]) if s), default=0)
                if hop["kind"]:
                    edge["kind"], edge["label"] = hop["kind"], hop["label"]

    def prune(self) -> list[str]:
        """Contract and drop what is marked; the nodes that are left, in the order of a search from the root."""
        marked = [n for n, x in self.nodes.items() if x["depth"] > 0 and x["dropped_by"]]
        for n in marked:
            if self.nodes[n]["collapse"]:
                self.inline(n)
                self.detach(n, self.nodes[n]["dropped_by"])
        for n in marked:
            if not self.nodes[n]["collapse"]:
                self.detach(n, self.nodes[n]["dropped_by"])
        order = [n for n, x in self.nodes.items() if x["depth"] == 0]
        seen = set(order)
        for n in order:
            for child in self.out[n]:
                if child not in seen:
                    seen.add(child)
                    order.append(child)
        for n in list(order):
            x = self.nodes[n]
            if x["gate"] and not self.out[n] and not x["effects"]:
                self.detach(n, EMPTY_GATE)
                order.remove(n)
        return order


def prune(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Contracted flows (PRUNED), one row for each: nodes in order, edges, removed nodes by rule.

    Contraction depends on the order of the steps, so each flow is worked on as a whole; a flow has at
    most ``MAX_NODES`` nodes. nodes also has gate, inline_name, effects (array); edges also has ord, the place
    of the edge among those of its source.
    """
    known = nodes.schema["effects"].dataType.elementType.names
    alt = lambda e: e["alt"] if "alt" in known else F.lit(False)
    effects = F.transform(
        F.coalesce("effects", F.array()), lambda e: F.struct(*(e[c].alias(c) for c in ("type", "detail", "topic", "topic_expr", "pos", "async")), alt(e).alias("alt"))
    )
    node = F.struct("node", "bfs_ord", "depth", "dropped_by", "collapse", "gate", "inline_name", effects.alias("effects"))
    edge = F.struct("src", "dst", "ord", "seq", "async", "kind", "label")
    whole = nodes.groupBy("flow_id").agg(F.collect_list(node).alias("nodes"))
    whole = whole.join(edges.groupBy("flow_id").agg(F.collect_list(edge).alias("edges")), "flow_id", "left")
    whole = whole.select("flow_id", F.to_json("nodes", {"ignoreNullFields": "false"}).alias("nodes"), F.to_json("edges", {"ignoreNullFields": "false"}).alias("edges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for flow_id, ns, es in batch.itertuples(index=False):
                flow = _Flow([{**n, "collapsed": []} for n in json.loads(ns)], json.loads(es) if es else [])
                order = flow.prune()
                place = {n: i for i, n in enumerate(order)}
                rows.append(
                    {
                        "flow_id": flow_id,
                        "nodes": [{"node": n, "ord": i, "collapsed": flow.nodes[n]["collapsed"], "effects": flow.nodes[n]["effects"]} for i, n in enumerate(order)],
                        "edges": [{"src": n, "dst": d, "ord": i, **e} for n in order for i, (d, e) in enumerate(flow.out[n].items()) if d in place],
                        "dropped": flow.counts,
                    }
                )
            yield pd.DataFrame(rows, columns=["flow_id", "nodes", "edges", "dropped"])

    return whole.mapInPandas(run, PRUNED)


def drop_counts(marked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rule id and the number of nodes it removed."""
    return marked.where("dropped_by is not null").groupBy(*(keys or []), "dropped_by").agg(F.count("*").alias("n"))


def kept_after_drop(edges: DataFrame, dropped: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys and node of what the roots still reach once dropped nodes are detached."""
    keys = keys or []
    gone = dropped.select(*keys, "node")
    left = edges.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti")
    return reachable(left, roots, keys)
