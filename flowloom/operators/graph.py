"""Graphs as edge tables: reachability, breadth-first search, call resolution, edge upserts.

Loops advance all seeds (all flows) in the same round. Edges are written once, and each round
writes its new rows to the shared folder, so no plan grows with the rounds, and the driver only
learns whether there were any. Visited rows are one scan of the rounds; a round is a join and an
anti join on keys. Reachability needs no depths, so on deep graphs it takes several steps a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import tables

#: Most levels of a flow, most nodes of it, and most implementations that an unresolved call falls back to.
MAX_DEPTH, MAX_NODES, MAX_FALLBACK = 40, 5000, 5
#: Functions in the cone above which the coarse call graph is used.
MAX_CONE = 20_000
#: Rounds of one step after which a graph counts as deep, and the steps of a round from then on.
SHALLOW, DEEP_STEPS = 8, 6


def bfs(edges: DataFrame, seeds: DataFrame, keys: list[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """keys, node, depth of all nodes within ``max_depth`` steps of the seeds, each at its least depth.

    edges: keys, src, dst; seeds: keys, node. ``keys`` (such as flow_id) keep graphs apart.
    """
    keys = keys or []
    spark = edges.sparkSession
    edges = tables.keep(edges.select(*keys, "src", "dst").distinct(), "edges")
    rounds = tables.Rounds(spark, "bfs")
    frontier = rounds.add(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        step = frontier.select(*keys, F.col("node").alias("src")).join(edges, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = rounds.add(step.join(rounds.all(spark), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
    return rounds.all(spark)


def reachable(edges: DataFrame, seeds: DataFrame, keys: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """keys and node of all that the seeds reach, themselves included; with ``reverse`` all that reach them.

    Edges that are a kept table are read as they are, others are written once.
    """
    keys, whole = keys or [], edges
    spark = edges.sparkSession
    ends = ("dst", "src") if reverse else ("src", "dst")
    edges = edges.select(*keys, F.col(ends[0]).alias("node"), F.col(ends[1]).alias("next"))
    edges = tables.keep(edges.distinct(), "edges") if not hasattr(whole, "_scratch_path") else edges
    rounds = tables.Rounds(spark, "reach")
    frontier = rounds.add(seeds.select(*keys, "node").distinct())
    while not frontier.isEmpty():
        level = frontier
        for _ in range(1 if rounds.n <= SHALLOW else DEEP_STEPS):
            ahead = F.explode(F.array("node", F.coalesce("next", "node"))).alias("node")
            level = level.join(edges, [*keys, "node"], "left").select(*keys, ahead).distinct()
        frontier = rounds.add(level.join(rounds.all(spark), [*keys, "node"], "left_anti"))
    return rounds.all(spark)


def strictly_above(edges: DataFrame, marked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys and node of all that have a marked node strictly below them, on cycles too."""
    keys = keys or []
    edges = tables.keep(edges.select(*keys, "src", "dst").distinct(), "edges")
    there = reachable(edges, marked, keys, reverse=True).withColumnRenamed("node", "dst")
    return edges.join(there.hint("merge"), [*keys, "dst"], "left_semi").select(*keys, F.col("src").alias("node")).distinct()


def ordered_bfs(edges: DataFrame, seeds: DataFrame, keys: list[str] | None = None, max_depth: int = MAX_DEPTH, shared: bool = False, max_nodes: int | None = None) -> DataFrame:
    """keys, node, depth, bfs_ord in the order of a queue: by parent, then ``ord`` of the edge.

    edges: keys, src, dst, ord; seeds: one node for each key. The seed has order 0. With ``shared``
    all keys search one graph, whose edges have no keys. What is found once a key has ``max_nodes`` nodes, the
    seed and the new one counted, leads no further.
    """
    keys = keys or []
    edge_keys = [] if shared else keys
    spark = edges.sparkSession
    edges = tables.keep(edges.select(*edge_keys, "src", "dst", "ord"), "edges")
    rounds = tables.Rounds(spark, "bfs")
    frontier = rounds.add(seeds.select(*keys, "node").withColumns({"depth": F.lit(0), "bfs_ord": F.lit(0).cast("long")}))
    for depth in range(1, max_depth + 1):
        before = frontier if max_nodes is None else frontier.where((F.col("depth") == 0) | (F.col("bfs_ord") < max_nodes - 1))
        before = before.select(*keys, F.col("node").alias("src"), F.col("bfs_ord").alias("parent_ord"))
        step = before.join(edges, [*edge_keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min(F.struct("parent_ord", "ord")).alias("way"))
        new = step.join(rounds.all(spark).select(*keys, "node"), [*keys, "node"], "left_anti")
        so_far = frontier.groupBy(*keys).agg(F.max("bfs_ord").alias("so_far"))
        new = new.join(so_far, keys) if keys else new.withColumn("so_far", F.lit(so_far.first()[0]))
        place = F.row_number().over(Window.partitionBy(*keys or [F.lit(1)]).orderBy("way", "node"))
        frontier = rounds.add(new.select(*keys, "node", F.lit(depth).alias("depth"), (F.col("so_far") + place).alias("bfs_ord")))
        if frontier.isEmpty():
            break
    return rounds.all(spark)


def upsert_edges(hops: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One edge for each pair: least seq, async if any is, site of the first; none to itself.

    hops: keys, src, dst, seq, async, site, site_ord.
    """
    keys = keys or []
    return (
        hops.where("src != dst")
        .groupBy(*keys, "src", "dst")
        .agg(F.min("seq").alias("seq"), F.bool_or("async").alias("async"), F.min_by("site", "site_ord").alias("site"))
    )


def callee_order(calls: DataFrame, site: list[str], name: str) -> DataFrame:
    """Callees of a site by name: adds callee_ord (from 1) and n_callees."""
    w = Window.partitionBy(*site)
    return calls.withColumn("callee_ord", F.row_number().over(w.orderBy(name))).withColumn("n_callees", F.count("*").over(w))


def resolve_sites(sites: DataFrame, resolved: DataFrame, fallback: DataFrame, most: int = MAX_FALLBACK) -> DataFrame:
    """Callees of each site: the resolved ones; without any, the fallback's if a dynamic site has 1 to ``most``.

    sites: site, dynamic; resolved and fallback: site, callee. Returns site, callee (null: none
    found), resolution (static, static-multi, or dynamic where a dynamic site has none).
    """
    coarse = sites.where("dynamic").join(resolved, "site", "left_anti").select("site").join(fallback.select("site", "callee").distinct(), "site")
    fits = coarse.groupBy("site").count().where(F.col("count") <= most).select("site")
    found = resolved.select("site", "callee").distinct().unionByName(coarse.join(fits, "site", "left_semi"))
    n = found.groupBy("site").agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") > 1, "static-multi").when(F.col("n") == 1, "static").when(F.col("dynamic"), "dynamic")
    return sites.join(n, "site", "left").join(found, "site", "left").select("site", "callee", kind.alias("resolution"))


def node_resolution(calls: DataFrame, keys: list[str]) -> DataFrame:
    """static-multi once any site reaches a node so (calls: keys, callee, resolution)."""
    return calls.groupBy(*keys, "callee").agg(F.when(F.bool_or(F.col("resolution") == "static-multi"), "static-multi").otherwise("static").alias("resolution"))


def canonical(functions: DataFrame) -> DataFrame:
    """fn_id and the declared function it stands for: origin of an instance, then what a wrapper wraps."""
    return functions.select("fn_id", F.coalesce("declared_fn", "origin_fn", "fn_id").alias("canonical"))


def absorb_effects(uses: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct effects of each node: first use's order and position, async if any use is.

    uses: keys, type, detail, topic, use_ord, pos, async.
    """
    return uses.groupBy(*keys, "type", "detail", "topic").agg(
        F.min("use_ord").alias("use_ord"), F.min_by("pos", "use_ord").alias("pos"), F.bool_or("async").alias("async")
    )


def effect_lists(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Effects of each node as an array in the order of their uses."""
    one = F.struct("use_ord", "type", "detail", "topic", "pos", "async")
    return effects.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("effects"))


def class_mark(file_class: Column) -> Column:
    """The rule id that functions of generated and vendored files begin with."""
    return F.when(file_class == "generated", "excluded:generated-file").when(file_class == "vendor", "excluded:vendor")


def skipped_site(mode: Column, pkg: Column, type_: Column) -> Column:
    """Calls that are no step: builtins, and Error() of an error."""
    return (mode == "builtin") | ((mode == "invoke") & (F.coalesce(pkg, F.lit("")) == "") & (type_ == "error"))


# ---------------------------------------------------------------- call graphs


def class_hierarchy(sites: DataFrame, methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """site and callee: static calls as they are, interface calls to every type with all the interface's methods.

    sites: site, mode, callee_fn, callee_pkg, callee_type, callee_name; methods: type_pkg, type_name,
    method, fn_id; interfaces: iface_pkg, iface_name, method.
    """
    call = lambda fn, pkg, type_, name: F.struct(fn.alias("fn"), pkg.alias("iface_pkg"), type_.alias("iface_name"), name.alias("method"))
    none = F.lit(None).cast("string")
    static = sites.where("callee_fn is not null").select("site", call(F.col("callee_fn"), none, none, none).alias("call"))
    dynamic = sites.where("mode = 'invoke'").select("site", call(none, F.col("callee_pkg"), F.col("callee_type"), F.col("callee_name")).alias("call"))
    want = interfaces.groupBy("iface_pkg", "iface_name").agg(F.countDistinct("method").alias("want"))
    has = interfaces.join(methods, "method").groupBy("iface_pkg", "iface_name", "type_pkg", "type_name").agg(F.countDistinct("method").alias("has"))
    fits = has.join(want, ["iface_pkg", "iface_name"]).where("has = want").drop("has", "want")
    called = dynamic.select("call.iface_pkg", "call.iface_name", "call.method").distinct()
    targets = called.join(fits, ["iface_pkg", "iface_name"]).join(methods, ["type_pkg", "type_name", "method"]).select("iface_pkg", "iface_name", "method", F.col("fn_id").alias("callee")).distinct()
    ways = targets.groupBy("callee").agg(F.collect_list(call(none, F.col("iface_pkg"), F.col("iface_name"), F.col("method"))).alias("ways"))
    targets = tables.keep(targets.join(ways, "callee"), "targets")
    # a site's calls are few and stay together, so a pair that several of them give is left to the first and no pairs are shuffled
    calls = static.unionByName(dynamic).repartition("site").distinct()
    calls = calls.withColumn("calls", F.collect_list("call").over(Window.partitionBy("site")))
    calls = calls.select("site", "calls", "call", "call.*")
    pairs = calls.join(tables.small(targets), ["iface_pkg", "iface_name", "method"], "left").withColumn("callee", F.coalesce("fn", "callee")).where("callee is not null")
    earlier = F.exists("calls", lambda c: F.coalesce(c["fn"] == F.col("callee"), F.lit(False))) | (F.get(F.array_intersect("calls", "ways"), F.lit(0)) != F.col("call"))
    return pairs.where(F.col("fn").isNotNull() | (F.size("calls") == 1) | ~earlier).select("site", "callee")


def type_flow(flows: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """value and type: all types that reach each value along flows (src, dst) from seeds (value, type)."""
    spark = flows.sparkSession
    flows = tables.keep(flows.select("src", "dst").distinct(), "flows")
    rounds = tables.Rounds(spark, "types")
    frontier = rounds.add(seeds.select("type", F.col("value").alias("node")).distinct())
    for _ in range(max_rounds):
        step = frontier.select("type", F.col("node").alias("src")).join(flows, "src").select("type", F.col("dst").alias("node")).distinct()
        frontier = rounds.add(step.join(rounds.all(spark), ["type", "node"], "left_anti"))
        if frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"types still flow after {max_rounds} rounds")
    return rounds.all(spark).select(F.col("node").alias("value"), "type")


def refine_calls(coarse: DataFrame, receivers: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """The coarse callees of interface calls whose receiver type can reach the call; static calls stay.

    coarse: site, callee; receivers: site, value of interface calls; types: value, type; methods: fn_id, type.
    """
    static = coarse.join(receivers, "site", "left_anti")
    there = receivers.join(types, "value").select("site", "type").distinct()
    own = methods.select(F.col("fn_id").alias("callee"), "type")
    dynamic = coarse.join(receivers.select("site").distinct(), "site", "left_semi").join(own, "callee").join(there, ["site", "type"], "left_semi").select("site", "callee")
    return static.select("site", "callee").unionByName(dynamic).distinct()


def build_call_graph(coarse: DataFrame, refine, cone: DataFrame, algo: str = "auto", max_cone: int = MAX_CONE) -> tuple[DataFrame, str, list[str]]:
    """(call graph, algorithm, warnings) for cha, vta or auto: auto takes the coarse one above ``max_cone`` functions.

    ``refine`` makes the finer graph; if it fails, the coarse one is used, with a warning.
    """
    if algo not in ("cha", "vta", "auto"):
        raise ValueError(f"unknown call graph algorithm {algo!r}: cha, vta or auto")
    if algo == "cha":
        return coarse, "cha", []
    if algo == "auto" and cone.limit(max_cone + 1).count() > max_cone:
        return coarse, "cha", [f"more than {max_cone} functions are reachable; the coarse call graph is used"]
    try:
        return refine(), "vta", []
    except Exception as e:  # the finer graph is optional, but its absence is said
        return coarse, "cha", [f"the finer call graph failed ({type(e).__name__}); the coarse one is used"]


def cone(calls: DataFrame, functions: DataFrame, roots: DataFrame) -> DataFrame:
    """Functions (node) reachable from the roots, only those with a body being expanded; all functions without roots."""
    if roots.isEmpty():
        return functions.select(F.col("fn_id").alias("node"))
    bodies = functions.where("has_body").select(F.col("fn_id").alias("src"))
    return reachable(calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).join(bodies, "src", "left_semi"), roots)


def extract(sites: DataFrame, callees: DataFrame, functions: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int | None = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """Raw flows of all roots in one search: (nodes, edges).

    sites: caller, site, ord (source order), seq, async, block, effect (null or any), dynamic_name (name
    of the terminal an unresolved call becomes, null where it is none); callees: site, callee (declared
    functions in order callee_ord), resolution; functions: fn_id, visit (has a body and is in the
    module); roots: flow_id, fn_id. Nodes: flow_id, node, kind, resolution, depth, bfs_ord. Edges:
    flow_id, src, dst, seq, async, site. Nodes at ``max_depth``, and those found once a flow has ``max_nodes`` (None: any number), are truncated terminals.
    """
    plain = sites.where("effect is null")
    known = callees.where("callee is not null").join(functions.where("visit").select(F.col("fn_id").alias("callee")), "callee", "left_semi")
    steps = plain.join(known, "site").select("caller", F.col("callee").alias("dst"), "ord", "callee_ord", "seq", "async", F.col("block").alias("site"), "resolution", F.lit("step").alias("kind"))
    lost = plain.where("dynamic_name is not null").join(callees.where("callee is not null").select("site").distinct(), "site", "left_anti")
    terminals = lost.select("caller", F.col("dynamic_name").alias("dst"), "ord", F.lit(0).alias("callee_ord"), "seq", "async", F.col("block").alias("site"), F.lit("dynamic").alias("resolution"), F.lit("terminal").alias("kind"))
    hops = tables.keep(steps.unionByName(terminals).withColumn("ord", F.struct("ord", "callee_ord")).drop("callee_ord"), "hops")
    ordered = hops.groupBy(F.col("caller").alias("src"), "dst").agg(F.min("ord").alias("ord"))
    found = ordered_bfs(ordered, roots.select("flow_id", F.col("fn_id").alias("node")), ["flow_id"], max_depth, shared=True, max_nodes=max_nodes)
    kinds = hops.groupBy(F.col("dst").alias("node")).agg(F.max("kind").alias("kind"))
    full = F.lit(False) if max_nodes is None else F.col("bfs_ord") >= max_nodes - 1
    cut = ((F.col("depth") >= max_depth) | full) & (F.col("depth") > 0)
    expanded = tables.keep(found.withColumn("cut", cut), "flow-nodes")
    live = expanded.where("not cut").select("flow_id", F.col("node").alias("caller"))
    edges = live.join(hops, "caller").join(expanded.select("flow_id", F.col("node").alias("dst")), ["flow_id", "dst"], "left_semi")
    multi = edges.where("resolution = 'static-multi'").select("flow_id", F.col("dst").alias("node")).distinct().withColumn("multi", F.lit(True))
    nodes = expanded.join(kinds, "node", "left").join(multi, ["flow_id", "node"], "left")
    kind = F.when(F.col("depth") == 0, "step").when(F.col("cut"), "terminal").otherwise(F.coalesce("kind", F.lit("step")))
    resolution = F.when(F.col("cut"), "truncated").when(kind == "terminal", "dynamic").when(F.col("multi"), "static-multi").otherwise("static")
    nodes = nodes.select("flow_id", "node", kind.alias("kind"), resolution.alias("resolution"), "depth", "bfs_ord")
    edges = edges.select("flow_id", F.col("caller").alias("src"), "dst", "seq", "async", "site", F.col("ord").alias("site_ord"))
    return nodes, upsert_edges(edges, ["flow_id"])
