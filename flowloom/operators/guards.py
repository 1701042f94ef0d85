"""Decisions: branches that leave a function, their conditions and exits, and what fits in a flow.

Dominance is given as numbers of a walk over the dominator tree: block x dominates y if
x.pre <= y.pre and y.post <= x.post, so questions about regions are interval joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import tables
from flowloom.functions.text import camel_words

# Fixed values.
#: Blocks to an exit, functions that feed a condition and how deep they are looked for, definitions behind an error.
EXIT_HOPS, USES, USES_DEPTH, ORIGIN_DEPTH = 5, 3, 4, 6
#: Decisions of a function and elements of a flow; scores and costs.
PER_FUNCTION, ELEMENTS = 8, 80
GATE_SCORE, SENTINEL_SCORE, MESSAGE_SCORE = 1, 4, 2
GATE_COST, EXIT_COST = 1, 2
FIELDS = 40
SUCCESS = {201: "201 Created", 202: "202 Accepted", 204: "204 No Content"}
WRAPPERS = [("fmt", "Errorf"), ("errors", "Wrap"), ("github.com/pkg/errors", "Wrap"), ("github.com/pkg/errors", "Wrapf"), ("github.com/pkg/errors", "WithStack"), ("github.com/pkg/errors", "WithMessage")]
WIRE_TAGS, RULE_TAGS = ["json", "xml", "form", "query", "param"], ["validate", "binding"]


# ---------------------------------------------------------------- exits


def straight_exits(starts: DataFrame, blocks: DataFrame, ends: DataFrame, hops: int = EXIT_HOPS) -> DataFrame:
    """starts (fn_id, b, and others) joined to the first block with an end (fn_id, b, ...) within ``hops`` blocks of a straight line.

    blocks: fn_id, b, succs. A line goes on through blocks with one successor.
    """
    lines = blocks.where(F.size("succs") == 1).select("fn_id", "b", F.get("succs", F.lit(0)).alias("_next"))
    ends = ends.withColumnRenamed("b", "_at")
    front, found = starts.withColumn("_at", F.col("b")), None
    for _ in range(hops):
        front = tables.keep(front, "exits")
        hit = front.join(ends, ["fn_id", "_at"])
        found = hit if found is None else found.unionByName(hit)
        front = front.join(ends.select("fn_id", "_at"), ["fn_id", "_at"], "left_anti").join(lines.withColumnRenamed("b", "_at"), ["fn_id", "_at"]).withColumn("_at", F.col("_next")).drop("_next")
    return found.drop("_at")


def guards(ifs: DataFrame, blocks: DataFrame, exits: DataFrame) -> DataFrame:
    """One row for each source branch with exactly one side that leaves with an error.

    ifs: fn_id, b, then_b, else_b, stmt_pos, order_pos, cond_text (null: not in the source); exits: fn_id, b, kind, name,
    message, pos, tail (the return passes on a call's own result). Adds fail_when, pass_b, skip_b and exit; where
    neither side leaves, the branch is a candidate for a gate (exit null). Several branches of one statement count once, first block first.
    """
    sides = ifs.select("fn_id", "stmt_pos", F.col("b").alias("if_b"), F.col("then_b").alias("b"), F.lit(True).alias("side"))
    sides = sides.unionByName(ifs.select("fn_id", "stmt_pos", F.col("b").alias("if_b"), F.col("else_b").alias("b"), F.lit(False).alias("side")))
    left = straight_exits(sides, blocks, exits).where("not tail")
    one = left.groupBy("fn_id", "if_b").agg(F.count("*").alias("n"), F.first("side").alias("fail_when"), F.first(F.struct("kind", "name", "message", "pos")).alias("exit"))
    rows = ifs.join(one, (ifs.fn_id == one.fn_id) & (ifs.b == one.if_b), "left").drop(one.fn_id).where("n is null or n = 1")
    passes = F.when(F.col("fail_when"), F.col("else_b")).otherwise(F.col("then_b"))
    skips = F.when(F.col("fail_when"), F.col("then_b")).otherwise(F.col("else_b"))
    rows = rows.withColumns({"pass_b": passes, "skip_b": skips, "gate": F.col("exit").isNull()}).drop("n", "if_b")
    first = F.row_number().over(Window.partitionBy("fn_id", "stmt_pos").orderBy("b"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def follow(starts: DataFrame, steps: DataFrame, ends: DataFrame, depth: int = ORIGIN_DEPTH) -> DataFrame:
    """key and the first end (at, ...) on the chain of definitions from each start (key, at); steps: at, next."""
    front, found = starts, None
    for _ in range(depth):
        front = tables.keep(front, "chain")
        hit = front.join(ends, "at")
        found = hit if found is None else found.unionByName(hit)
        front = front.join(ends.select("at"), "at", "left_anti").join(steps, "at").select("key", F.col("next").alias("at"))
    return found


def is_mechanical(err_nil: Column, same_call: Column, returned: Column, wrapper_pkg: Column, wrapper_name: Column) -> Column:
    """err != nil on a call of this function whose error is returned as it is or wrapped."""
    wrapped = F.lit(False)
    for pkg, name in WRAPPERS:
        wrapped = wrapped | ((wrapper_pkg == pkg) & (wrapper_name == name))
    return err_nil & same_call & ((returned == "bare") | ((returned == "call") & wrapped))


def exit_identity(sentinel: Column, message: Column, last_argument: Column) -> Column:
    """(kind, name, message): a named error, its words, or unknown. A format without words of its own is the last named error in it."""
    wordless = F.regexp_replace(message, r"%[wvsq]|[\s:;,.-]", "") == ""
    name = F.coalesce(sentinel, F.when(wordless, last_argument))
    text = F.when(~wordless, message)
    kind = F.when(name.isNotNull(), "sentinel").when(F.coalesce(text, F.lit("")) != "", "message").otherwise("unknown")
    return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "message", text).alias("message"))


def exit_display(exit_: Column) -> Column:
    return F.when(exit_["kind"] == "sentinel", exit_["name"]).when(exit_["kind"] == "message", F.concat(F.lit('"'), exit_["message"], F.lit('"'))).otherwise("error")


def rejection(status: Column, message: Column, failed_call: Column) -> Column:
    """What an HTTP rejection says; a bare one names the call that failed."""
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    said = F.when(F.coalesce(message, F.lit("")) != "", F.concat(code, F.lit(" · "), message)).otherwise(F.concat(code, F.coalesce(F.concat(F.lit(" ("), failed_call, F.lit(" failed)")), F.lit(""))))
    return F.when(status >= 400, said)


def success_text(status: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SUCCESS.items() for x in kv))[status], status.cast("string"))


def success_response(responses: DataFrame) -> DataFrame:
    """fn_id and the text of the first constant status below 400 (responses: fn_id, ord, status)."""
    return responses.where("status < 400").groupBy("fn_id").agg(success_text(F.min_by("status", "ord")).alias("success"))


def condition_uses(conditions: DataFrame, operands: DataFrame, calls: DataFrame, depth: int = USES_DEPTH, most: int = USES) -> DataFrame:
    """key and the first distinct module calls that feed a condition (conditions: key, at; operands: at, next, ord; calls: at, name)."""
    front, found = conditions.withColumn("way", F.array().cast("array<int>")), None
    for _ in range(depth):
        front = tables.keep(front, "uses")
        hit = front.join(calls, "at").select("key", "way", "name")
        found = hit if found is None else found.unionByName(hit)
        front = front.join(operands, "at").select("key", F.col("next").alias("at"), F.array_append("way", F.col("ord")).alias("way"))
    first = found.groupBy("key", "name").agg(F.min(F.struct(F.size("way"), "way")).alias("way"))
    return first.groupBy("key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("way", "name"))), lambda x: x["name"]), 1, most).alias("uses"))


# ---------------------------------------------------------------- intervals


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, id_: str, width: int) -> DataFrame:
    """points with the id of the smallest interval (lo, hi, both inside) that holds them, null if none does.

    A range join by buckets of ``width``: an interval is in every bucket it touches, a point in one. Of equal
    intervals the one that begins last wins, then the greater id.
    """
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    placed = points.withColumn("_b", F.floor(F.col(point) / width))
    hits = placed.join(spread, [*keys, "_b"], "left").where(F.col("lo").isNull() | F.col(point).between(F.col("lo"), F.col("hi")))
    best = hits.groupBy(*points.columns).agg(F.max(F.struct("lo", F.negative("hi").alias("hi"), id_)).alias("_best"))
    rows = points.join(best, points.columns, "left")
    return rows.select(*points.columns, F.col(f"_best.{id_}").alias(id_))


def dominated(regions: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """regions (pre, post, ...) joined to blocks (b_pre, b_post, ...) they dominate, within a function."""
    return regions.join(blocks, keys).where("pre <= b_pre and b_post <= post")


def region_has_work(regions: DataFrame, work: DataFrame, keys: list[str]) -> DataFrame:
    """regions in which something happens: work (b_pre, b_post) that they dominate."""
    inside = (regions[keys[0]] == work[keys[0]]) & (regions.pre <= work.b_pre) & (work.b_post <= regions.post)
    for k in keys[1:]:
        inside = inside & (regions[k] == work[k])
    return regions.join(work, inside, "left_semi")


def alternatives(effects: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """effects (keys, id, pre, post) with alt: another of the same node is in a block neither of which dominates the other.

    In the order of pre, longest first, an interval holds or is held by an earlier one unless that ends before it, and by a later one unless that
    ends behind it; so the least end before and the greatest end behind tell, without pairs.
    """
    w = Window.partitionBy(*keys).orderBy("pre", F.desc("post"), id_)
    before, behind = F.min("post").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max("post").over(w.rowsBetween(1, Window.unboundedFollowing))
    return effects.withColumn("alt", F.coalesce(before < F.col("post"), F.lit(False)) | F.coalesce(behind > F.col("post"), F.lit(False)))


# ---------------------------------------------------------------- choosing


def score(gate: Column, exit_kind: Column) -> Column:
    return F.when(gate, GATE_SCORE).when(exit_kind == "sentinel", SENTINEL_SCORE).otherwise(MESSAGE_SCORE)


def cost(gate: Column) -> Column:
    return F.when(gate, GATE_COST).otherwise(EXIT_COST)


def gate_sides(pass_works: Column, skip_works: Column) -> Column:
    """(keep, branch, fail_when) of a gate by the sides on which work happens; swapped sides fail when true."""
    return F.struct((pass_works | skip_works).alias("keep"), (pass_works & skip_works).alias("branch"), (~pass_works & skip_works).alias("fail_when"))


def per_function_cap(rows: DataFrame, keys: list[str], score_col: str, order: list[str], most: int = PER_FUNCTION) -> DataFrame:
    """rows with chosen (the best ``most`` of each function, in order among equals) and overflow (how many are not)."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc(score_col), *order))
    return rows.withColumn("chosen", rank <= most).withColumn("overflow", F.greatest(F.lit(0), F.count("*").over(w) - most))


def fill_budget(rows: DataFrame, keys: list[str], order: list, cost_col: str, budget: int | Column = ELEMENTS) -> DataFrame:
    """rows with fits: taken in order, an item that does not fit is skipped and later ones are tried.

    Costs are 1 or 2. So items are taken until the first that does not fit; that costs 2 and leaves room for
    just one, which the next item of cost 1 gets, and nothing fits after it. The budget may be a column of the group.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    w = Window.partitionBy(*keys).orderBy(*order)
    run = F.sum(cost_col).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_fits", run <= budget)
    rows = rows.withColumn("_spent", F.coalesce(F.max(F.when(F.col("_fits"), run)).over(Window.partitionBy(*keys)), F.lit(0)))
    late = ~F.col("_fits") & (F.col(cost_col) == 1)
    nth = F.sum(late.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("fits", F.col("_fits") | (late & (nth == 1) & (F.col("_spent") + 1 <= budget))).drop("_fits", "_spent")


def choose_decisions(nodes: DataFrame, found: DataFrame, most: int = PER_FUNCTION, elements: int = ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """(decisions, overflow): which decisions a flow shows, and how many each node leaves out.

    nodes: flow_id, node, fn_id, kind, depth, bfs_ord, dropped_by; found: fn_id, decision, order_pos, gate, exit_kind. Each surviving
    step shows its best ``most``; then all of a flow are taken, shallow nodes first and best outcomes first in each, as long
    as they fit beside the entrypoint and the surviving nodes. decisions: flow_id, node, and the columns of found.
    """
    used = nodes.groupBy("flow_id").agg((1 + F.count_if((F.col("depth") > 0) & F.col("dropped_by").isNull())).alias("used"))
    steps = nodes.where("kind = 'step' and dropped_by is null").select("flow_id", "node", "fn_id", "depth", "bfs_ord")
    fits, left = fit_decisions(steps.join(found, "fn_id").withColumn("bonus", F.lit(0)), used, most, elements)
    return fits.select("flow_id", "node", *found.columns), left


def fit_decisions(rows: DataFrame, used: DataFrame, most: int = PER_FUNCTION, elements: int = ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """(rows that are shown, overflow): flow_id, node, depth, bfs_ord, decision, order_pos, gate, exit_kind, bonus, beside what a flow has used.

    The bonus counts among the decisions of one step, not within the flow. What a step has beyond ``most`` is left out
    silently; overflow counts what does not fit in the flow.
    """
    rows = rows.join(used.hint("merge"), "flow_id").withColumns({"_best": score(F.col("gate"), F.col("exit_kind")) + F.col("bonus"), "_score": score(F.col("gate"), F.col("exit_kind")), "_cost": cost(F.col("gate"))})
    rows = per_function_cap(rows, ["flow_id", "node"], "_best", ["order_pos", "decision"], most)
    order = ["depth", "bfs_ord", F.desc("_score"), "order_pos", "decision"]
    filled = fill_budget(rows.where("chosen"), ["flow_id"], order, "_cost", F.lit(elements) - F.col("used"))
    left = filled.groupBy("flow_id", "node").agg(F.count_if(~F.col("fits")).alias("overflow")).where("overflow > 0")
    return filled.where("fits").drop("used", "_best", "_score", "_cost", "chosen", "overflow", "fits"), left


def attach(chosen: DataFrame, calls: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chain, targets): edges among a node and its decisions in order, and the decision that each call moves to.

    chosen: keys, decision, ord, gate, branch, fail_when, pre, post (of the block it passes to), skip_pre, skip_post;
    calls: keys, call, b_pre, b_post. A decision follows the last one before it that is no gate, with the label of
    that one's passing side. A call goes to the last decision whose passing block dominates it, else to the last
    branch whose other block does.
    """
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    solid = F.when(~F.col("gate"), F.struct("decision", "fail_when"))
    before = F.last(solid, ignorenulls=True).over(w)
    chain = chosen.withColumn("_p", before).select(
        *keys, F.col("_p.decision").alias("src"), F.col("decision").alias("dst"), F.when(F.col("_p").isNotNull(), "pass").alias("kind"), (~F.col("_p.fail_when")).cast("string").alias("label")
    )
    both = calls.join(chosen.hint("merge"), keys)
    within = (F.col("pre") <= F.col("b_pre")) & (F.col("b_post") <= F.col("post"))
    other = F.coalesce(F.col("branch") & (F.col("skip_pre") <= F.col("b_pre")) & (F.col("b_post") <= F.col("skip_post")), F.lit(False))
    yes_no = lambda flag: F.when(flag, "yes").otherwise("no")
    label = F.when(within & F.col("branch"), yes_no(~F.col("fail_when"))).when(within & ~F.col("gate"), (~F.col("fail_when")).cast("string")).when(~within, yes_no(F.col("fail_when")))
    placed = both.withColumn("_side", F.when(within, 2).when(other, 1)).where("_side is not null").withColumn("label", label)
    targets = placed.groupBy(*keys, "call").agg(F.max_by(F.struct("decision", "label"), F.struct("_side", "ord")).alias("t"))
    return chain, targets.select(*keys, "call", F.col("t.decision").alias("decision"), F.lit("pass").alias("kind"), F.col("t.label").alias("label"))


# ---------------------------------------------------------------- contracts


def tag_value(tag: Column, key: str) -> Column:
    """The value of a key in a struct tag, null without it."""
    return F.when(tag.rlike(rf'(^|\s){key}:"'), F.regexp_extract(tag, rf'(?:^|\s){key}:"([^"]*)"', 1))


def wire_name(tag: Column) -> Column:
    found = F.coalesce(*(tag_value(tag, k) for k in WIRE_TAGS))
    return F.coalesce(F.regexp_extract(found, "^([^,]*)", 1), F.lit(""))


def tag_rules(tag: Column) -> Column:
    found = F.coalesce(*(F.nullif(tag_value(tag, k), F.lit("-")) for k in RULE_TAGS))
    return F.coalesce(F.replace(found, F.lit(","), F.lit(", ")), F.lit(""))


def union_rules(a: Column, b: Column) -> Column:
    """Two lists of rules without repetition, in order."""
    parts = F.transform(F.split(F.concat_ws(", ", a, b), ", "), lambda x: F.trim(x))  # trim itself would take the index as characters
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), ", ")


def rule_text(name: Column, constants: Column) -> Column:
    """length(4, 64), required."""
    return F.when(F.size(constants) > 0, F.concat(camel_words(name), F.lit("("), F.array_join(constants, ", "), F.lit(")"))).otherwise(camel_words(name))


def validation_rules(calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, rules: rules of each field in the order of the calls (calls: keys, field, ord, name, constants)."""
    one = calls.select(*keys, "field", "ord", rule_text(F.col("name"), F.col("constants")).alias("rule"))
    return one.groupBy(*keys, "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rule"))), lambda x: x["rule"]), ", ").alias("rules"))


def data_contract(fields: DataFrame, keys: list[str], most: int = FIELDS) -> DataFrame:
    """keys, fields (name, tag, type, rules, in order, at most ``most``) and truncated.

    fields: keys, ord, name, tag, type, exported, embedded_struct, rules (found in code, null: none). Embedded structs are given by their
    own fields, in place; fields with the wire name - and unexported ones are left out.
    """
    rows = fields.where("not embedded_struct and exported").withColumn("wire", wire_name(F.col("tag"))).where("wire != '-'")
    one = F.struct("ord", "name", F.col("wire").alias("tag"), "type", union_rules(tag_rules(F.col("tag")), F.coalesce("rules", F.lit(""))).alias("rules"))
    by = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("f"))
    shown = F.transform(F.slice("f", 1, most), lambda x: F.struct(x["name"].alias("name"), x["tag"].alias("tag"), x["type"].alias("type"), x["rules"].alias("rules")))
    return by.select(*keys, shown.alias("fields"), (F.size("f") > most).alias("truncated"))
