import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowloom.llm import chat, mixing, queries
from tests.conftest import SMALL, same_rows
from tests.llm.conftest import ODD


def test_mix_query_matches_sql(spark, duck):
    same_rows(queries.op9_mix_sources(spark, SMALL), duck, queries.OP9_SQL)


@pytest.mark.parametrize("rows", [5, 20_000])
def test_ranges_do_not_change_the_mix(spark, monkeypatch, rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = {tuple(r) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    assert {tuple(r) for r in mixing.mix(docs.repartition(7)).collect()} == whole


def test_mix_of_a_hot_source(spark):
    rows = [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault((rows[r.doc_id][2], r.source_size, r.target), []).append(r)
    for (_, size, target), own in by.items():
        assert sum(r.size for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= 5
    assert sum(t for _, _, t in by) == pytest.approx(1.5 * sum(s for _, s, _ in by))


def test_targets_reshare_the_excess(spark):
    sources = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 1000), ("t", 0)], "source_key string, source_size long")
    got = {r.source_key: r.target for r in mixing.targets(sources).collect()}
    left = 1.5 * 2010 - 20  # a is capped at 20; b and c share the rest by 2 to 1, and b is capped too
    assert got == {"sa": 20.0, "sb": pytest.approx(min(2000, left * 2 / 3)), "sc": pytest.approx(left - min(2000, left * 2 / 3)), "t": 0.0}


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(none).count() == 0


def test_better_documents_are_taken_first(spark):
    rows = [(i, ("word " * 20) if i % 2 else ("wo*$% " * 20), "b" if i < 2000 else "a") for i in range(2200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(9, 1)).where("doc_id < 2000").collect()
    clean, noisy = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert clean > 1.05 * noisy


# ---------------------------------------------------------------- chat


def test_chat_query_matches_sql(spark, duck):
    same_rows(queries.op10_chat_examples(spark, SMALL), duck, queries.OP10_SQL)


def test_plan_is_native(spark):
    plan = queries.op10_chat_examples(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 2


def digests(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


hard = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", None, "a: b", "###"]), st.none() | st.text(alphabet="\\#ht</turn>\n: ab", max_size=25)), min_size=1, max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(hard, min_size=30, max_size=30))
def test_any_turns_come_back(spark, many):
    rows = [(c, n, r, t, 0) for c, turns in enumerate(many) for n, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.chat_digests(chat.format_conversations(table)).collect()}
    assert got == {c: digests(turns) for c, turns in enumerate(many)}


def test_each_reply_is_an_example_with_its_prefix(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bb"), (1, 4, "user", "s")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [r.formatted for r in got] == [
        "### user: q</turn>\n### assistant: a</turn>\n",
        "### user: q</turn>\n### assistant: a</turn>\n### user: r</turn>\n### assistant: bb</turn>\n",
        "### user: q</turn>\n### assistant: a</turn>\n### user: r</turn>\n### assistant: bb</turn>\n### user: s</turn>\n",
    ]
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in got] == ["a", "bb", ""]
    assert [r.is_last for r in got] == [False, False, True]


def test_null_turns_ids_and_no_rows(spark):
    rows = [(None, 1, "user", "x"), (None, None, "assistant", "y"), (2, 0, "assistant", None), (2, 0, "assistant", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in queries.chat_digests(chat.format_conversations(table)).collect()}
    assert got == {None: 2, 2: 2}
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_escapes_hide_all_markers(spark):
    text = "\\### </turn> \\h \\\\h ##### <</turn>>"
    (r,) = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert "###" not in r.e and "</turn>" not in r.e and r.u == text
