import hashlib
import math
import random
import re

import corpus_pipeline
from flowloom.llm import passages, quality, scratch, simhash, spm
from tests.conftest import SMALL
from tests.llm.conftest import ODD
from tests.llm.test_simhash import classes, fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables, now = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        now = scratch.keep(stage(spark, now, SMALL), "test-stage")
        tables.append(now)
    start, good, unique, cut, mixed, tokens = ([r.asDict() for r in t.collect()] for t in tables)
    for t in tables[:-1]:
        assert t.columns == docs.columns

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    verdict = {r.doc_id: r.kept for r in quality.assess(docs, quality.train(docs, labels)).collect()}
    assert {r["doc_id"] for r in good} == {i for i, kept in verdict.items() if kept}

    prints = {r["doc_id"]: int(simhash.fingerprints_of([r["text"].encode()])[0]) for r in good}
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in unique} == {find(i) for i in ids}

    source = {r["doc_id"]: r["text"] for r in unique}
    gone = {}
    for p in passages.find_passages(tables[2]).collect():
        gone.setdefault(p.doc_id, set()).update(range(p.begin_word, p.end_word))
    left = {r["doc_id"]: r for r in cut}
    for i, text in source.items():
        words = [w for n, w in enumerate(WORD.findall(text)) if n not in gone.get(i, ())]
        if words:
            assert WORD.findall(left[i]["text"]) == words and left[i]["n_chars"] == len(left[i]["text"])
            assert i in gone or left[i]["text"] == text
        else:
            assert i not in left

    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        assert r["text"] == left[r["doc_id"]]["text"]
    assert set(copies.values()) <= {1, 2}
    sizes = {i: len(WORD.findall(r["text"])) for i, r in left.items()}
    assert abs(sum(copies.get(i, 0) * n for i, n in sizes.items()) - 1.5 * sum(sizes.values())) <= 20 * max(sizes.values()) / 2

    tokenizer = spm.Tokenizer(spm.read_model())
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in tokens))) == sorted(repr((r["doc_id"], tokenizer.encode(r["text"]).tolist())) for r in mixed)


def test_run_gives_the_same_as_the_stages(spark):
    one, two = (sorted(map(repr, corpus_pipeline.run(spark, SMALL).collect())) for _ in range(2))
    assert one == two and one


def test_odd_rows_pass_every_stage(spark, odd, none):
    now = odd
    for _, stage in corpus_pipeline.STAGES:
        before, now = now, scratch.keep(stage(spark, now, SMALL), "test-stage")
        assert stage(spark, none, SMALL).count() == 0
        if stage is not corpus_pipeline.encode:
            assert now.columns == before.columns
    ids = {r.doc_id for r in now.collect()}
    assert ids <= {i for i, *_ in ODD} and 1 in ids


def plain_rows():
    """Rows without ids, with ids that are shared, equal rows, near copies, and sources of any name."""
    rng = random.Random(31)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lly", "de")]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 400)))
        rows.append((None if i % 3 == 0 else i // 5 if i % 3 == 1 else i, text, "en", (None, "a", "b", "hot")[rng.randrange(4)], len(text)))
    rows += [rows[3], rows[3], rows[4]]  # equal rows
    rows += [(r[0], r[1].upper(), "de", r[3], r[4]) for r in rows[:9]]  # near copies of rows with and without ids
    rows += [(None, None, "en", "a", None), (None, "", "en", "a", 0), (500, " ", "en", None, 1)]
    return rows


def plain_dedup(rows):
    """One row of each group: smallest id, rows without one last. Equal rows count once."""
    rows = list(dict.fromkeys(rows))
    prints = [fingerprint(r[1] or "") for r in rows]
    group = classes(range(len(rows)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    groups = {}
    for i, g in group.items():
        groups.setdefault(g, []).append(rows[i])
    return list(groups.values())


def plain_mix(rows):
    """Copies of each row, by the formulas of the contract."""
    key = lambda s: (s is None, s or "")
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=key)
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free = {}, list(sources)
    while free:
        left = 1.5 * sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} or {s: weight[s] * level for s in free}
        free = [s for s in free if s not in target] if over else []
    copies = [0] * len(rows)
    for s in sources:
        epochs = int(target[s] // total[s]) if total[s] else 0
        ahead, order = 0, []
        for i, r in enumerate(rows):
            if r[3] == s:
                said = hashlib.md5((r[1] or "").encode()).hexdigest()
                digest = hashlib.md5(f"mix-2:{'null' if r[0] is None else r[0]}:{said}".encode()).hexdigest()
                u = (int(digest[:13], 16) + 0.5) / 2**52
                symbols = sum(c in "#*$%&|<>" for c in r[1] or "")
                w = size[i] / (size[i] + symbols) if size[i] else 1.0
                order.append((-math.log(u) / w, size[i], i))
        for _, n, i in sorted(order):
            copies[i] = (epochs + (ahead + n / 2 <= target[s] - epochs * total[s])) * bool(n)
            ahead += n
    return copies


def test_no_row_is_lost_for_want_of_an_id(spark):
    """Stages 2 to 5 against a pipeline in plain Python, which uses none of the library."""
    import sentencepiece

    given = plain_rows()
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    unique = scratch.keep(corpus_pipeline.near_duplicates(spark, docs, SMALL), "test-stage")
    left = [tuple(r) for r in unique.collect()]
    groups = plain_dedup(given)
    assert len(left) == len(groups) and len(set(left)) == len(left)
    for own in groups:
        ids = [r[0] for r in own if r[0] is not None]
        (one,) = [r for r in own if r in left]
        assert one[0] == min(ids, default=None)
    assert sum(r[0] is None for r in left) > 10

    cut = scratch.keep(corpus_pipeline.substring_dedup(spark, unique, SMALL), "test-stage")
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, unique.collect()))  # no shared runs in these texts

    for table, rows in ((cut, left), (docs, given)):
        mixed = [tuple(r) for r in corpus_pipeline.mix_sources(spark, table, SMALL).collect()]
        want = {}
        for r, n in zip(rows, plain_mix(rows)):
            want[r] = want.get(r, 0) + n
        assert {r: mixed.count(r) for r in set(rows)} == want

    model = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    tokens = corpus_pipeline.encode(spark, docs, SMALL).collect()
    assert sorted(repr((r.doc_id, r.ids)) for r in tokens) == sorted(repr((r[0], model.encode(r[1] or ""))) for r in given)


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "_row", "_times", "_n_rows", "_mark", "_spans", "row"]
    rows = [(i, f"some words that make text number {i}", "s", i, i, i, i, i, i) for i in (1, 2, 2)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.substring_dedup, corpus_pipeline.mix_sources):
        done = stage(spark, docs, SMALL)
        assert done.columns == names and {tuple(r) for r in done.collect()} <= {tuple(r) for r in rows}
