import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import iblt, token_counts as tc
from tests.llm.conftest import ODD, long_text

with open(tc.VOCABULARY, "rb") as _file:
    ENCODER = tc.Encoder(_file.read())




@pytest.mark.parametrize("text", ["", "plain words here", "é日本語 👍🏽x", "a\n\nb\r\n", "\n", "  lead", "👍" * 5])
def test_spans_cover_the_text(text):
    ids = ENCODER.encode(text)
    first, last = ENCODER.spans(text.encode(), ids)
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    at = 0
    for i, f, e in zip(ids, first, last, strict=True):
        n = int(ENCODER.lengths[i])
        assert char_of[at] == f and char_of[at + n - 1] == e
        at += n
    assert at == len(char_of)


def test_rules_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["the ", "\n", "é", "日本", "👍", "abc", "  ", "x1 "]) for _ in range(rng.randint(0, 30)))
        first, last = ENCODER.spans(text.encode(), ENCODER.encode(text))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(5))
        begin, end = np.array([0, *cuts]), np.array([*cuts, len(text)])
        for rule in tc.RULES:
            got = tc.attribute(first, last, begin, end, rule)
            want = []
            for b, e in zip(begin, end, strict=True):
                if rule == "split":
                    want.append(sum(max(0, min(e, l + 1) - max(b, f)) / (l - f + 1) for f, l in zip(first, last, strict=True)))
                else:
                    want.append(sum(b <= (f if rule == "first" else l) < e for f, l in zip(first, last, strict=True)))
            assert got == pytest.approx(want)
            assert got.sum() == pytest.approx(len(first))
    with pytest.raises(ValueError):
        tc.attribute(first, last, begin, end, "none")


def test_sections_of_odd_rows(odd, none):
    rows = tc.count_tokens(odd).collect()
    texts = {i: t or "" for i, t, *_ in ODD}
    copies = {i: sum(1 for x in ODD if x[0] == i) for i in texts}
    for i, text in texts.items():
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in own) == copies[i] * len(ENCODER.encode(text))
        assert sum(r.shared_tokens for r in own) == pytest.approx(copies[i] * len(ENCODER.encode(text)))
        lines = text.split("\n")
        assert len(own) == copies[i] * (len(lines) - (lines[-1] == "" and len(lines) > 1))
        assert max(r.end_char for r in own) == len(text)
    assert tc.count_tokens(none).count() == 0


# ---------------------------------------------------------------- sketches


def paragraphs(text):
    """Its lines with words, as words."""
    return Counter(tuple(x) for x in (re.findall(r"[^\x20\x09-\x0D]+", line) for line in text.split("\n")) if x)


def pieces(text):
    """Its paragraphs, cut after words whose hash divides."""
    found = Counter()
    for words, n in paragraphs(text).items():
        cut = iblt.Words([" ".join(words).encode()]).hash % np.uint64(iblt.PIECE) == 0
        piece = []
        for i, (word, last) in enumerate(zip(words, cut, strict=True)):
            piece.append(word)
            if last or i == len(words) - 1:
                found[tuple(piece)] += n
                piece = []
    return found


def jaccard(a, b):
    a, b = pieces(a), pieces(b)
    return (a & b).total() / (a | b).total() if a | b else 1.0


def test_likeness_is_exact_whatever_the_difference():
    rng = random.Random(3)
    base = long_text(3000, 1).split()
    texts = []
    for n in (0, 1, 5, 50, 500, 3000):
        words = list(base)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        texts.append(" ".join(words))
    texts += ["", "", "a", "a a a a", "b\nb\nb"]
    found = iblt.compare([*texts, texts[0]])
    for i, t in enumerate(texts):
        after = [*texts, texts[0]][i + 1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert found["near_next"][i] == pytest.approx(jaccard(t, after))
        assert found["near_edited"][i] == pytest.approx(jaccard(t, edited))


def test_peeling_recovers_the_paragraphs_that_differ():
    rng = random.Random(5)
    texts = []
    for n in (0, 1, 2, 9, 40, 400):
        lines = [f"line {rng.randrange(60)} of {rng.randrange(3)}" for _ in range(n)]
        texts += ["\n".join(lines), "\n\n".join(x if rng.random() < 0.8 else x + " y" for x in lines)]
    one, other = iblt.Keys([t.encode() for t in texts[::2]]), iblt.Keys([t.encode() for t in texts[1::2]])
    here = np.arange(len(texts) // 2)
    near, lost, new = iblt.compare_pairs(one, other, here, here)
    for i, (a, b) in enumerate(zip(texts[::2], texts[1::2], strict=True)):
        mine, theirs = ({f"{k:016x}" for k in iblt.Keys([t.encode()]).key.tolist()} for t in (a, b))
        assert set(lost[i]) == mine - theirs and set(new[i]) == theirs - mine
        assert len(lost[i]) == (paragraphs(a) - paragraphs(b)).total() and len(new[i]) == (paragraphs(b) - paragraphs(a)).total()
        assert near[i] == pytest.approx(jaccard(a, b))


def test_recovered_digests_name_the_edited_paragraphs():
    text = "first line of text\nsecond line of text\nthird line of text here"
    found = iblt.compare([text, "other words in this one, long enough to fill a third"])
    keys = [f"{k:016x}" for k in iblt.Keys([text.encode()]).key.tolist()]
    assert keys[0] not in found["edited_lost"][0] and keys[2] in found["edited_lost"][0] and found["edited_new"][0]


def test_equal_texts_have_equal_fingerprints():
    found = iblt.compare(["a b\nc", "a b\nc", "a b\nd", "x"])
    assert found["fingerprint"][0] == found["fingerprint"][1] != found["fingerprint"][2]


@pytest.mark.parametrize("rows", [3, 4000])
def test_neighbours_over_ranges(spark, odd, none, monkeypatch, rows):
    monkeypatch.setattr(iblt, "RANGE_ROWS", rows)
    texts = [(i, f"text {i} " + "w " * (i % 7), i) for i in range(0, 90, 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, tail int").repartition(4)
    found = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    assert len(found) == len(texts)
    for n, (i, t, _) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        assert found[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()
    assert iblt.fingerprints(odd).count() == len(ODD)
    assert iblt.fingerprints(none).count() == 0


def test_a_single_row_is_its_own_neighbour(spark):
    (r,) = iblt.fingerprints(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.n_chars == 11


def test_repeated_ids_have_one_order(spark):
    docs = spark.createDataFrame([(1, "aaa bbb"), (1, "aaa bbb"), (1, "ccc"), (0, "zzz yyy xxx"), (None, "nnn")], "doc_id long, text string")
    one, two = (sorted(map(repr, iblt.fingerprints(docs.repartition(n)).collect())) for n in (1, 4))
    assert one == two and len(one) == 5
