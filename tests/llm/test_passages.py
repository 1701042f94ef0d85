import random

import numpy as np
import pytest

from flowloom.llm import passages as P
from flowloom.llm.words import Words
from tests.llm.conftest import ODD

VOCABULARY = [f"w{i}" for i in range(4000)]


def some(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")


def test_fenwick_is_a_prefix_maximum():
    rng = random.Random(1)
    tree, flat = P.Fenwick(40), [(-np.inf, -1)] * 40
    for n in range(300):
        i, v = rng.randrange(40), (rng.random(), n)
        tree.put(i, v)
        flat[i] = max(flat[i], v)
        j = rng.randrange(41)
        assert tree.below(j) == max(flat[:j], default=(-np.inf, -1))


def test_first_chain_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 25))
        t, s = np.sort(rng.choice(200, n, replace=False)), rng.integers(0, 200, n)
        score = np.zeros(n)
        for j in range(n):
            before = [score[i] - P.GAP * (t[j] - t[i] + s[j] - s[i]) for i in range(j) if s[i] < s[j]]
            score[j] = P.K + max([0.0, *before])
        worth = [P.K * len(c) - P.GAP * (t[c[-1]] - t[c[0]] + s[c[-1]] - s[c[0]]) for c in P.chains(t, s)]
        if score.max() > P.K:
            assert max(worth) == pytest.approx(score.max())
        used = np.concatenate(P.chains(t, s)) if worth else np.zeros(0)
        assert len(used) == len(set(used.tolist()))


def test_gap_alignment_has_fewest_edits():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        pairs = P.align_gap(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        cost, i, j = 0, 0, 0
        for x, y in [*pairs, (len(a), len(b))]:
            cost += max(x - i, y - j)
            i, j = x + 1, y + 1
        assert cost == edits(a, b)


def test_every_shared_run_shares_a_seed():
    rng = random.Random(5)
    for _ in range(100):
        run = some(rng, P.K + P.WINDOW - 1)
        a, b = ([*some(rng, rng.randint(0, 40)), *run, *some(rng, rng.randint(0, 40))] for _ in range(2))
        keys = [set(P.winnow(Words([" ".join(x).encode()]))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(6)
    texts, places = {}, {}
    for group in range(12):
        passage = some(rng, rng.randint(51, 150))
        for copy in range(rng.randint(2, 6)):
            i, lead = group * 10 + copy, some(rng, rng.randint(0, 80))
            shown = list(passage)
            if group % 3 == 2:  # fuzzy: every 25th word differs
                shown = [rng.choice(VOCABULARY) if n % 25 == 12 else x for n, x in enumerate(shown)]
            texts[i] = " ".join([*lead, *shown, *some(rng, rng.randint(0, 80))])
            places[i] = (group, copy, len(lead), len(passage))
    clean = {1000 + i: " ".join(some(rng, rng.randint(5, 300))) for i in range(40)}
    docs = table(spark, texts | clean)
    found = P.find_passages(docs)
    rows = {r.doc_id: r for r in P.repeated_words(docs, found).collect()}
    assert len(rows) == len(docs.collect())
    for i, (group, copy, lead, n) in places.items():
        spans = [(p.begin_word, p.end_word, p.source_id) for p in rows[i].passages]
        if copy == 0:
            assert not spans
        elif group % 3 != 2:
            assert spans == [(lead, lead + n, group * 10)]
            assert rows[i].n_repeated_words == n
        elif n >= 75:
            assert rows[i].n_repeated_words >= 0.6 * n
    assert not any(rows[i].passages for i in clean)
    left = {r.doc_id: r.text for r in P.remove_passages(docs, found).collect()}
    for i, (group, copy, lead, n) in places.items():
        if group % 3 != 2:
            words = texts[i].split()
            assert left.get(i, "").split() == (words[:lead] + words[lead + n :] if copy else words)


def test_copies_keep_the_first(spark):
    rng = random.Random(8)
    text = " ".join(some(rng, 400))
    docs = table(spark, {i: text for i in range(1, 30)} | {50: text.upper()})
    found = P.find_passages(docs)
    rows = {r.doc_id: r.n_repeated_words for r in P.repeated_words(docs, found).collect()}
    assert rows[1] == 0 and all(n == 400 for i, n in rows.items() if i > 1)
    assert found.count() == 29  # one passage for each copy, not one for each pair
    assert [r.doc_id for r in P.remove_passages(docs, found).collect()] == [1]


def test_runs_are_found_though_earlier_documents_hold_parts_of_them(spark):
    rng = random.Random(12)
    texts = {}
    for group in range(25):
        run, n = some(rng, rng.randint(50, 70)), 0
        halves, inner = (run[:30], run[30:]), (run[:20], run[20:40], run[40:])
        shown = [[*halves, run, run], [*halves, run, *halves, run], [*inner, run, *inner, *halves, run]][group % 3]
        for part in shown:
            texts[group * 100 + n] = [*some(rng, rng.randint(40, 80)), *part, *some(rng, rng.randint(40, 80))]
            n += 1
    found = {}
    for p in P.find_passages(table(spark, {i: " ".join(x) for i, x in texts.items()})).collect():
        found.setdefault(p.doc_id, set()).update(range(p.begin_word, p.end_word))
        if p.similarity == 1:
            assert texts[p.doc_id][p.begin_word : p.end_word] == texts[p.source_id][p.source_begin : p.source_end]
    seen, repeated = set(), {}
    for i, words in sorted(texts.items()):
        runs = [(tuple(words[j : j + P.LEAST_WORDS]), j) for j in range(len(words) - P.LEAST_WORDS + 1)]
        repeated[i] = {w for run, j in runs if run in seen for w in range(j, j + P.LEAST_WORDS)}
        seen.update(run for run, _ in runs)
    assert sum(map(bool, repeated.values())) == 25
    assert all(repeated[i] <= found.get(i, set()) for i in texts)


def test_short_shared_runs_are_no_passages(spark):
    rng = random.Random(9)
    run = some(rng, P.LEAST_WORDS - 1)
    docs = table(spark, {i: " ".join([*some(rng, 60), *run, *some(rng, 60)]) for i in range(5)})
    assert P.find_passages(docs).count() == 0


def test_odd_rows(odd, none):
    found = P.find_passages(odd)
    assert found.count() == 0
    assert P.repeated_words(odd, found).count() == len(ODD)
    assert P.find_passages(none).count() == 0
    rest = P.remove_passages(odd, found)
    assert rest.columns == odd.columns and rest.count() == len(ODD)


def test_repeated_ids_do_not_crash(spark):
    rng = random.Random(10)
    a, b = " ".join(some(rng, 200)), " ".join(some(rng, 80))
    docs = spark.createDataFrame([(1, a), (1, a), (2, a), (2, b), (3, b), (None, a)], "doc_id long, text string")
    found = P.find_passages(docs)
    assert {r.doc_id for r in found.collect()} <= {2, 3}
    P.remove_passages(docs, found).collect()


def edited(rng, words, share):
    """Words with a share of them changed, left out or followed by a new one."""
    out = []
    at = set(rng.sample(range(len(words)), round(share * len(words))))
    for i, w in enumerate(words):
        kind = rng.randrange(4) if i in at else -1
        out += [w] if kind < 0 else [] if kind == 0 else [w, rng.choice(VOCABULARY)] if kind == 1 else [rng.choice(VOCABULARY)]
    return out


def test_recall_of_passages_whose_parts_come_from_several_sources(spark):
    """Passages of 60 to 120 words, each in two documents; their parts are in two or three earlier ones too."""
    rng = random.Random(21)
    texts, wanted = {}, {}
    for group in range(120):
        share, pieces = (0, 0.05, 0.08)[group % 3], (1, 2, 3)[group // 3 % 3]
        run = some(rng, rng.randint(60, 120))
        cuts = [round(len(run) * x / pieces) for x in range(pieces + 1)]
        parts = [run[a:b] for a, b in zip(cuts, cuts[1:]) if pieces > 1]
        for n, shown in enumerate([*parts, run, edited(rng, run, share)]):
            lead = some(rng, rng.randint(10, 80))
            texts[group * 10 + n] = " ".join([*lead, *shown, *some(rng, rng.randint(10, 80))])
        wanted[group * 10 + n] = (share, pieces, len(lead), len(lead) + len(shown))
    found = {}
    for p in P.find_passages(table(spark, texts)).collect():
        found.setdefault(p.doc_id, set()).update(range(p.begin_word, p.end_word))
    recall = {}
    for i, (share, pieces, a, b) in wanted.items():
        recall.setdefault((share, pieces), []).append(len(found.get(i, set()) & set(range(a, b))) >= 0.8 * (b - a))
    rates = {k: sum(v) / len(v) for k, v in recall.items()}
    assert all(x == 1 for (share, _), x in rates.items() if share == 0), sorted(rates.items())
    assert all(x >= 0.9 for x in rates.values()), sorted(rates.items())


def test_passages_join_halves_of_earlier_documents(spark):
    rng = random.Random(22)
    texts = {}
    for group in range(20):
        run = some(rng, 90)
        for n, shown in enumerate([run[:45], run[45:], run, run]):
            texts[group * 10 + n] = " ".join([*some(rng, 50), *shown, *some(rng, 50)])
    found = {r.doc_id: r for r in P.repeated_words(table(spark, texts), P.find_passages(table(spark, texts))).collect()}
    assert all(found[group * 10 + 3].n_repeated_words >= 90 for group in range(20))
    assert all(any(p.source_id == group * 10 + 2 for p in found[group * 10 + 3].passages) for group in range(20))


def test_windows_widen_while_the_passage_goes_on(spark):
    """The later document's first words and last words have their seeds in other, earlier documents."""
    rng = random.Random(23)
    run = some(rng, 900)
    parts = {i: " ".join([*some(rng, 30), *run[a : a + 45], *some(rng, 30)]) for i, a in enumerate(range(0, 900, 45)) if i != 10}
    docs = table(spark, parts | {100: " ".join(run), 101: " ".join(run)})
    rows = P.find_passages(docs).where("doc_id = 101 and source_id = 100").collect()
    assert any((p.begin_word, p.end_word) == (0, 900) for p in rows)


def similar_runs(a, b, least=P.LEAST_WORDS):
    """Whether some run of ``least`` words of a has a longest common subsequence of 95 % with some run of b of that length."""
    where = {}
    for j in range(len(b) - 4):
        where.setdefault(tuple(b[j : j + 5]), []).append(j)
    shifts = {}
    for i in range(len(a) - 4):
        for j in where.get(tuple(a[i : i + 5]), ()):
            shifts.setdefault(i - j, []).append(i)
    for shift in shifts:
        same = [a[i] == b[i - shift] if 0 <= i - shift < len(b) else False for i in range(len(a))]
        if any(sum(same[i : i + least]) >= 0.95 * least for i in range(len(a) - least + 1)):
            return True
    return False


def test_whole_query_against_brute_force(spark):
    """All pairs of 200 documents: each with a run that is 95 % the same as an earlier one's has a passage, and every passage holds."""
    rng = random.Random(24)
    pool = [some(rng, rng.randint(30, 140)) for _ in range(25)]
    texts = {}
    for i in range(200):
        words = some(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(pool)
            a = rng.randrange(0, len(part) // 3)
            words += [*edited(rng, part[a:], rng.choice((0, 0, 0.02, 0.04))), *some(rng, rng.randint(0, 40))]
        texts[i] = words
    docs = table(spark, {i: " ".join(w) for i, w in texts.items()})
    rows = P.find_passages(docs).collect()
    for p in rows:
        a, b = texts[p.doc_id][p.begin_word : p.end_word], texts[p.source_id][p.source_begin : p.source_end]
        assert p.source_id < p.doc_id and len(a) >= P.LEAST_WORDS
        row = [0] * (len(b) + 1)  # longest common subsequence
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
            row = new
        assert row[-1] >= P.SIMILARITY * max(len(a), len(b)) - 1e-6
        assert p.similarity <= row[-1] / max(len(a), len(b)) + 1e-6
    wanted = {i for i in texts if any(similar_runs(texts[i], texts[j]) for j in range(i))}
    found = {p.doc_id for p in rows}
    assert len(wanted - found) <= 0.02 * len(wanted)
