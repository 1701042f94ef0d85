"""Substring dedup by collinear chaining: fuzzy passages that a document shares with an earlier one.

Seeds are hashes of K words in lower case; of every WINDOW neighbouring ones the smallest is kept
(winnowing), so two texts that share a run of K + WINDOW - 1 words share a seed. Every seed is
joined to its first occurrence (smallest id, then position), never to all others: matches grow
with the words, whatever the size of a group of copies. The matches of two documents are
chained in order with a cost for gaps, the best chain to each match being found through a
Fenwick tree over positions in the earlier document. Chains are aligned word by word: gaps
between matches by edit distance; the ends straight on and by chains of END_K-word matches, in a window around
the chain, or in the whole texts if the alignment meets the edge of that. Of the alignment, the longest segments with at
least ``LEAST_WORDS`` words and a similarity of ``SIMILARITY`` are passages.

A first occurrence may stand in a document that has only part of a passage. So two neighbouring
matches of a document with different sources are a key of their own, and a match with the first document
that repeats it: the parts may come from several sources, the whole is found in the first document that joins
them. What is open then is looked up exactly: of each run of LEAST_WORDS words the smallest hash of ANCHOR words is its anchor. Where an
anchor occurs in an earlier document too and passages do not cover its runs, the hashes of whole
runs, there and at all places of that anchor, are joined to their first occurrence. So every
word of a run of LEAST_WORDS words that an earlier document has lies in a passage.

A key that more than one row in HOT has is joined by broadcast (there are at most HOT of these), so no
key makes one task large.

Chains are compared by 32-bit hashes of words. Texts are only sent to documents that take part
in a chain, and of those only the words around the chain meet.

Edge cases: null, empty and short texts have no passages; repetition inside one document is
not looked for; ids should be unique, rows that share one are taken as one document; rows
without an id are neither searched nor sources; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm import rows as table_rows, scratch
from flowloom.llm.words import Words, slices, texts_of

K, WINDOW = 5, 8
LEAST_WORDS, SIMILARITY = 50, 0.8
#: Words of an anchor; fewer give fewer rows, but more that are shared by chance.
ANCHOR = 12
#: Cost of each word skipped in either text by a link of a chain.
GAP = 0.04
#: Words around a chain in which its ends may be extended, and words of a match by which they are.
MARGIN, END_K = 64, 3
#: Next matches, and words up to them, that make a key with a match.
NEIGHBOURS, NEAR = 8, 30
#: A key with more than this share of the rows is hot.
HOT = 2000
#: Most ids of documents in chains that are broadcast.
BROADCAST_IDS = 1_000_000


# ---------------------------------------------------------------- seeds and matches


def winnow(words: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the seeds of all texts."""
    first, key = words.windows(k)
    if len(key) < window:
        return first[:0], key[:0]
    text = words.text[first]
    inside = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
    at = np.lib.stride_tricks.sliding_window_view(key, window).argmin(axis=1)[inside] + inside
    at = np.unique(at)
    return first[at], key[at]


def anchors(words: Words, k: int = ANCHOR, run: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors of all texts, and the first words of the first and the last run that each stands for."""
    first, key = words.windows(k)
    window = run - k + 1
    if len(key) < window:
        return key[:0], first[:0], first[:0]
    text = words.text[first]
    inside = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
    views = np.lib.stride_tricks.sliding_window_view(key, window)
    # argmin copies the views, so a few at a time
    at = np.concatenate([views[i : i + 10_000].argmin(axis=1) for i in range(0, len(views), 10_000)])[inside] + inside
    at, begin, n = np.unique(at, return_index=True, return_counts=True)
    return key[at], first[inside[begin]], first[inside[begin + n - 1]]


def seeds(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """h, doc_id, pos and last of all seeds and anchors of documents with at least ``least_words`` words.

    pos is the first word of a seed; of an anchor, pos and last are the first words of its first and last run.
    For seeds last is null.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words([t.lower() for t in texts_of(part, "text")])
            first, key = winnow(words)
            text = words.text[first]
            long = words.counts[text] >= least_words
            first, key, text = first[long], key[long], text[long]
            before = np.concatenate([[0], np.cumsum(words.counts)])
            names, doc = ["h", "doc_id", "pos", "last"], part.column(0)
            place = lambda w, t: pa.array((w - before[t]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), doc.take(pa.array(text)), place(first, text), pa.nulls(len(key), pa.int32())], names)
            key, first, last = anchors(words, run=least_words)
            text = words.text[first]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), doc.take(pa.array(text)), place(first, text), place(last, text)], names)

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, f"h long, doc_id {kind}, pos int, last int")


def repeated(found: DataFrame, label: str, rows: DataFrame | None = None) -> DataFrame:
    """The rows (h, doc_id, pos and others; of found, or some of these) whose h several documents have, with its first place: s, spos."""
    first = found.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = first.where("last != first.doc_id").select("h", "n", F.col("first.doc_id").alias("s"), F.col("first.pos").alias("spos"))
    first = scratch.keep(first, label)
    rows, few = found if rows is None else rows, found.count() // HOT
    hot, rest = F.broadcast(first.where(F.col("n") > few).drop("n")), first.where(F.col("n") <= few).drop("n")
    return rows.join(hot, "h").unionByName(rows.join(hot.select("h"), "h", "left_anti").join(rest, "h"))


def matches(found: DataFrame, label: str = "first") -> DataFrame:
    """t, s, tpos, spos: each seed of a document and its first occurrence, in an earlier document."""
    return repeated(found, label).where("doc_id != s").select(F.col("doc_id").alias("t"), "s", F.col("pos").alias("tpos"), "spos")


def joints(met: DataFrame) -> DataFrame:
    """h, doc_id, pos: neighbouring matches with different sources, each such pair as one key."""
    order = Window.partitionBy("t").orderBy("tpos", "s", "spos")
    after = F.array(*(F.lead(F.struct("s", "spos", "tpos"), n).over(order) for n in range(1, NEIGHBOURS + 1)))
    rows = met.withColumn("after", after).select("t", "s", "tpos", "spos", F.explode("after").alias("next")).where(f"next.s != s and next.tpos - tpos <= {NEAR}")
    return rows.select(F.xxhash64("s", "spos", "next.s", "next.spos").alias("h"), F.col("t").alias("doc_id"), F.col("tpos").alias("pos"))


# ---------------------------------------------------------------- chaining


class Fenwick:
    """Largest value, and where it came from, over prefixes."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def below(self, i: int) -> tuple[float, int]:
        """Over positions smaller than i."""
        found = (-np.inf, -1)
        while i > 0:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chains(t: np.ndarray, s: np.ndarray, k: int = K, gap: float = GAP, least: int = 2) -> list[np.ndarray]:
    """Chains of at least ``least`` of the matches (t ascending), as arrays of their numbers.

    A chain is worth k for each match less ``gap`` for every word between successive matches in
    either text; t and s both ascend along it. The best chain is taken, then the best of the rest
    that shares nothing with it, and so on.
    """
    n = len(t)
    if n < least:
        return []
    step_t, step_s = np.diff(t), np.diff(s)
    if (step_s > 0).all() and (step_t > 0).all() and (gap * (step_t + step_s) < k).all():
        return [np.arange(n)]  # every link gains, so one chain holds all
    rank = np.searchsorted(np.unique(s), s).tolist()
    tree, score, back = Fenwick(n), [0.0] * n, [-1] * n
    ts, sums, waiting = t.tolist(), (gap * (t + s)).tolist(), []
    for j in range(n):
        if waiting and ts[waiting[0]] < ts[j]:
            for i in waiting:
                tree.put(rank[i], (score[i] + sums[i], i))
            waiting = []
        best, i = tree.below(rank[j])
        score[j], back[j] = (k + best - sums[j], i) if best - sums[j] > 0 else (float(k), -1)
        waiting.append(j)
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda x: -score[x]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if len(path) >= least:
            out.append(np.array(path[::-1]))
    return out


def _chain_rows(least: int):
    """Chains (t, s, anchors) of at least ``least`` matches that come sorted by t, s, tpos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def close() -> list[tuple]:
            if sum(len(x) for x, _ in held) < least:
                return []
            t, s = (np.concatenate(x).astype(np.int64) for x in zip(*held, strict=True))
            return [(*now, np.stack([t[c], s[c]]).astype(np.int32).tobytes()) for c in chains(t, s, least=least)]

        def batch(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
            t, s, anchors = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(t, like.column(0).type), pa.array(s, like.column(1).type), pa.array(anchors, pa.binary())], ["t", "s", "anchors"])

        like = None
        for b in batches:
            if not b.num_rows:
                continue
            like, rows = b, []
            t, s, tpos, spos = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (s[1:] != s[:-1])) + 1, [len(t)]])
            size = np.diff(cuts)
            edge = np.zeros(len(size), bool)
            edge[[0, -1]] = True
            for r in np.flatnonzero((size >= least) | edge).tolist():
                i, j = int(cuts[r]), int(cuts[r + 1])
                if (t[i], s[i]) != now:
                    rows += close()
                    held, now = [], (t[i], s[i])
                held.append((tpos[i:j], spos[i:j]))
            if rows:
                yield batch(rows, b)
        if rows := close():
            yield batch(rows, like)

    return run


def chained(met: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Chains (t, s, anchors) of matches."""
    kind = met.schema["t"].dataType.simpleString()
    rows = met.select("t", "s", "tpos", "spos").repartition("t").sortWithinPartitions("t", "s", "tpos", "spos")
    return scratch.keep(rows.mapInArrow(_chain_rows(least), f"t {kind}, s {kind}, anchors binary"), label)


# ---------------------------------------------------------------- alignment


def align_gap(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of equal words on an alignment of two short texts with fewest edits."""
    cost = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    cost[0] = np.arange(len(b) + 1)
    across = np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        row = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != a[i - 1]))
        row = np.concatenate([[i], row])
        cost[i] = np.minimum.accumulate(row - across) + across
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] == b[j]:
                pairs.append((i, j))
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _extend(same: np.ndarray) -> int:
    """Words to extend by: where matches outweigh mismatches most, before a run of mismatches ends it."""
    total = best = n = 0
    for i, x in enumerate(same.tolist(), 1):
        total += 1 if x else -2
        if total > best:
            best, n = total, i
        elif best - total > 12:
            break
    return n


def further(a: np.ndarray, b: np.ndarray, k: int = END_K) -> list[tuple[int, int]]:
    """Chain of k-word matches in two short texts that goes on from a match just before both."""
    one, two = (list(zip(*(x[i:] for i in range(k)))) for x in (a.tolist(), b.tolist()))
    both = set(one).intersection(two)
    if not both:
        return []
    places: dict[tuple, list[int]] = {}
    for j, key in enumerate(two):
        if key in both:
            places.setdefault(key, []).append(j)
    found = [(i, j) for i, key in enumerate(one) if key in both for j in places[key]]
    t, s = np.array([(-k, -k), *found]).T
    return next(([found[x - 1] for x in c[1:].tolist()] for c in chains(t, s, k) if c[0] == 0), [])


def ahead(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Where the alignment of a match just before both texts goes on: runs (in a, in b, words)."""
    out, i, j = [], 0, 0
    while True:
        room = min(len(a) - i, len(b) - j, 4 * MARGIN)
        if n := _extend(a[i : i + room] == b[j : j + room]):
            out.append((i, j, n))
            i, j = i + n, j + n
        new = further(a[i : i + MARGIN], b[j : j + MARGIN])
        out += [(i + x, j + y, END_K) for x, y in new]
        if new:
            i, j = i + new[-1][0] + END_K, j + new[-1][1] + END_K
        elif not n:
            return out


def align(a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Matched word pairs (in a, in b) of the alignment along a chain with matches at at, bt, and on from its ends."""
    pa_, pb = [], []

    def straight(i: int, j: int, n: int) -> None:
        eq = np.flatnonzero(a[i : i + n] == b[j : j + n])
        pa_.append(eq + i)
        pb.append(eq + j)

    i, j, x, y = int(at[0]), int(bt[0]), int(at[-1]) + k, int(bt[-1]) + k
    runs = [(i - u - n, j - v - n, n) for u, v, n in reversed(ahead(a[:i][::-1], b[:j][::-1]))]
    turns = np.append(True, np.diff(at - bt) != 0)
    first = np.flatnonzero(turns)
    last = np.append(first[1:], len(at)) - 1
    runs += [(int(at[f]), int(bt[f]), int(at[e] - at[f]) + k) for f, e in zip(first.tolist(), last.tolist())]
    runs += [(x + u, y + v, n) for u, v, n in ahead(a[x:], b[y:])]
    for r, (i, j, n) in enumerate(runs):
        if r + 1 == len(runs):
            straight(i, j, n)
            break
        ni, nj, _ = runs[r + 1]  # do not run past the next match in either text
        n = min(n, ni - i, nj - j)
        straight(i, j, n)
        for x, y in align_gap(a[i + n : ni], b[j + n : nj]):
            pa_.append(np.array([i + n + x]))
            pb.append(np.array([j + n + y]))
    return np.concatenate(pa_), np.concatenate(pb)


def _start_costs(total: np.ndarray, skipped: np.ndarray, cost: float) -> np.ndarray:
    """What a segment that begins at each pair takes off the sum up to its end: its own skipped words lie before it."""
    return total[:-1] - np.append(0.0, cost * skipped[1:])


def segments(pairs_a: np.ndarray, pairs_b: np.ndarray, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Passages on an alignment: (begin, end) in a, (begin, end) in b, similarity.

    A matched pair counts 1 - similarity, a word of the longer side without a pair costs similarity.
    Of the stretch in which matches outweigh the words without one most, the longest segment
    whose sum is not negative is taken, then what lies on either side of it is searched.
    """
    if len(pairs_a) < similarity * least:
        return []
    out, todo = [], [(0, len(pairs_a))]
    every = np.maximum(np.diff(pairs_a, prepend=pairs_a[:1] - 1), np.diff(pairs_b, prepend=pairs_b[:1] - 1)) - 1
    while todo:
        lo, hi = todo.pop()
        if hi - lo < similarity * least:
            continue
        skipped = every[lo:hi]
        total = np.append(0.0, np.cumsum(0.5 - 0.5 * np.append(0, skipped[1:])))
        start = _start_costs(total, skipped, 0.5)
        y = int((total[1:] - np.minimum.accumulate(start)).argmax())
        left, right = lo + int(start[: y + 1].argmin()), lo + y + 1
        if lo < left:
            todo.append((lo, left))
        if right < hi:
            todo.append((right, hi))
        skipped = every[left:right]
        total = np.append(0.0, np.cumsum((1 - similarity) - similarity * np.append(0, skipped[1:])))
        floor = np.minimum.accumulate(_start_costs(total, skipped, similarity))
        # of the beginnings that give each end a sum of zero or more, the first; rounding must not lose the exact share
        begin = np.searchsorted(-floor, -(total[1:] + 1e-9))
        own = pairs_a[left:right]
        length = np.where(begin < len(own), own - own[np.minimum(begin, len(own) - 1)] + 1, 0)
        y = int(length.argmax())
        if length[y] < least:
            continue
        i, j = left + int(begin[y]), left + y
        a0, a1, b0, b1 = int(pairs_a[i]), int(pairs_a[j]) + 1, int(pairs_b[i]), int(pairs_b[j]) + 1
        out.append((a0, a1, b0, b1, (j - i + 1) / max(a1 - a0, b1 - b0)))
        todo += [(left, i), (j + 1, right)]
    return sorted(out)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words = Words([t.lower() for t in texts_of(part, "text")])
        ends = np.cumsum(words.counts) * 4
        raw = (words.hash >> np.uint64(32)).astype(np.uint32).tobytes()
        rows = [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), words.counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "words"])


def _stopped(left_a: int, more_a: bool, left_b: int, more_b: bool, near: int = MARGIN // 4) -> bool:
    """Whether an alignment ends near the edge of a window (left: words up to there) and the text goes on (more)."""
    return more_a and left_a < near and (more_b or left_b > left_a) or more_b and left_b < near and (more_a or left_a > left_b)


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages, and the chains (anchors not null) whose alignment meets an edge of its window that is none of its text."""
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            t, s, anchors, t0, t_words, s0, s_words, own, other = (c[row].as_py() for c in batch.columns)
            at, bt = np.frombuffer(anchors, np.int32).reshape(2, -1).astype(np.int64)
            a, b = np.frombuffer(own, np.uint32), np.frombuffer(other, np.uint32)
            inside = (at - t0 + K <= len(a)) & (bt - s0 + K <= len(b))  # always, but for ids that are not unique
            there = set(b.tolist())
            # a passage holds so many words that b has too, and the window shows that many of it
            if not inside.any() or sum(map(there.__contains__, a.tolist())) < SIMILARITY * LEAST_WORDS:
                continue
            x, y = align(a, b, at[inside] - t0, bt[inside] - s0)
            early = _stopped(x[0], t0 > 0, y[0], s0 > 0)
            late = _stopped(len(a) - 1 - x[-1], len(a) == t_words, len(b) - 1 - y[-1], len(b) == s_words)
            if early or late:
                rows.append((t, None, None, s, None, None, None, anchors))
            else:
                rows += [(t, p + t0, q + t0, s, u + s0, v + s0, share, None) for p, q, u, v, share in segments(x, y)]
        if rows:
            yield _batch(rows, batch.column(0).type, [*_PASSAGE, "anchors"])


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of pairs of whole texts with all their open chains.

    A chain inside a passage that another has given is left out: it could only show the same words once more,
    as in texts that repeat a line.
    """
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            t, s, found, own, other = (c[row].as_py() for c in batch.columns)
            a, b = np.frombuffer(own, np.uint32), np.frombuffer(other, np.uint32)
            done: list[tuple[int, int, int, int, float]] = []
            for at, bt in sorted((np.frombuffer(x, np.int32).reshape(2, -1).astype(np.int64) for x in found), key=lambda c: c[0].tolist()):
                inside = (at + K <= len(a)) & (bt + K <= len(b))  # always, but for ids that are not unique
                if inside.any() and not any(p <= at[0] and at[-1] + K <= q for p, q, *_ in done):
                    done += segments(*align(a, b, at[inside], bt[inside]))
            rows += [(t, p, q, s, u, v, share) for p, q, u, v, share in done]
        if rows:
            yield _batch(rows, batch.column(0).type, _PASSAGE)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.int32(), kind, pa.int32(), pa.int32(), pa.float64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=names)


_PASSAGE = ["doc_id", "begin_word", "end_word", "source_id", "source_begin", "source_end", "similarity"]


def covered_words(passages: DataFrame) -> DataFrame:
    """doc_id and spans: the places of its passages in order."""
    return scratch.keep(passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("begin_word", "end_word"))).alias("spans")), "covered")


def exact_passages(documents: DataFrame, shared: DataFrame, passages: DataFrame) -> DataFrame:
    """Runs of LEAST_WORDS words or more that an earlier document has and passages do not cover."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    spans = covered_words(passages)
    # the word up to which passages cover all words from pos on
    reach = F.aggregate("spans", F.col("pos"), lambda end, p: F.when(p["begin_word"] <= end, F.greatest(end, p["end_word"])).otherwise(end))
    reach = F.coalesce(reach, F.col("pos"))
    open_ = (F.col("doc_id") != F.col("s")) & (reach < F.col("last") + LEAST_WORDS)
    shared = scratch.keep(shared.join(spans, "doc_id", "left").select("h", "doc_id", "pos", "last", open_.alias("open")), "anchors-open")
    wanted = scratch.keep(shared.where("open").select("h").distinct(), "anchors-wanted")
    places = shared.join(scratch.small(wanted, BROADCAST_IDS), "h", "left_semi")
    places = scratch.keep(places.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "last", "open")).alias("places")), "places")
    # ids are broadcast, the long rows of places are not
    texts = documents.select("doc_id", "text").join(scratch.small(places.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi").join(places.hint("shuffle_merge"), "doc_id")
    runs = scratch.keep(texts.mapInArrow(_run_hashes, f"h long, doc_id {kind}, pos int, open boolean"), "runs")
    met = runs.where("open").join(spans, "doc_id", "left").where(reach < F.col("pos") + LEAST_WORDS)
    met = repeated(runs, "first-runs", met.select("h", "doc_id", "pos").distinct()).where("doc_id != s")
    met = met.select("doc_id", F.col("s").alias("source_id"), "pos", (F.col("spos") - F.col("pos")).alias("shift"))
    one = ["doc_id", "source_id", "shift"]
    order = Window.partitionBy(*one).orderBy("pos")
    apart = F.coalesce(F.col("pos") - F.lag("pos").over(order) > LEAST_WORDS, F.lit(True)).cast("int")
    met = met.withColumn("apart", apart).withColumn("n", F.sum("apart").over(order))
    ends = met.groupBy(*one, "n").agg(F.min("pos").alias("begin_word"), (F.max("pos") + LEAST_WORDS).alias("end_word"))
    return ends.select(
        "doc_id", "begin_word", "end_word", "source_id", (F.col("begin_word") + F.col("shift")).alias("source_begin"), (F.col("end_word") + F.col("shift")).alias("source_end"), F.lit(1.0).alias("similarity")
    )


def _run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the runs at places of documents (doc_id, text, places)."""
    for part in slices(batches, "text"):
        words = Words([t.lower() for t in texts_of(part, "text")])
        begin, key = words.windows(LEAST_WORDS)
        before = np.concatenate([[0], np.cumsum(words.counts)])
        places = part.column(2)
        row = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
        pos, last, open_ = (c.to_numpy(zero_copy_only=False) for c in places.flatten().flatten())
        # all inside their text, but for ids that are not unique
        n = np.maximum(0, np.minimum(last, words.counts[row] - LEAST_WORDS) - pos + 1)
        row, pos, open_ = np.repeat(row, n), np.repeat(pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(open_, n)
        at = np.searchsorted(begin, before[row] + pos)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[at].view(np.int64)), part.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(open_.astype(bool))], ["h", "doc_id", "pos", "open"]
        )


def find_passages(documents: DataFrame) -> DataFrame:
    """Passages (words begin_word to end_word - 1 of doc_id) that an earlier document, source_id, has too."""
    found = scratch.keep(seeds(documents), "seeds")
    met = scratch.keep(matches(found.where("last is null")), "matches")
    shared = scratch.keep(repeated(found.where("last is not null"), "first-anchors").drop("spos"), "anchors")
    scratch.forget(found)
    fuzzy = aligned(documents, chained(met, "chains"))
    # what neighbouring matches with several sources join, where no passage is yet
    spans = covered_words(fuzzy).withColumnRenamed("doc_id", "t")
    inside = F.exists("spans", lambda p: (p["begin_word"] <= F.col("tpos")) & (F.col("tpos") < p["end_word"]))
    keys = scratch.keep(joints(met), "joints")
    more = matches(keys, "first-joints").distinct().join(spans, "t", "left").where(~F.coalesce(inside, F.lit(False)))
    scratch.forget(met)
    fuzzy = fuzzy.unionByName(aligned(documents, chained(more, "joint-chains", least=1)))
    return fuzzy.unionByName(exact_passages(documents, shared, fuzzy))


def aligned(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Passages on the alignments of chains: in a window around each, or in the whole texts where that is too narrow."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = scratch.keep(found.select(F.col("t").alias("doc_id")).union(found.select("s")).distinct(), "chained-ids")
    taking_part = documents.select("doc_id", "text").join(scratch.small(ids, BROADCAST_IDS), "doc_id", "left_semi")
    words = scratch.keep(taking_part.mapInArrow(_word_rows, f"doc_id {kind}, words binary"), "words")
    own = words.select(F.col("doc_id").alias("t"), F.col("words").alias("own"))
    other = words.select(F.col("doc_id").alias("s"), F.col("words").alias("other"))
    cut = lambda c, first, n: F.substr(c, F.col(first) * 4 + 1, F.col(n) * 4)
    ends = found.mapInArrow(_spans, f"t {kind}, s {kind}, anchors binary, t0 int, t_words int, s0 int, s_words int")
    met = ends.join(own, "t").withColumn("own", cut("own", "t0", "t_words")).join(other, "s").withColumn("other", cut("other", "s0", "s_words"))
    passage = f"doc_id {kind}, begin_word int, end_word int, source_id {kind}, source_begin int, source_end int, similarity double"
    rows = met.select("t", "s", "anchors", "t0", "t_words", "s0", "s_words", "own", "other").mapInArrow(_passage_rows, f"{passage}, anchors binary")
    rows = scratch.keep(rows, "chained-passages")
    open_ = rows.where("anchors is not null").groupBy(F.col("doc_id").alias("t"), F.col("source_id").alias("s")).agg(F.collect_list("anchors").alias("found"))
    whole = open_.join(own, "t").join(other, "s").select("t", "s", "found", "own", "other").mapInArrow(_whole_rows, passage)
    return scratch.keep(rows.where("anchors is null").drop("anchors").unionByName(whole).distinct(), "fuzzy-passages")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains with the words of either text that their alignment may need."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.array([(x[0, 0], x[0, -1], x[1, 0], x[1, -1]) for x in (np.frombuffer(a, np.int32).reshape(2, -1) for a in batch.column(2).to_pylist())])
        t0, s0 = np.maximum(0, ends[:, 0] - MARGIN), np.maximum(0, ends[:, 2] - MARGIN)
        new = [t0, ends[:, 1] + K + MARGIN - t0, s0, ends[:, 3] + K + MARGIN - s0]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int32)) for x in new)], ["t", "s", "anchors", "t0", "t_words", "s0", "s_words"])


def repeated_words(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """All documents with their passages: doc_id, n_repeated_words, passages (in order of begin_word)."""
    fields = [c for c in _PASSAGE if c != "doc_id"]
    by = passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("passages"))
    none = F.expr("from_json('[]', '%s')" % by.schema["passages"].dataType.simpleString())
    rows = documents.select("doc_id").join(by, "doc_id", "left").select("doc_id", F.coalesce("passages", none).alias("passages"))
    # words in the union of the spans: what each adds beyond the furthest end so far
    step = lambda acc, p: F.struct(
        (acc["n"] + F.greatest(F.lit(0), p["end_word"] - F.greatest(acc["end"], p["begin_word"]))).alias("n"), F.greatest(acc["end"], p["end_word"]).alias("end")
    )
    n = F.aggregate("passages", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    return rows.select("doc_id", n.alias("n_repeated_words"), "passages")


def remove_passages(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents (doc_id, text and other columns) without their passages; those with no word left go.

    A passage goes from its first word up to the word after it.
    """
    own = table_rows.free_name(documents, "_spans")
    spans = passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("begin_word", "end_word"))).alias(own))
    spans = scratch.keep(spans, "spans")
    touched = documents.join(scratch.small(spans, BROADCAST_IDS), "doc_id", "left")
    schema = documents.schema
    names = schema.fieldNames()
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, cuts = texts_of(part, "text"), part.column(len(names)).to_pylist()
            words = Words(texts)
            before = np.concatenate([[0], np.cumsum(words.counts)])
            kept, out = [], []
            for i, (text, spans_) in enumerate(zip(texts, cuts, strict=True)):
                if spans_:
                    starts = words.start[before[i] : before[i + 1]] - words.text_at[i]
                    places = np.append(starts, len(text))
                    pieces, done, left = [], 0, len(starts)
                    for span in spans_:
                        a, b = max(done, span["begin_word"]), min(len(starts), span["end_word"])
                        if b > a:
                            pieces.append(text[places[done] if done else 0 : places[a]])
                            done, left = b, left - (b - a)
                    text = b"".join([*pieces, text[places[done] if done else 0 :]]).rstrip(b" \t\n\x0b\x0c\r")
                    if not left:
                        continue
                kept.append(i)
                out.append(text)
            rows = part.take(pa.array(kept, pa.int64()))
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if i == at else rows.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return touched.select(*table_rows.columns(documents), own).mapInArrow(run, schema)
