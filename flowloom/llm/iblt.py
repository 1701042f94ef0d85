"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line with a word. Its digest, with the number of its earlier occurrences in the
text, is a key; a sketch adds count, key and check of every key to one cell in each of three
parts. Subtracting the sketches of two versions leaves the paragraphs that differ, and peeling cells that
hold one key recovers their digests. Where peeling fails, both texts are sketched again with ``GROW``
times the cells, until it ends.

Paragraphs that differ are looked at once more: each is cut after every word whose hash is divisible by
``PIECE``, so that an edit changes the pieces it touches only, and the pieces are sketched, subtracted and
peeled in the same way. Likeness is the Jaccard similarity of the two multisets of pieces; pieces of paragraphs that
both texts have are common to both. The fingerprint is the sketches of all paragraphs and of all
pieces with ``CELLS`` cells each, in base64, with a dot between.

Versions are compared with their neighbour in descending order of id (after the last, the
first). Ids are cut into ranges at approximate quantiles, and the largest id of each range is
copied to the range before it in that order, so every range can be worked on alone.

Edge cases: null texts are empty; texts without words have an empty sketch and are alike;
rows that share an id are ordered by a hash of the text; rows without an id come last; a table of
one row has itself as neighbour; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.words import SLICE_BYTES, Words, mix

PIECE = 4
PARTS, CELLS, GROW = 3, 24, 4
#: Rows that a range of ids should hold, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4000, 10_000
_NO_ID = -(1 << 63)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _numbered(digest: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Keys of digests: each with the number of equal ones before it in its group."""
    order = np.lexsort((digest, group))
    d, g = digest[order], group[order]
    new = np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]))[: len(d)]
    first = np.flatnonzero(new)
    nth = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
    keys = np.empty(len(d), np.uint64)
    with np.errstate(over="ignore"):
        keys[order] = mix(d + nth.astype(np.uint64) * _SALT)
    return keys


class Keys:
    """Paragraphs and pieces of some texts, in their order.

    key, text: of each paragraph; piece: digest of each piece; piece_at: the first piece of each paragraph, and
    the number of all; size: pieces of each text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        words = Words(texts)
        line = np.searchsorted(np.flatnonzero(words.buffer == 10), words.start)
        last = np.append(line[1:] != line[:-1], True)[: len(line)]
        cut = last | (words.hash % np.uint64(PIECE) == 0)
        first, digest = _runs(words.hash, last)
        self.text = words.text[first]
        self.key = _numbered(digest, self.text)
        at, self.piece = _runs(words.hash, cut)
        self.piece_at = np.append(np.searchsorted(at, first), len(at))
        self.size = np.bincount(words.text[at], minlength=len(texts))

    def of(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs of the picked texts, and which pick each belongs to."""
        return _spread(np.searchsorted(self.text, picked), np.searchsorted(self.text, picked, side="right"))

    def pieces(self, paragraphs: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pieces of paragraphs, and the pair of each."""
        at, nth = _spread(self.piece_at[paragraphs], self.piece_at[paragraphs + 1])
        return _numbered(self.piece[at], pair[nth]), pair[nth]

    def fingerprints(self, n: int) -> list[str]:
        """The fingerprints of the first n texts."""
        paragraphs, text = self.of(np.arange(n))
        both = Sketches(n, CELLS).add(self.key[paragraphs], text).strings(), Sketches(n, CELLS).add(*self.pieces(paragraphs, text)).strings()
        return [f"{a}.{b}" for a, b in zip(*both, strict=True)]


def _runs(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word and the digest of each run of words that an end closes."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    size = np.diff(np.append(first, len(hashes)))
    within = np.arange(len(hashes)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), _SALT))
        return first, mix(np.add.reduceat(hashes * powers[within], first) + size.astype(np.uint64))


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from begin[i] to end[i], and the i of each."""
    size = end - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]])[: len(size)], size) + np.arange(size.sum())
    return at.astype(np.int64), np.repeat(np.arange(len(size)), size)


class Sketches:
    """Sketches of n texts, arrays of shape (n, cells)."""

    def __init__(self, n: int, cells: int) -> None:
        self.cells = cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def add(self, keys: np.ndarray, text: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        """Add keys to the sketches of their texts (sign -1: take them away)."""
        part = self.cells // PARTS
        with np.errstate(over="ignore"):
            check = mix(keys ^ _SALT) & np.uint64(0xFFFFFFFF)
            times = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
            for p in range(PARTS):
                at = text * self.cells + p * part + (mix(keys + np.uint64(self.cells * PARTS + p) * _SALT) % np.uint64(part)).astype(np.int64)
                np.add.at(self.count, at, times)
                np.add.at(self.key, at, keys * times.view(np.uint64) if times.flags.c_contiguous else keys * np.ascontiguousarray(times).view(np.uint64))
                np.add.at(self.check, at, check * np.ascontiguousarray(times).view(np.uint64))
        return self

    def strings(self) -> list[str]:
        """The sketches in base64: of each cell four bytes of count, eight of key, four of check."""
        out = np.zeros(len(self.count), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        out["count"], out["key"], out["check"] = self.count, self.key, self.check & np.uint64(0xFFFFFFFF)
        raw, size = out.tobytes(), self.cells * out.itemsize
        return [base64.b64encode(raw[i : i + size]).decode() for i in range(0, len(raw), size)] if size else []

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take out all keys that can be: (text, key, sign) of each, and which texts are peeled whole."""
        texts, keys, signs = [], [], []
        live = np.flatnonzero((self.count == 1) | (self.count == -1))
        n = len(self.count) // self.cells
        while len(live):
            with np.errstate(over="ignore"):
                sign = self.count[live]
                key = np.where(sign > 0, self.key[live], np.uint64(0) - self.key[live])
                check = np.where(sign > 0, self.check[live], np.uint64(0) - self.check[live])
                pure = (np.abs(sign) == 1) & (check == mix(key ^ _SALT) & np.uint64(0xFFFFFFFF))
            text, key, sign = (live // self.cells)[pure], key[pure], sign[pure]
            if not len(key):
                break
            order = np.lexsort((key, text))
            new = np.append(True, (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1]))
            pick = order[new]
            text, key, sign = text[pick], key[pick], sign[pick]
            self.add(key, text, -sign)
            texts.append(text)
            keys.append(key)
            signs.append(sign)
            touched = np.zeros(n, bool)
            touched[text] = True
            live = np.flatnonzero(np.repeat(touched, self.cells) & (np.abs(self.count) == 1))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return join(texts, np.int64), join(keys, np.uint64), join(signs, np.int64), ~left.reshape(n, self.cells).any(1)


def differences(mine: tuple, theirs: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, key, sign) of all keys that one side of a pair has (sign -1: theirs); sides are (keys, pairs), sorted by pair."""
    found, open_, cells = [], np.arange(n), CELLS
    while len(open_):
        sketches = Sketches(len(open_), cells)
        for (key, pair), sign in ((mine, 1), (theirs, -1)):
            at, nth = _spread(np.searchsorted(pair, open_), np.searchsorted(pair, open_, side="right"))
            sketches.add(key[at], nth, sign)
        pair, key, sign, whole = sketches.peel()
        sure = whole[pair]
        found.append((open_[pair[sure]], key[sure], sign[sure]))
        open_ = open_[~whole]
        cells *= GROW
    join = lambda i, kind: np.concatenate([f[i] for f in found] or [np.zeros(0, kind)])
    return join(0, np.int64), join(1, np.uint64), join(2, np.int64)


def compare_pairs(one: Keys, other: Keys, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[list[str]], list[list[str]]]:
    """Likeness of text left[i] of ``one`` to text right[i] of ``other``, and the paragraphs that only the one or the other has."""
    n = len(left)
    (mine, my_pair), (theirs, their_pair) = one.of(left), other.of(right)
    pair, key, sign = differences((one.key[mine], my_pair), (other.key[theirs], their_pair), n)
    rest, only = [], []
    for keys, paragraphs, of, side in ((one, mine, my_pair, sign > 0), (other, theirs, their_pair, sign < 0)):
        with np.errstate(over="ignore"):
            differs = np.isin(mix(keys.key[paragraphs] + of.astype(np.uint64) * _SALT), mix(key[side] + pair[side].astype(np.uint64) * _SALT))
        rest.append(keys.pieces(paragraphs[differs], of[differs]))
        only.append(_by_pair(pair[side], key[side], n))
    differ = np.bincount(differences(*rest, n)[0], minlength=n)
    sizes = one.size[left] + other.size[right]
    return np.where(sizes > 0, (sizes - differ) / np.maximum(1, sizes + differ), 1.0), *only


def _by_pair(pair: np.ndarray, key: np.ndarray, n: int) -> list[list[str]]:
    """The keys of each pair as sorted hexadecimal digits."""
    order = np.lexsort((key, pair))
    digits = [f"{k:016x}" for k in key[order].tolist()]
    ends = np.searchsorted(pair[order], np.arange(n), side="right").tolist()
    return [digits[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def compare(texts: list[str]) -> dict[str, list]:
    """The result columns for texts but the last, each with the one after it as neighbour."""
    n = len(texts) - 1
    chars = [len(t) for t in texts[:n]]
    edited = [(t[: c - c // 3] + after[: c // 3]).encode("utf-8") for t, after, c in zip(texts[:n], texts[1:], chars, strict=True)]
    own, new = Keys([t.encode("utf-8") for t in texts]), Keys(edited)
    here = np.arange(n)
    near_edited, lost, gained = compare_pairs(own, new, here, here)
    return {
        "n_chars": chars,
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": own.fingerprints(n),
        "edited_fingerprint": new.fingerprints(n),
        "near_edited": near_edited,
        "near_next": compare_pairs(own, own, here, here + 1)[0],
        "edited_lost": lost,
        "edited_new": gained,
    }


#: edited_lost and edited_new: recovered digests of the paragraphs that only the text, or only the edited text, has.
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_lost array<string>, edited_new array<string>"
_ARROW = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]


def neighbours(documents: DataFrame) -> DataFrame:
    """Rows (range, tail, doc_id, text) sorted inside partitions: ranges in one piece, ids descending, then the row that follows the range."""
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rank"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / RANGE_ROWS)))
    cuts = np.unique(np.array(ids.approxQuantile("rank", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else [], np.float64)).astype(np.int64)

    @F.pandas_udf("long")
    def range_of(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, rank.to_numpy(), side="right"))

    tops = sorted((r[0], r[1]) for r in ids.select(range_of("rank").alias("range"), "rank").groupBy("range").agg(F.max("rank")).collect())
    keys = np.array([top for _, top in tops], np.int64)
    goes = np.array([tops[(i + 1) % len(tops)][0] for i in range(len(tops))], np.int64)

    @F.pandas_udf("array<long>")
    def places(rank: pd.Series) -> pd.Series:
        rank = rank.to_numpy()
        own = np.searchsorted(cuts, rank, side="right")
        at = np.minimum(np.searchsorted(keys, rank), len(keys) - 1)
        top = keys[at] == rank
        return pd.Series([[o, g] if t else [o] for o, g, t in zip(own.tolist(), goes[at].tolist(), top.tolist(), strict=True)])

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rank"))
    rows = rows.select("doc_id", "text", "rank", F.posexplode(places("rank")).alias("tail", "range")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionById(ranges, F.col("range").cast("int")).sortWithinPartitions("range", "tail", F.desc("rank"), "h")
    return rows.select("range", "tail", "doc_id", "text")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of all documents (doc_id, text) and of their edited texts, and how alike they are."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, now, done = [], [], 0, None, True
        for b in batches:
            doc_ids = b.column(2)
            for i, (range_, tail, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True)):
                if range_ != now:
                    ids, texts, size, now, done = [], [], 0, range_, False
                if done:  # further rows of the id that follows
                    continue
                texts.append(text.as_py())
                size += len(texts[-1])
                if tail or size > SLICE_BYTES and len(texts) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, doc_ids.type), *map(pa.array, compare(texts).values(), _ARROW)], names)
                    ids, texts, size = [], texts[-1:], len(texts[-1])
                if tail:
                    done = True
                else:
                    ids.append(doc_ids[i].as_py())

    return neighbours(documents).mapInArrow(run, f"doc_id {kind}, {RESULT}")
