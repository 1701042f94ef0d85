"""SimHash near-duplicates with covering locality-sensitive hashing.

The 64 bits get vectors over GF(2) of dimension RADIUS + 1, none of them zero; a table is a non-zero
vector v, and its mask holds the bits whose vectors are not orthogonal to v. Any RADIUS bits
leave a v orthogonal to all of them, so a pair that differs in at most RADIUS bits agrees under
that mask: no pair within the radius is missed. 15 tables compare 32 to 35 bits each.

Equal fingerprints are merged first. Inside a bucket all pairs are compared and only a spanning
forest of the links is returned. Fingerprints of a bucket that holds more than ``BUCKET`` are
masked again, by a covering of the bits that their mask leaves open; after at most three such
rounds too few bits are open for a bucket to be large. So no bucket is cut or skipped.

Edge cases: null and empty texts, and texts without words, have the fingerprint zero and link
like any other; texts of one or two words are one shingle; repeated rows share a component;
each row is a document of its own, with or without an id and whoever shares it, and links by its text alone; the
component of a group none of whose rows has an id is null; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowloom.llm import rows as table_rows, scratch
from flowloom.llm.components import components
from flowloom.llm.words import slices, texts_of

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Most fingerprints of a bucket that are compared pair by pair. At 256 or more, a larger bucket leaves nine
#: bits open at least, and each mask of their covering closes two or more of them, so the rounds end.
BUCKET = 1024
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprints of texts: a bit is set if it is set in over half the hashes.

    Bits are counted eight at a time, in the bytes of 64-bit numbers, over runs of at most 255.
    """
    hashes = [shingle_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes, every = sizes[full], np.concatenate(hashes)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    runs = -(-sizes // 255)
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    starts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    found = np.zeros(len(full), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((every >> np.uint64(j)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            found |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + j)
    out[full] = found
    return out


def fingerprints(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, other columns if asked for, and fp (the fingerprint as a signed long) of all documents (doc_id, text)."""
    names = ["doc_id", *more]
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = fingerprints_of(texts_of(part, "text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], [*names, "fp"])

    return documents.select(*names, "text").mapInArrow(run, f"{kinds}, fp long")


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``bits`` such that any pair within the radius on them agrees under one mask."""
    size = 1 << (radius + 1)
    vector = {bit: i % (size - 1) + 1 for i, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints of a bucket, as pairs of rep."""
    n = len(fp)
    if n == 2:
        a, b = int(fp[0]), int(fp[1])
        return [(int(rep[0]), int(rep[1]))] if (a ^ b).bit_count() <= radius else []
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n - 1):
        for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(rep[i]), int(rep[j])))
    return out


#: Rows of the bucket pass: links (mask is null) and members of buckets to be masked again.
_PASS = "a long, b long, mask long, fp long, rep long"


def _bucket_pass(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "mask", "fp", "rep"]

        def batch(links: list, over: list) -> pa.RecordBatch:
            rows = [(a, b, None, None, None) for a, b in links] + [(None, None, m, f, r) for m, f, r in over]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        links, over = [], []
        held_fp, held_rep, held_key, large = [], [], None, False

        def close() -> None:
            if held_fp and not large and sum(map(len, held_fp)) > 1:
                links.extend(_links(np.concatenate(held_fp).view(np.uint64), np.concatenate(held_rep), radius))

        for b in batches:
            mask, key, fp, rep = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(mask):
                continue
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1, [len(mask)]])
            # runs of one row that cannot touch a neighbouring batch hold no pair
            size = np.diff(cuts)
            wanted = np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1))
            for r in wanted.tolist():
                i, j = int(cuts[r]), int(cuts[r + 1])
                now = (int(mask[i]), int(key[i]))
                if now != held_key:
                    close()
                    held_fp, held_rep, held_key, large = [], [], now, False
                held_fp.append(fp[i:j])
                held_rep.append(rep[i:j])
                if large or sum(map(len, held_fp)) > BUCKET:
                    large = True
                    for f, p in zip(held_fp, held_rep, strict=True):
                        over.extend(zip(repeat(now[0]), f.tolist(), p.tolist()))
                    held_fp, held_rep = [], []
                if len(links) + len(over) > 50_000:
                    yield batch(links, over)
                    links.clear()
                    over.clear()
        close()
        if links or over:
            yield batch(links, over)

    return run


def _mask_again(radius: int):
    """Each row under the masks of a covering of the bits that its mask leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, fp, rep = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for m in np.unique(mask).tolist():
                own = mask == m
                for finer in covering([i for i in range(BITS) if not m >> i & 1], radius):
                    whole = np.full(own.sum(), signed((finer | m) & (1 << 64) - 1), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (whole, whole & fp[own], fp[own], rep[own])], ["mask", "key", "fp", "rep"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b: reps) that join all distinct fingerprints within the radius (nodes: fp, rep)."""
    masks = F.array(*(F.lit(signed(m)) for m in covering(list(range(BITS)), radius)))
    rows = nodes.select(F.explode(masks).alias("mask"), "fp", "rep").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")
    found = None
    while True:
        sorted_rows = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").select("mask", "key", "fp", "rep")
        passed = scratch.keep(sorted_rows.mapInArrow(_bucket_pass(radius), _PASS), "buckets")
        new = passed.where("mask is null").select("a", "b")
        found = new if found is None else found.unionByName(new)
        over = passed.where("mask is not null").select("mask", "fp", "rep")
        if over.isEmpty():
            return found
        rows = over.mapInArrow(_mask_again(radius), "mask long, key long, fp long, rep long").distinct()


def groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, first (smallest doc_id), copies and group (a fingerprint of its component) of the distinct fingerprints (rows: doc_id, fp)."""
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius)).select(F.col("node").alias("fp"), F.col("root").alias("group"))
    return scratch.keep(nodes.join(roots, "fp", "left").withColumn("group", F.coalesce("group", "fp")), "groups")


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of all documents (doc_id, text)."""
    rows = scratch.keep(fingerprints(documents), "fingerprints")
    found = groups(rows, radius)
    # only fingerprints that are shared or linked can have another component than the document's own id
    whole = found.groupBy("group").agg(F.min("first").alias("component"), F.sum("copies").alias("n")).where("n > 1").drop("n")
    joint = found.join(whole, "group").select("fp", "component")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(joint, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))


def first_of_groups(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, those without one last; of rows that share it one, by hash."""
    own = table_rows.free_name(documents, "_row")
    rows = fingerprints(documents.withColumn(own, table_rows.row_hash(documents)), own).withColumnRenamed(own, "row")
    rows = scratch.keep(rows, "fingerprints")
    found = groups(rows, radius)
    several = found.groupBy("group").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    placed = rows.join(found.join(several, "group").select("fp", "group"), "fp").withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    equal = scratch.keep(placed.groupBy("group", "place").agg(F.count("*").alias("n_rows")), "group-rows")
    first = equal.groupBy("group").agg(F.min("place").alias("first"))
    stays = F.col("place") == F.col("first")
    marks = equal.join(first, "group").where(~stays | (F.col("n_rows") > 1))
    return table_rows.repeat_rows(documents, marks.select("place.row", "place.doc_id", "n_rows", stays.cast("int").alias("times")), otherwise=1)
