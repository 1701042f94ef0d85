import random

import numpy as np
import pytest
import xxhash

from flowloom.llm import simhash
from flowloom.llm.components import components
from tests.llm.conftest import ODD


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(items)
    for n, a in enumerate(items):
        for b in items[n + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_fingerprints_of_odd_texts(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    want = {i: f"{fingerprint(t or ''):016x}" for i, t, *_ in ODD}
    for r in rows:
        assert r.fingerprint == want[r.doc_id]
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == 1 and by[6] == 1 and by[3] == 2 and by[4] == 2 and by[9] == 9 and by[None] is None
    assert simhash.near_duplicates(none).count() == 0


def test_long_runs_are_counted_whole():
    text = " ".join(f"w{i % 700}" for i in range(5000))
    assert simhash.fingerprints_of([text.encode(), b"", b"a b", text.encode()]).tolist() == [fingerprint(text), 0, fingerprint("a b"), fingerprint(text)]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_masks_miss_no_pair(radius):
    masks = simhash.covering(list(range(64)), radius)
    rng = random.Random(radius)
    for _ in range(3000):
        bits = rng.sample(range(64), radius)
        flip = sum(1 << b for b in bits)
        assert any(not m & flip for m in masks)


@pytest.mark.parametrize("bucket", [256, 1024])
def test_links_join_all_within_the_radius(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for b in base:  # neighbourhoods that reach further than one link
        x = b
        for _ in range(40):
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
            if rng.random() < 0.5:
                x = b
    places = rng.sample(range(64), 12)  # many in one bucket, some of them far apart
    for _ in range(500):
        prints.add(base[0] ^ sum(1 << p for p in places if rng.random() < 0.5))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash.signed(p), i) for i, p in enumerate(prints)], "fp long, rep long")
    want = classes(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    assert {i: roots.get(i, i) for i in want} == want


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    rng.shuffle(edges)
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 61)) and all(roots[100 + i] == 100 for i in range(1, 50)) and roots[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {i: fp for i, (fp, _) in rows.items()} == {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    want = classes(sorted(rows), lambda a, b: (rows[a][0] ^ rows[b][0]).bit_count() <= 3)
    assert {i: c for i, (_, c) in rows.items()} == want


def test_bucket_links_are_a_forest():
    rng = np.random.default_rng(0)
    fp = np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
    found = simhash._links(np.unique(fp), np.arange(len(np.unique(fp))), 3)
    assert len(found) == len(np.unique(fp)) - 1
