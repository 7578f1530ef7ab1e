import re

import fixtures
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from minekit.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id reachable, from (id, fingerprint)."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, x) in enumerate(prints):
            for j, (_, y) in enumerate(prints):
                if label[j] < label[i] and (x ^ y).bit_count() <= 2:
                    label[i], changed = label[j], True
    ids = {}
    for (doc, _), k in zip(prints, label):
        if doc is not None:
            ids[k] = min(ids.get(k, doc), doc)
    return [ids.get(k) for k in label]


def test_fingerprints_and_components_equal_brute_force(docs):
    data = fixtures.rows()
    prints = [(r[0], brute_fingerprint(r[1] or "")) for r in data]
    want = sorted(
        tuple(map(repr, (d, f"{x:016x}", c))) for (d, x), c in zip(prints, brute_components(prints))
    )
    got = simhash.digest_columns(simhash.near_duplicates(docs))
    assert fixtures.pairs(got, "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("tile", [4, 64, 1024])
def test_links_connect_what_is_close(spark, monkeypatch, tile):
    """Random fingerprints, chains of neighbours and a large group around one centre."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(tile)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    values = {int(c) for c in centres} | {0, 2**64 - 1}
    for c in centres[:20]:
        x = int(c)
        for _ in range(12):  # a chain: each link flips two bits more
            for bit in rng.integers(0, 64, 2):
                x ^= 1 << int(bit)
            values.add(x)
    values |= {int(centres[0]) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} if tile != 4 else set()
    nodes = np.array(sorted(values), np.uint64)
    signed = nodes.view(np.int64).tolist()
    label = np.arange(len(nodes))
    while True:
        new = np.array([label[np.bitwise_count(x ^ nodes) <= 2].min() for x in nodes])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, bits long").repartition(5)
    got = {r.bits: r.component_id for r in simhash.grouped(df).collect()}
    assert got == {v: int(k) for v, k in zip(signed, label)}


def test_close_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    tile = rng.integers(0, 2**63, 200, dtype=np.uint64)
    queries = tile[:70] ^ (np.uint64(1) << rng.integers(0, 64, 70, dtype=np.uint64))
    queries[::3] ^= np.uint64(6)
    want = {(i, j) for i, q in enumerate(queries) for j in np.flatnonzero(np.bitwise_count(q ^ tile) <= 2)}
    assert set(zip(*map(np.ndarray.tolist, simhash.close_pairs(queries, tile)))) == want


def test_one_of_each_keeps_the_smallest(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    data = fixtures.rows()
    ids = brute_components([(r[0], brute_fingerprint(r[1] or "")) for r in data])
    assert sorted(map(repr, [r.doc_id for r in kept.collect()])) == sorted(map(repr, set(ids)))


def test_large_groups_stay_within_a_tile(spark):
    """No compared group is larger than two tiles, however hot its key."""
    df = spark.range(5000).select(F.col("id").alias("bits"))
    found = simhash.components(simhash.links(df))
    assert found.count() == 4999 and found.select("b").distinct().count() == 1


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.one_of_each(no_docs).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 9])
def test_any_radius_equals_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    values = {int(c) for c in rng.integers(0, 2**63, 30, dtype=np.uint64)}
    for c in list(values):
        for flips in range(radius + 2):
            values.add(c ^ sum(1 << int(k) for k in rng.permutation(64)[:flips]))
    nodes = np.array(sorted(values), np.uint64)
    q, t = simhash.close_pairs(nodes, nodes, radius=radius)
    near = {(i, j) for i, x in enumerate(nodes) for j, y in enumerate(nodes) if int(x ^ y).bit_count() <= radius}
    assert set(zip(q.tolist(), t.tolist())) == near
    df = spark.createDataFrame([(int(x),) for x in nodes.view(np.int64)], "bits long").repartition(3)
    found = {r.a: r.b for r in simhash.components(simhash.links(df, radius)).collect()}
    signed = nodes.view(np.int64)
    label = np.arange(len(nodes))
    a, b = (np.array(x) for x in zip(*sorted(near)))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            break
        label = new
    parts = {}
    for x, k in zip(signed.tolist(), label.tolist()):
        parts.setdefault(k, []).append(x)
    assert found == {x: min(p) for p in parts.values() for x in p if x != min(p)}
