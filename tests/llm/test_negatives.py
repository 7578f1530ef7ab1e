"""Hard negatives against a full comparison of all rows."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

from minekit.llm import negatives, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, norm string, cluster string"


def brute(rows, every=50):
    """``rows``: id, label, whole vector."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in rows if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            hard = [(n, j) for n, j, l in scored if l != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(hard[:3], 1)]
    return sorted(out)


def sound(data, every=7):
    rows = {}
    for i, v, label, *_ in sorted((r for r in data if None not in r[:3]), key=lambda r: r[0]):
        if all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % every == 0 else label
            row = label, [math.floor(256 * float(np.float32(x))) for x in v]
            rows[i] = min(rows.get(i, row), row)
    return [(i, *r) for i, r in rows.items()]


def mined(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = negatives.mine(negatives.whole_vectors(negatives.moved_labels(df)))
    assert got.dtypes == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
        ("positive_score", "bigint"), ("negative_score", "bigint"),
    ]
    return sorted(map(tuple, got.collect()))


def test_query_equals_brute_force(spark):
    if not Path(DATA).exists():
        pytest.skip("test tables are not present")
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, DATA).collect())) == brute(sound(rows))


def test_small_blocks_stretches_and_ties(spark, monkeypatch):
    for name, value in (("CLUSTERS", 5), ("BLOCK", 3), ("STRETCH", 100), ("_STEP", 16)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    data = []
    for i in range(1200):
        kind = rng.randrange(4)
        if kind == 0:  # equal vectors
            v = base[rng.randrange(5)]
        elif kind == 1:
            v = [x + rng.gauss(0, 0.2) for x in base[rng.randrange(5)]]
        else:
            v = [rng.gauss(0, rng.choice([0.2, 1, 5])) for _ in range(6)]
        data.append((i, v, rng.choice([0, 0, 0, 1, 2, 9]), "k", "k"))
    assert mined(spark, data) == brute(sound(data))


def test_odd_rows(spark):
    rng = random.Random(5)
    v = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    data = [(i, v(), i % 3, None, None) for i in range(0, 200, 2)]
    data += [
        (300, None, 1, "k", "k"), (301, v(), None, "k", "k"), (None, v(), 1, "k", "k"),
        (350, [1.0, None, 0.0, 0.0], 1, "k", "k"), (352, [1.0, float("nan"), 0.0, 0.0], 1, "k", "k"),
        (354, [1.0, float("inf"), 0.0, 0.0], 1, "k", "k"), (400, [0.0] * 4, 1, "k", "k"), (401, [], 2, "k", "k"),
        (450, [1.0, 0.5], 0, "k", "k"), (500, v(), 7, "k", "k"),
        data[3], data[25], (4, [0.9] * 4, 0, "k", "k"),
    ]
    assert mined(spark, data) == brute(sound(data)) != []
    assert mined(spark, []) == [] == mined(spark, [(50, [1.0], 3, None, None)])


def test_great_numbers_stay_exact(spark):
    rng = random.Random(6)
    data = [(i, [rng.uniform(-1, 1) * 2.0**18 for _ in range(8)], i % 2, None, None) for i in range(0, 300, 2)]
    assert mined(spark, data) == brute(sound(data))


def test_bound_holds():
    rng = np.random.default_rng(7)
    rows, anchors = rng.normal(size=(400, 5)), rng.normal(size=(60, 5))
    to = negatives.centroids(negatives.unit(anchors), 4)
    apart = negatives.angles(negatives.unit(anchors), to)
    own = apart.argmin(axis=1)
    widest = np.array([max(apart[own == c, c], default=0.0) for c in range(4)])
    limit = negatives.bounds(rows, to, widest)
    assert (rows @ negatives.unit(anchors).T <= limit[:, own] + 1e-9).all()


def test_a_walk_stops_when_certified():
    import pandas as pd

    near = pd.DataFrame({"id": [1, 2], "label": [1, 1], "v": [[10, 0], [9, 0]], "bound": [10.0, 9.0]})
    rest = pd.DataFrame({"id": [3], "label": [1], "v": [[1, 0]], "bound": [1.0]})
    asks = [[{"key": 0, "low": -np.inf, "high": np.inf, "floor": None}]]
    walk = negatives.Walk(pd.DataFrame({"id": [0], "label": [1], "norm": [4.0], "v": [[4, 0]], "asks": asks}), True, 2, 2, float)
    walk.offer(near)
    assert not walk.over
    walk.offer(rest)
    assert walk.over and walk.out()["other"].tolist() == [1, 2]
