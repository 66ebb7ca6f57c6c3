import hashlib
import math

import numpy as np
import pytest

from gigledger.llm.centroids import VantageTree, clustered


def brute(rows, k=8, rounds=10, width=64, scale=1024, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))

    def order(row):
        digest = hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest() if row[0] is not None else "~"
        return digest, np.array(row[1], "<i8").tobytes()

    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for e in range(len(centroids)):
            own = [v for (_, v), (_, x) in zip(kept, found) if x == e]
            if own:
                centroids[e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    out = []
    for (i, _), (d, e) in zip(kept, found):
        out.append((i, e, d, sum(x for x, y in found if y == e), sum(x for x, _ in found), hashlib.sha256(",".join(map(str, centroids[e])).encode()).hexdigest(), sum(y == e for _, y in found)))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, distance long")


def some(n, width, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, width))
    return [(i, (scale * (centres[i % 5] + r.normal(scale=0.4, size=width))).round(2).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    rows = some(300, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (5000, None), (5001, [None] * 6), (5002, [math.nan] * 6), (5003, [math.inf] + [0.0] * 5), (5004, [1.0]), (5005, []), (5006, [0.5] * 5 + [None])]
    df = frame(spark, rows).repartition(5)
    assert sorted(map(tuple, clustered(df, width=6).collect()), key=str) == brute(rows, width=6)
    assert sorted(map(tuple, clustered(df, width=6, k=40, rounds=3).collect()), key=str) == brute(rows, width=6, k=40, rounds=3)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = some(n, 4)
    assert sorted(map(tuple, clustered(frame(spark, rows), width=4).collect()), key=str) == brute(rows, width=4)


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in some(40, 3, scale=300_000.0)]
    rows += [(100, [1e6, -1e6, 3e5])]
    assert sorted(map(tuple, clustered(frame(spark, rows), width=3, k=4, rounds=2).collect()), key=str) == brute(rows, width=3, k=4, rounds=2)
    clustered(frame(spark, [*rows, (9, [1e300, -1e300, 0.0])]), width=3).collect()


def test_tree_search_prunes_and_keeps_ties():
    r = np.random.default_rng(2)
    for k in (1, 2, 3, 8, 64, 300):
        c = r.integers(-4, 5, size=(k, 3))  # many equal distances and equal centroids
        v = r.integers(-6, 7, size=(2000, 3))
        number, distance, _ = VantageTree(c).nearest(v)
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (distance == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()
    c = r.integers(-1000, 1000, size=(300, 2))
    v = r.integers(-1000, 1000, size=(2000, 2))
    assert VantageTree(c).nearest(v)[2] < 0.2 * 2000 * 300
