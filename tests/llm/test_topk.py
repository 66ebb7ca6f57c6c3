import math
import random

import numpy as np

from gigledger.llm import topk
from gigledger.llm.topk import top_products


def brute(rows, every=50, k=5):
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for own, (i, q) in enumerate(good):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(good) if other != own)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert sorted(tuple(x) for x in top_products(df, **kw).collect()) == brute(rows, kw.get("query_every", 50), kw.get("k", 5))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 40)
    monkeypatch.setattr(topk, "LEAST", 10)
    monkeypatch.setattr(topk, "QUERIES", 7)
    r = np.random.default_rng(1)
    centres = r.normal(size=(6, 12))
    rows = []
    for i in range(600):
        v = centres[i % 6] + r.normal(scale=0.15, size=12)
        rows.append((i, (v * r.choice([0.1, 0.5, 1.0, 1.1])).tolist()))
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(150)]
    rows += [(2000, [0.0] * 12), (2050, [-x for x in hot]), (2100, None), (2150, [float("nan")] * 12), (2200, [None] * 12), (2250, []), (2300, [1.0]), (None, hot), (50, rows[51][1]), (50, rows[50][1]), (2350, [float("inf")] * 12)]
    check(spark, rows, query_every=10)
    check(spark, rows, k=1)


def test_wide_values_and_small_tables(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(80)]
    check(spark, rows)
    check(spark, rows[:3], query_every=1)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_products(df).collect() == []
    check(spark, [(0, [1.0, 2.0])])
