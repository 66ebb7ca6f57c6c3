import hashlib
import math

import numpy as np

from gigledger.llm.codes import Gnat, coded


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = []
    for i, v, label in rows:
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i8").tobytes()))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    size = len(kept[0][1]) // parts if kept else 0
    out = [["", 0] for _ in kept]
    books = []
    for p in range(parts):
        own = np.array([r[1][p * size : (p + 1) * size] for r in kept], np.int64).reshape(len(kept), size)
        book = own[:entries].copy()
        for step in range(rounds + 1):
            d = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            number = d.argmin(axis=1) if len(kept) else []
            if step < rounds:
                for e in range(len(book)):
                    if (number == e).any():
                        total = own[number == e].sum(axis=0)
                        book[e] = total // (number == e).sum()
        for i, e in enumerate(number):
            out[i][0] += f"{e:02x}"
            out[i][1] += int(d[i, e])
        books += [str(x) for x in book.ravel()]
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return sorted(((r[0], c, e, sum(x for (_, x), s in zip(out, kept) if s[2] == r[2]), digest) for r, (c, e) in zip(kept, out)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")


def some(n, width=8, seed=1):
    r = np.random.default_rng(seed)
    return [(i, (r.integers(-64, 64, size=width) / 64).tolist(), int(r.integers(3)) if i % 10 else None) for i in range(n)]


def check(spark, rows, **kw):
    assert sorted(map(tuple, coded(frame(spark, rows).repartition(3), **kw).collect()), key=str) == brute(rows, **kw)


def test_equals_brute_force(spark):
    rows = some(700)
    rows += [(1000 + i, rows[3][1], 1) for i in range(300)]
    rows += [(-5, rows[4][1], 2), (6, rows[9][1], None), (None, rows[5][1], 0), (-9, [1.0] * 6, 1), (-8, None, 1), (-7, [None] * 8, 1), (-6, [math.nan] * 8, 1), (-4, [math.inf] * 8, 0), (-3, [1.0] * 4, 0), (-2, [], 0)]
    rows.remove((-3, [1.0] * 4, 0))
    check(spark, rows)
    check(spark, rows, entries=20, rounds=2, parts=2)


def test_small_tables_and_no_labels(spark):
    check(spark, [])
    check(spark, some(3))
    check(spark, [(1, [0.5] * 4, 1)] * 300)
    check(spark, [(0, [1.0] * 4, 1), (1, [1.0] * 8, 1), (2, [2.0] * 4, None)])
    got = coded(frame(spark, some(30)).drop("label")).collect()
    assert {r.label_error for r in got} == {sum(r.error for r in got)}


def test_tree_search_prunes_and_keeps_ties():
    r = np.random.default_rng(2)
    for k in (1, 2, 9, 256, 1000):
        e = r.integers(-4, 5, size=(k, 3))
        q = r.integers(-6, 7, size=(2000, 3))
        number, distance, _ = Gnat(e).nearest(q)
        d = ((q[:, None] - e[None]) ** 2).sum(axis=2)
        assert (distance == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()
    e = r.integers(-1000, 1000, size=(256, 2))
    q = r.integers(-1000, 1000, size=(2000, 2))
    assert Gnat(e).nearest(q)[2] < 0.25 * 2000 * 256
    wide = Gnat(e.astype(object) * 2**40).nearest(q.astype(object) * 2**40)
    assert (wide[0] == Gnat(e).nearest(q)[0]).all() and max(wide[1]) > 2**63
