"""Look-backs and routes against brute force, with ties, hot keys and ranges that split them."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from gigledger.operators import routes, sweep
from gigledger.operators.sweep import LookBack, look_backs, ranged, running_sums, with_next

MEASURES = [LookBack("key_min", "k", 60), LookBack("all_min", None, 60), LookBack("bad_min", "k", 60, condition="bad"), LookBack("others", "k", 120, value="v"), LookBack("all_values", None, 90, value="v")]


def brute(rows):
    out = []
    for i, t, k, v, bad in rows:
        near = lambda m: [r for r in rows if t is not None and r[1] is not None and 0 <= (t - r[1]).total_seconds() <= m.seconds and (m.key is None or k is not None and r[2] == k)]  # noqa: B023, E731
        counts = [i]
        for m in MEASURES:
            met = near(m)
            if m.value:
                counts.append(len({r[3] for r in met} - {v, None}))
            else:
                counts.append(sum(1 for r in met if r[0] != i and (not m.condition or r[4])))
        out.append(tuple(counts))
    return sorted(out)


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_look_backs_equal_brute_force(spark, hot):
    r = random.Random(3)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(400):
        k = "hot" if r.random() < hot else r.choice(["a", "b", "c", None])
        rows.append((i, None if r.random() < 0.02 else t0 + dt.timedelta(seconds=r.randrange(900), microseconds=r.choice([0, 0, 1])), k, r.choice(["x", "y", "z", "w", None]), r.choice([True, False, None])))
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string, v string, bad boolean")
    got = look_backs(df, "id", "ts", MEASURES)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert look_backs(df.limit(0), "id", "ts", MEASURES).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_running_sums_and_next_rows_span_ranges(spark):
    rows = [("hot", i, float(i)) for i in range(300)] + [(None, i, 1.0) for i in range(40)] + [(f"k{i}", 0, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, o long, x double").repartition(5)
    dealt = ranged(df, ["k"], ["o"], parts=9)
    assert dealt.where("k = 'hot'").select(sweep.PART).distinct().count() > 3
    out = with_next(running_sums(dealt, ["k"], ["o"], {"n": F.lit(1), "s": F.col("x")}), ["k"], ["o"], {"to": "o"}).collect()
    assert len(out) == len(rows)
    for r in out:
        last = {"hot": 299, None: 39}.get(r.k, 0)
        assert r.n == r.o + 1 and r.to == (r.o + 1 if r.o < last else None)
        assert r.s == {"hot": r.o * (r.o + 1) / 2, None: r.o + 1.0}.get(r.k, 2.0)


def test_look_backs_of_one_key_stay_linear(spark):
    took = []
    for n in (100_000, 1_000_000):
        df = spark.range(n).select("id", (F.lit(1_700_000_000) + F.col("id") / 50).cast("timestamp").alias("ts"), F.lit("one").alias("k"), (F.col("id") % 977).cast("string").alias("v"))
        began = time.time()
        row = look_backs(df, "id", "ts", [LookBack("n", "k", 3600), LookBack("values", "k", 3600, value="v")]).agg(F.max("n"), F.max("values"), F.count(F.lit(1))).first()
        took.append(time.time() - began)
        assert tuple(row) == (min(n - 1, 180_000), 976, n)
    assert took[1] < 25 * took[0]


def test_one_route_has_half_of_all_stops(spark):
    r = random.Random(5)
    stops = [(0 if i % 2 else r.randrange(9), i // 3, i, f"t{i}", None if i % 11 == 0 else r.uniform(40, 41), r.uniform(10, 11)) for i in range(600)]
    df = spark.createDataFrame(stops, "route_id long, day long, stop long, title string, lat double, lng double").repartition(6)
    got = {(x.route_id, x.segment_order): (x.stop, x.to_stop, x.miles is None, x.drive_text) for x in routes.segments(df, "route_id", ["day", "stop"]).collect()}
    want = {}
    for route in {s[0] for s in stops}:
        own = sorted((s for s in stops if s[0] == route), key=lambda s: (s[1], s[2]))
        for n, (a, b) in enumerate(zip(own, own[1:]), 1):
            want[route, n] = (a[2], b[2], a[4] is None or b[4] is None)
    assert {k: x[:3] for k, x in got.items()} == want and all((x[3] is None) == x[2] for x in got.values())
    texts = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.42), (0.0, 0.0, 0.0, 0.4053)], "lat double, lng double, to_lat double, to_lng double").select(routes.legs()["drive_text"].alias("d"), routes.legs()["walk_text"].alias("w")).collect()
    assert [(t.d, t.w) for t in texts] == [("1 min drive", "1 min walk"), ("1 hr 2 min drive", None), ("1 hr drive", None)]
