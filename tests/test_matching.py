"""Place and path matches against brute force, and many rows in one place."""

import math
import random

from pyspark.sql import functions as F

from gigledger.operators import matching


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def similar(x, y):
    return bool(x and y) and (x in y or y in x or 1 - edits(x, y) / max(len(x), len(y)) >= 0.82)


COLUMNS = "id long, name string, lat double, lng double, city string, state string, website string, phone string, category string"


def places(r, n):
    names = ["alpha hall", "alpha halls", "beta bar", "beta bar north", "gamma", "delta club", "delta klub", ""]
    return [
        (i, r.choice(names), None if r.random() < 0.1 else 50 + r.randrange(4) * 0.0002, None if r.random() < 0.05 else r.choice([8.0, 8.0004, 179.9999, -179.9999]), r.choice(["A", "a", "B", None]), r.choice(["X", None]), r.choice(["https://www.one.example.com/x", "http://one.example.com", "https://two.example.com", "no url", None]), r.choice(["1", "2", " ", None]), r.choice(["Food", "Concert", None]))
        for i in range(n)
    ]


def domain(u):
    u = (u or "").lower()
    return u.split("//")[1].split("/")[0].removeprefix("www.") if u.startswith("http") else None


def test_similar_places_equal_all_pairs(spark):
    r = random.Random(4)
    rows = places(r, 160)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {x.id: (x.poi_id, x.confidence, x.strategy) for x in matching.similar_places(df, df.withColumnRenamed("id", "poi_id"), "id", "poi_id", same=True).collect()}
    want = {}
    for a in rows:
        for b in rows:  # by id: the first that fits
            if a[0] == b[0] or (b[8] or "").lower() == "concert" or not similar(a[1], b[1]) or a[0] in want:
                continue
            near = None not in (a[2], a[3], b[2], b[3]) and metres(a[2], a[3], b[2], b[3]) <= 50
            here = ((a[4] or "").lower(), (a[5] or "").lower()) == ((b[4] or "").lower(), (b[5] or "").lower())
            if near:
                want[a[0]] = (b[0], "medium", "similar_name_nearby_geo")
            elif here and domain(a[6]) and domain(a[6]) == domain(b[6]):
                want[a[0]] = (b[0], "weak", "same_name_city_state_domain")
            elif here and (a[7] or "").strip() and a[7] == b[7]:
                want[a[0]] = (b[0], "weak", "same_name_city_state_phone")
    assert got == want and {v[2] for v in got.values()} == {"similar_name_nearby_geo", "same_name_city_state_domain", "same_name_city_state_phone"}
    assert matching.similar_places(df.limit(0), df.withColumnRenamed("id", "poi_id"), "id", "poi_id").collect() == []


def test_fifty_thousand_places_in_one_building(spark):
    n = 50_000
    df = spark.range(n).select("id", F.concat(F.lit("room "), F.chr(F.lit(97) + F.col("id") % 26), F.lit(" suite "), (F.col("id") % 200).cast("string")).alias("name"), (50 + F.col("id") % 5 * 0.00001).alias("lat"), (8 + F.col("id") % 7 * 0.00001).alias("lng"), F.lit("A").alias("city"), F.lit("X").alias("state"), F.lit("https://mall.example.com").alias("website"), F.lit(None).cast("string").alias("phone"))
    found = matching.similar_places(df, df.withColumnRenamed("id", "poi_id"), "id", "poi_id", same=True).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.max("poi_id").alias("last")).collect()
    assert [(r.confidence, r.n) for r in found] == [("medium", n)] and found[0].last < 5200
    assert matching.nearest(df, df.withColumnRenamed("id", "poi_id"), 100.0, "id", "poi_id").agg(F.count(F.lit(1)), F.max("distance"), F.max("poi_id")).first()[:] == (n, 0.0, 34)


def test_nearest_equals_all_pairs(spark):
    r = random.Random(9)
    a, b = places(r, 60), places(r, 60)
    left, right = spark.createDataFrame(a, COLUMNS), spark.createDataFrame([(i + 500, *x) for i, *x in b], COLUMNS).withColumnRenamed("id", "other")
    got = {x.id: x.other for x in matching.nearest(left, right, 60.0, "id", "other").collect()}
    want = {}
    for p in a:
        near = [(round(metres(p[2], p[3], q[2], q[3]), 6), q[0] + 500) for q in b if None not in (p[2], p[3], q[2], q[3])]
        near = [x for x in near if x[0] <= 60]
        if near:
            want[p[0]] = min(near)[1]
    assert got == want


def test_paths_meet_either_way(spark):
    r = random.Random(2)
    urls = [f"https://{r.choice(['a', 'b'])}.example.com" + "".join(f"/{r.choice('xyz')}" for _ in range(r.randrange(4))) + r.choice(["", "/", "?q=1", "#f"]) for _ in range(80)]
    known = [(i, u) for i, u in enumerate(urls[:30])]
    asked = [(i, u) for i, u in enumerate(urls[30:])]

    def parts(u):
        host, _, path = u.split("//")[1].split("?")[0].split("#")[0].partition("/")
        path = ("/" + path).rstrip("/")
        return host, path

    want = {}
    for i, u in asked:
        h, p = parts(u)
        fits = [j for j, k in known for g, q in [parts(k)] if g == h and (p == q or p.startswith(q + "/") or q.startswith(p + "/"))]
        if fits:
            want[i] = min(fits)
    df = lambda rows: spark.createDataFrame(rows, "id long, u string")
    assert {x.id: x.known_id for x in matching.path_matches(df(asked), df(known), "id", "u").collect()} == want
