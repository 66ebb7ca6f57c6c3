import hashlib
import random
from collections import Counter

import numpy as np

from gigledger.llm import substring
from gigledger.llm.substring import remove_repeated_windows, window_hashes


def brute(rows, window):
    split = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = {k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_window_hash_equals_the_plain_sum():
    v = np.random.default_rng(0).integers(0, 2**63, 80, dtype=np.uint64)
    for w in (1, 2, 3, 7, 8, 35):
        got = window_hashes(v, w)
        want = [sum(int(v[i + k]) * pow(0x9E3779B97F4A7C15, w - 1 - k, 2**64) for k in range(w)) % 2**64 for i in range(len(v) - w + 1)]
        assert got.tolist() == want


def test_equals_brute_force_over_many_units(spark, monkeypatch):
    monkeypatch.setattr(substring, "UNIT_BYTES", 3000)
    monkeypatch.setattr(substring, "SHARD_WINDOWS", 200)
    monkeypatch.setattr(substring, "PACKET", 1)
    r = random.Random(2)
    vocab = [f"é{i}" for i in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(120):
        w = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if i % 3 == 0:
            w[5:5] = passage[: r.randint(30, 60)]
        rows.append((i, (" " if i % 2 else "\n\t").join(w)))
    rows += [(500, rows[7][1]), (500, rows[7][1]), (None, rows[9][1]), (None, None), (501, None), (502, ""), (503, "x " * 100), (504, " ".join(passage) + " " + " ".join(passage))]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, unit string, n_words int")
    for window in (35, 5):
        got = [tuple(x) for x in remove_repeated_windows(df, window=window).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, window), key=key)
    kept = remove_repeated_windows(df, carry=("unit", "n_words"), with_text=True).toDF("doc_id", "text", "unit", "given", "n", "gone", "sha").collect()
    assert len(kept) == len(rows) and all(x.unit == "b" and x.given == 1 for x in kept)
    assert all(hashlib.sha256(" ".join(x.text.split()).encode()).hexdigest() == x.sha for x in kept if x.text)
    assert remove_repeated_windows(df.limit(0)).collect() == []
