import math
import random
import zlib

import numpy as np

from gigledger.llm.quality import Features, subword_scores


def text(r, kind):
    words = ["".join(r.choice(["an", "the", "er", "on", "ing", "re"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 120))]
    if kind == "good":
        return " ".join(words)
    if kind == "loop":
        return " ".join([words[0]] * len(words))
    if kind == "shout":
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + r.choice(["###", "$$$"]) for w in words)


def test_features_do_not_cross_words():
    f = Features()
    a, b = f.of("alpha beta"), f.of("beta \n\t alpha")
    assert sorted(a.tolist()) == sorted(b.tolist()) and len(f.of(None)) == len(f.of("  ")) == 0
    assert len(f.of("ab")) == 1 + 2 + 1 + 1  # a word, <ab ab>, <ab>, a marker
    assert np.array_equal(f.of("alpha beta"), Features().of("alpha beta"))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 != 0
        rows.append((i, text(r, "good" if good else r.choice(["loop", "shout", "junk"]))))
        labels.append((i, int(good)))
    extra = [(5000, None), (5001, ""), (None, rows[1][1]), (1, rows[1][1]), (5002, "erre " * 60000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows + extra], "doc_id long, text string, label int")
    tags = spark.createDataFrame(labels + [(4, None), (None, 0)], "doc_id long, quality int")
    got = subword_scores(docs, tags).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= x.score <= 1 for x in got)
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id or "").encode()) % 3 == 1) for x in got if x.doc_id)
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.95
    assert [x.predicted for x in got if x.doc_id == 5002] == [0]
    assert all(x.score == 0.5 for x in subword_scores(docs, tags.limit(0)).collect())
    assert subword_scores(docs.limit(0), tags).collect() == []


def plain_features(text):
    """Bucket numbers by loops over words and characters, in Python's whole numbers."""
    from gigledger.llm.quality import _P, BUCKET_BITS

    full = 2**64 - 1

    def bucket(h, kind):
        h = ((h ^ (kind * 0x9E3779B97F4A7C15 & full)) * 0xBF58476D1CE4E5B9) & full
        h ^= h >> 32
        return ((h * 0x94D049BB133111EB) & full) >> (64 - BUCKET_BITS)

    words = (text or "").split()
    hashes = [sum(ord(c) * pow(_P, k, 2**64) for k, c in enumerate(w, 1)) & full for w in words]
    out = [bucket(h, 1) for h in hashes]
    for size in (3, 4):
        for w in words:
            padded = f" {w} "
            for a in range(len(padded) - size + 1):
                h = 0
                for c in padded[a : a + size]:
                    h = (h * _P + ord(c)) & full
                out.append(bucket(h, size))
    for h in hashes:
        n = hashes.count(h)
        out.append(bucket(min(7, int(math.log2(len(words) / n))) * 16 + min(6, int(math.log2(n))), 2))
    return out


def plain_training(rows, dim=16, epochs=10, rate=0.6, seed=7):
    """The same descent with one number at a time; only its random start and order are drawn alike."""
    from gigledger.llm.quality import BUCKET_BITS

    rng = np.random.default_rng(seed)
    start = ((rng.random((1 << BUCKET_BITS, dim), np.float32) - 0.5) * 2 / dim).tolist()
    vectors, output, bias = {}, [[0.0] * dim, [0.0] * dim], [0.0, 0.0]
    shares = []
    for text, label in rows:
        found = plain_features(text)
        counts = {b: found.count(b) / len(found) for b in set(found)}
        shares.append((counts, label))
        for b in counts:
            vectors.setdefault(b, list(start[b]))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            counts, label = shares[i]
            lr, done = rate * (1 - done / (epochs * len(rows))), done + 1
            mean = [sum(s * vectors[b][k] for b, s in counts.items()) for k in range(dim)]
            logits = [sum(o * m for o, m in zip(output[y], mean)) + bias[y] for y in (0, 1)]
            e = [math.exp(x - max(logits)) for x in logits]
            gap = [e[y] / sum(e) - (y == label) for y in (0, 1)]
            back = [gap[0] * output[0][k] + gap[1] * output[1][k] for k in range(dim)]
            for b, s in counts.items():
                vectors[b] = [v - lr * len(counts) ** 0.5 * s * x for v, x in zip(vectors[b], back)]
            for y in (0, 1):
                output[y] = [o - lr * gap[y] * m for o, m in zip(output[y], mean)]
                bias[y] -= 0.1 * lr * gap[y]

    def score(text):
        found = plain_features(text)
        mean = [sum((vectors[b] if b in vectors else start[b])[k] for b in found) / len(found) if found else 0.0 for k in range(dim)]
        logits = [sum(o * m for o, m in zip(output[y], mean)) + bias[y] for y in (0, 1)]
        return 1 / (1 + math.exp(logits[0] - logits[1]))

    return score


def test_query_equals_plain_features_and_descent(spark):
    r = random.Random(9)
    rows = [(i, " ".join(text(r, "good" if i % 2 else r.choice(["loop", "shout", "junk"])).split()[:14])) for i in range(60)]
    rows += [(7, "zz another text of a labelled id"), (7, rows[7][1]), (100, None), (101, " "), (102, "ünï çödé  \n x")]
    labels = [(i, i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.score) for x in subword_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    learnt = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = {i: min(t for j, t in rows if j == i) for i in learnt}
    score = plain_training([(texts[i], i % 2) for i in sorted(learnt)])
    want = sorted((i, score(t)) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 2e-3
