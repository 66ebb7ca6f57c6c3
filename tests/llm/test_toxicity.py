import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from gigledger.llm.toxicity import BLOCK, BlockMaxIndex, Vocabulary, nearest_label_scores, pack_vector, text_terms, unpack_vector, word_terms


def unit(terms, weights):
    norm = math.sqrt(sum(w * w for w in weights)) or 1
    return dict(zip(terms, (w / norm for w in weights)))


def test_index_equals_brute_force():
    r = random.Random(1)
    vectors = []
    for _ in range(5 * BLOCK + 3):
        terms = sorted({int(r.paretovariate(0.5)) % 400 for _ in range(r.randint(0, 30))})
        vectors.append(unit(terms, [r.random() for _ in terms]))
    ids = r.sample(range(10000), len(vectors))
    owner = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    terms = np.array([t for v in vectors for t in v], np.int64)
    weights = np.array([w for v in vectors for w in v.values()])
    index = BlockMaxIndex(np.array(ids), owner, terms, weights, 400)
    assert (index.row >= 0).any() and (index.row < 0).any()
    queries = []
    for _ in range(300):
        query = unit(t := sorted({int(r.paretovariate(0.5)) % 400 for _ in range(r.randint(0, 20))}), [r.random() for _ in t])
        queries.append((query, (np.array(list(query), np.int64), np.array(list(query.values())), ids[3])))
    for (query, _), got in zip(queries, index.nearest([q for _, q in queries], 7)):
        want = sorted((-round(sum(w * v.get(t, 0) for t, w in query.items()), 12), i) for i, v in zip(ids, vectors) if set(v) & set(query) and i != ids[3])[:7]
        assert [int(index.ids[at]) for at, _ in got] == [i for _, i in want] and np.allclose([s for _, s in got], [-s for s, _ in want], atol=1e-11)


def test_terms():
    assert word_terms("abc") == ("=abc",) and word_terms("scumbag") == ("=scumbag", "^scum")
    assert text_terms("Scum, scumbag SCUM x") == {"=scum": 2, "^scum": 3, "=scumbag": 1, "=x": 1, "=scum@": 1, "^scum@": 1}
    assert text_terms(None) == {} and text_terms("12 _ !") == {}
    assert "=scum@" in text_terms("scum scum " + "x " * 198) and "=scum@" not in text_terms("scum scum " + "x " * 199)
    known = ["=scum", "=x", "^scum", "^scum@"]
    found = Vocabulary(known).counts("Scum, scumbag SCUM x")
    assert [y.tolist() for y in found] == [[0, 1, 2, 3], [2, 1, 3, 1], [1, 1]]
    assert [y.tolist() for y in unpack_vector(pack_vector(*found))] == [y.tolist() for y in found]
    assert [len(y) for y in unpack_vector(pack_vector(*Vocabulary(known).counts(None)))] == [0, 0, 0]


def corpus(n=600, seed=2):
    r = random.Random(seed)
    bad = ["grobian", "lumpazi", "schuft"]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 7))}" for _ in range(r.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def brute(rows, labels, k=15, prior_votes=0.2):
    """Scores with plain dictionaries and every pair: term counts, document frequencies, association, cosines, votes."""

    def terms(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        count = Counter("=" + w for w in words) + Counter("^" + w[:4] for w in words if len(w) > 3)
        return {**count, **{t + "@": 1 for t, n in count.items() if n >= max(2, 0.01 * len(words))}}

    vectors = [(i, terms(t)) for i, t in rows]
    label = {i: y for i, y in labels if i is not None and y is not None and not held_out(i)}
    first = {}
    for i, t in rows:
        if i in label:
            first[i] = min(first.get(i, t or ""), t or "")
    examples = {i: terms(t) for i, t in first.items()}
    n = [sum(label[i] == y for i in examples) for y in (0, 1)]
    held = [Counter(t for i, c in examples.items() if label[i] == y for t in c) for y in (0, 1)]
    df = Counter(t for _, c in vectors for t in c)

    def factor(t):
        a, b = held[1][t], held[0][t]
        if not a + b:
            return (math.log((1 + len(rows)) / (1 + len(rows) / (len(examples) + 1))) + 1) / math.sqrt(len(examples))
        below = n[0] * n[1] * (a + b) * (sum(n) - a - b)
        phi = abs(a * (n[0] - b) - b * (n[1] - a)) / math.sqrt(below) if below else 0.0
        return (math.log((1 + len(rows)) / (1 + df[t])) + 1) * phi

    def vector(counts):
        return unit(list(counts), [(1 + math.log(c)) * factor(t) for t, c in counts.items()])

    unit_examples = {i: vector(c) for i, c in examples.items()}
    prior = n[1] / sum(n)
    out = []
    for i, counts in vectors:
        v = vector(counts)
        near = sorted((-round(sum(w * u.get(t, 0) for t, w in v.items()), 9), j) for j, u in unit_examples.items() if j != i)
        near = [(j, -s) for s, j in near if s < 0][:k]
        votes = [(1 / (1.05 - s), label[j]) for j, s in near]
        out.append((i, (sum(w * y for w, y in votes) + prior_votes * prior) / (sum(w for w, _ in votes) + prior_votes), [s for _, s in near]))
    return out


def test_equals_brute_force(spark):
    rows, labels = corpus(240, 5)
    rows += [(None, "grobian wab"), (7000, None), (7001, "  "), (7002, "unheard words only"), (rows[4][0], "another text of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nearest_label_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 6))
    want = sorted(brute(rows, labels), key=key)
    got = sorted(((r.doc_id, r.score, r.similarities) for r in got), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-6) and np.allclose(a[2], b[2], atol=1e-8)


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(5000, None), (5001, ""), (None, "grobian"), (5002, "grobian " * 20000), (5002, "grobian " * 20000)]
    docs = spark.createDataFrame([(*x, 3) for x in rows + extra], "doc_id long, text string, score int")
    tags = spark.createDataFrame(labels + [(5, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    got = {(r.doc_id, r.held_out): r for r in nearest_label_scores(docs, tags).collect()}
    truth = dict(labels)
    wrong = [i for (i, _), r in got.items() if i in truth and r.predicted != truth[i]]
    assert len(wrong) <= 0.01 * len(rows), wrong
    assert all(held == held_out(i) and 0 <= r.score <= 1 for (i, held), r in got.items())
    by_id = {i: r for (i, _), r in got.items()}
    assert by_id[5000].score == by_id[5001].score < 0.3 and by_id[5002].predicted == by_id[None].predicted == 1
    assert by_id[5002].neighbours and "=grobian" in by_id[5002].evidence
    nothing = nearest_label_scores(docs, tags.limit(0)).collect()
    assert len(nothing) == len(rows) + len(extra) and all(r.score == 0 for r in nothing)
    assert nearest_label_scores(docs.limit(0), tags).collect() == []
    bounded = nearest_label_scores(docs, tags, sample_bytes=20000).collect()
    assert len(bounded) == len(nothing) and sum(r.predicted for r in bounded) > 50
