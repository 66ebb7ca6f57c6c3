import random

import numpy as np
import xxhash

from gigledger.llm.graph import components
from gigledger.llm.simhash import drop_near_duplicates, fingerprint, near_pairs, simhash_groups


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2 and label[j] > label[i]:
                    label[j], changed = label[i], True
    groups = {}
    for i, l in enumerate(label):
        groups.setdefault(l, []).append(rows[i][0])
    return sorted(((rows[i][0] is None, rows[i][0]), f"{fps[i]:016x}", min((x for x in groups[label[i]] if x is not None), default=None)) for i in range(len(rows)))


def test_fingerprint_matches_the_plain_form():
    for text in (None, "", " \t\n", "One", "one two", "A b\x0bC d", "é É x Y z" * 9, "a b c " * 30000):
        assert fingerprint(text)[0] == plain_fingerprint(text)


def test_near_pairs_equal_brute_force():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 90, dtype=np.uint64)
    near = base[:60] ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(5)]))
    for radius in (0, 1, 2, 3, 5):
        i, j = near_pairs(fps, radius)
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(int(fps[a] ^ fps[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_groups_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        text = [r.choice(words) for _ in range(r.randint(1, 200))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(r.randint(0, 3)):
            other = list(text)
            other[r.randrange(len(other))] = r.choice(words)
            rows.append((len(rows), " ".join(other)))
    rows += [(900, None), (901, ""), (902, "\n"), (903, rows[0][1]), (903, rows[0][1]), (None, rows[1][1]), (None, "only this one has no id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((x.doc_id is None, x.doc_id), x.fingerprint, x.component_id) for x in simhash_groups(df).collect())
    key = lambda x: (x[0][0], x[0][1] or 0, x[1], x[2] or 0)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert simhash_groups(df.limit(0)).collect() == []


def similar_groups(rows, shingle=5, least=0.8):
    """Components of all pairs of texts whose sets of word shingles have the least Jaccard similarity."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    label = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label, pairs


def texts_with_copies(r, n, least_words=60):
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n):
        text = [r.choice(words) for _ in range(r.randint(least_words, 200))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(r.randint(0, 3)):
            other = list(text)
            other[r.randrange(len(other))] = r.choice(words)
            rows.append((len(rows), " ".join(other)))
    return rows


def test_filter_equals_brute_force(spark):
    rows = texts_with_copies(random.Random(4), 60)
    rows += [(900, None), (901, ""), (902, "\n"), (903, rows[0][1]), (903, rows[0][1]), (None, rows[1][1]), (None, "only this one has no id"), (None, "Only this  one has NO id"), (904, "a b"), (905, "A b"), (906, "long " * 20000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, c0 int").repartition(4)
    label, _ = similar_groups(rows)
    groups = {}
    for i, l in enumerate(label):
        groups.setdefault(l, []).append(rows[i][0])
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == sorted((i is None, i or 0) for i in want)
    assert drop_near_duplicates(df.limit(0)).collect() == []


def exact_keep(rows, shingle=5):
    """The smallest id of every component of texts whose shingle sets have a similarity of 0.8 or more, and each row's component."""
    sets = [{tuple(t.lower().split()[k : k + shingle]) for k in range(max(1, len(t.split()) - shingle + 1))} for _, t in rows]
    holders = {}
    for i, x in enumerate(sets):
        for g in x:
            holders.setdefault(g, []).append(i)
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    links = 0
    for i, x in enumerate(sets):
        shared = {}
        for g in x:
            for j in holders[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if both >= 0.8 * (len(x) + len(sets[j]) - both) - 1e-9:
                links += 1
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [rows[root(i)][0] for i in range(len(rows))], links


def changed(r, text, times, words):
    out = list(text)
    for k in r.sample(range(len(out)), times):
        out[k] = r.choice(words)
    return " ".join(out)


def test_versions_near_the_threshold(spark):
    """Versions of 120 words with one to three of them changed: links at 0.8 and a little above, many of which a nearest tree would not hold."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        text = [r.choice(words) for _ in range(120)]
        rows += [(len(rows) + k, changed(r, text, r.randint(1, 3), words)) for k in range(12)]
    want, links = exact_keep(rows)
    kept = {x.doc_id for x in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links > 500 and set(want) <= kept and len(kept) <= len(set(want)) + 2


def test_a_large_group_of_copies_keeps_its_links(spark, monkeypatch):
    """Keys of several bits, and one group that is compared in pairs of sub-blocks."""
    from gigledger.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 128)
    r = random.Random(6)
    rows = texts_with_copies(r, 500)
    words = [f"v{i}" for i in range(3000)]
    hot = [r.choice(words) for _ in range(120)]
    rows += [(10_000 + k, changed(r, hot, 2, words)) for k in range(700)]
    want, links = exact_keep(rows)
    kept = {x.doc_id for x in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links > 1000 and set(want) <= kept and len(kept) <= 1.01 * len(set(want))


def test_verified_forest_joins_what_pairs_join():
    from gigledger.llm.simhash import verified_forest

    r = np.random.default_rng(2)
    for n in (5, 40, 300):
        sets = [np.unique(r.choice(60, 40)).astype("<u4") for _ in range(n)]
        fps = np.zeros((n, 2), np.uint64)
        for sides in (None, r.integers(0, 2, n)):
            i, j = verified_forest(fps, sets, sides, 4, 0.6)
            label = np.arange(n)
            for a in range(n):
                for b in range(a):
                    both = len(set(sets[a]) & set(sets[b]))
                    if (sides is None or sides[a] != sides[b]) and both >= 0.6 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                        label[label == label[a]] = label[b]
            got = np.arange(n)
            for a, b in zip(i, j):
                assert got[a] != got[b] and label[a] == label[b]
                got[got == got[a]] = got[b]
            assert len(set(got)) == len(set(label))


def test_one_large_group_is_split_and_stays_whole(spark):
    from gigledger.llm import simhash

    r = random.Random(5)
    fps = {0}
    while len(fps) < 3000:  # all share most bits and form one component
        fps.add(r.choice(tuple(fps)[:50]) ^ (1 << r.randrange(40)) ^ (1 << r.randrange(40)))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = components(simhash.fingerprint_links(df))
    assert found.count() == len(fps) and found.select("root").distinct().count() == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}
    assert components(edges.limit(0)).collect() == []


def test_fewer_links_keep_the_components(spark):
    from gigledger.llm.graph import fewer_links

    r = random.Random(8)
    for _ in range(3):
        links = [(r.randrange(60), 100 + r.randrange(12)) for _ in range(70)] + [(3, 3)]
        df = spark.createDataFrame(links, "a long, b long")
        fewer = fewer_links(df)
        want, got = ({x.node: x.root for x in components(d).collect()} for d in (df, fewer))
        assert got == want and fewer.count() <= len({a for a, b in links if a != b}) + 12 * 11
