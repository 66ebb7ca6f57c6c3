"""Each stage against a brute-force version on its own input, and run() against the stages."""

import random

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_simhash import similar_groups
from test_substring import brute as repeats
from test_toxicity import corpus


def tables(spark, folder):
    r = random.Random(11)
    rows, labels = corpus(240, seed=5)
    vocab = [f"v{i}" for i in range(500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(i, t + " " + text(40)) for i, t in rows]
    shared = text(60)
    item = "how many apples does the farmer keep after he sells 12 of 30 apples on the market today"
    rows += [(1000, rows[1][1]), (1001, rows[1][1]), (1002, text(80) + " " + shared + " " + text(30)), (1003, shared + " " + text(50)), (1004, text(30) + " " + item + " " + text(30)), (1005, None), (1006, ""), (1007, "v1 " * 3000)]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(labels), item


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path / "sf")
    labels, item = tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = ([(x.doc_id, x.text) for x in before.collect()], docs.collect())
        assert name == "packing" or docs.columns == columns

    given, kept = seen["toxicity"]
    assert {i for i, _ in given} - {x.doc_id for x in kept} == {i for i, y in labels.items() if y}

    given, kept = seen["near_duplicates"]
    label, _ = similar_groups(given)
    groups = {}
    for (i, _), l in zip(given, label):
        groups.setdefault(l, []).append(i)
    assert sorted(x.doc_id for x in kept) == sorted(min(g) for g in groups.values()) and len(kept) < len(given)

    given, kept = seen["substring_dedup"]
    want = {i: (n - gone, gone) for i, n, gone, _ in repeats(given, 35)}
    assert {x.doc_id: len((x.text or "").split()) for x in kept} == {i: n for i, (n, _) in want.items()}
    assert {want[1002][1], want[1003][1]} == {60} and all(x.n_chars == len(x.text or "") for x in kept)
    assert all(x.text == dict(given)[x.doc_id] for x in kept if not want[x.doc_id][1])

    given, kept = seen["decontamination"]
    benchmark = [(x.item_id, x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {d for d, _ in leaks(given, benchmark)}  # ids are unique here
    assert found == {1004} and {i for i, _ in given} - {x.doc_id for x in kept} == found

    given, pieces = seen["packing"]
    assert {x.doc_id for x in pieces} == {i for i, _ in given}
    bins = {}
    for x in pieces:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024

    key = lambda x: (x.doc_id, x.piece, x.start, x.length, x.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, pieces))


def test_rows_without_or_with_shared_ids(spark, tmp_path):
    """Every row is judged by its own text."""
    folder = str(tmp_path / "sf")
    labels, item = tables(spark, folder)
    toxic = next(x.text for x in spark.read.parquet(f"{folder}/documents.parquet").collect() if labels.get(x.doc_id))
    clean = "v9 v8 v7 v6 quite another text that nobody else has at all"
    rows = [(None, toxic), (7000, toxic), (7000, clean), (None, clean + " v1"), (7001, item), (7001, clean + " v2 v3"), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.unionByName(spark.read.parquet(f"{folder}/documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    left = {x.text for x in stages["toxicity"](spark, every, folder).collect()}
    assert toxic not in left and {t for _, t in rows if t != toxic} <= left
    left = {x.text for x in stages["decontamination"](spark, docs, folder).collect()}
    assert item not in left and {t for _, t in rows if t != item} <= left


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path / "sf")
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
