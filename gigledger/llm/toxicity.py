"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms of a text are all of its words, their stems (a start mark and four characters) and a mark of its own for every
term that makes up a hundredth of the words. A term's weight is (1 + ln tf) times its inverse
document frequency over all documents times its association with the label in the examples (the
phi coefficient: near 0 for words that tell nothing, and small for words of a few copied texts).
No term is left out: those of the examples have postings, all others count in a text's norm.
The examples form an inverted index in blocks. Terms that few examples hold are added up from
their postings; terms that many hold have a largest weight per block, and a block whose bound
cannot reach the k-th similarity so far is not opened. What may be nearest is verified exactly.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import crc32_of_id, cut, numbered, without_rows

WORDS = re.compile(r"[^\W\d_]+")
REMEMBERED = 200_000  # words whose terms a worker holds; then it starts anew
BLOCK = 64  # examples of one block
DENSE = 0.01  # share of a document's words from which a term that occurs at least twice counts as dense
FREQUENT = 1 / 16  # share of the examples from which a term has block maxima
TOGETHER = 128  # texts that are compared at once
SLACK = 1e-5  # more than single precision can be off; what may be nearest is verified in double precision
NONE = np.iinfo(np.int64).min  # no stem
SLICE = 4096  # terms whose counts travel in one packet


# letters of Latin-1 in lower case, a space for every other byte
LETTERS = "".join(c if WORDS.fullmatch(c) else " " for c in map(str.lower, map(chr, range(256)))).encode("latin-1")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case; a text of Latin-1 alone is cut without the expression, which takes longer."""
    text = text or ""
    try:
        return text.encode("latin-1").translate(LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text.lower())


def word_terms(word: str) -> tuple[str, ...]:
    """A word and, from four characters on, its stem."""
    return ("=" + word, "^" + word[:4]) if len(word) >= 4 else ("=" + word,)


def text_terms(text: str | None) -> Counter:
    """Counts of all terms of a whole text; marks of dense terms end in @ and count once."""
    words = Counter(words_of(text))
    out: Counter = Counter()
    for word, n in words.items():
        for term in word_terms(word):
            out[term] += n
    dense = max(2, DENSE * words.total())
    for term in [t for t, n in out.items() if n >= dense]:
        out[term + "@"] = 1
    return out


class _Known(dict):
    """word -> its place in a table of term numbers; each word is looked up once."""

    def __init__(self, ids: dict[str, int]):
        self.ids, self.others = ids, {}
        self.table = np.zeros((2, 4096), np.int64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[1, at] = NONE
        for i, term in enumerate(word_terms(word)):  # a term that no example holds has a negative number of its own
            self.table[i, at] = self.ids[term] if term in self.ids else self.others.setdefault(term, -1 - len(self.others))
        return at


class Vocabulary:
    """Numbers of the examples' terms, and whole texts as counts of them."""

    def __init__(self, terms: list[str]):
        ids = dict(zip(terms, range(len(terms))))
        self.known = _Known(ids)
        self.mark = np.array([ids.get(t + "@", -1) for t in terms], np.int64)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted numbers of the terms that examples hold, their counts, counts of all other terms)."""
        words = Counter(words_of(text))
        if len(self.known) >= REMEMBERED:
            self.known = _Known(self.known.ids)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        times = np.fromiter(words.values(), np.int64, len(words))
        first, second = self.known.table[:, at]
        stemmed = second != NONE
        terms, back = np.unique(np.concatenate([first, second[stemmed]]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([times, times[stemmed]]), len(terms)).astype(np.int64)
        inside = terms >= 0
        dense = counts >= max(2, DENSE * int(times.sum()))
        marks = self.mark[terms[inside & dense]]
        marks = marks[marks >= 0]
        others = np.concatenate([counts[~inside], np.ones(np.count_nonzero(dense) - len(marks), np.int64)])
        terms, counts = np.concatenate([terms[inside], marks]), np.concatenate([counts[inside], np.ones(len(marks), np.int64)])
        order = np.argsort(terms)
        return terms[order], counts[order], others


_HELD: dict[str, Vocabulary] = {}  # the vocabulary a worker used last


def vocabulary_of(words: str) -> Vocabulary:
    if words not in _HELD:
        _HELD.clear()
        _HELD[words] = Vocabulary(words.split(" "))
    return _HELD[words]


def pack_vector(terms: np.ndarray, counts: np.ndarray, others: np.ndarray) -> bytes:
    """Sorted numbers as steps, then counts, then other counts; packed."""
    head = np.array([len(terms), len(others)], "<u4").tobytes()
    steps = np.diff(terms, prepend=0)
    return zlib.compress(head + b"".join(x.astype("<u4").tobytes() for x in (steps, counts, others)), 1)


def unpack_vector(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    n = int(values[0])
    return np.cumsum(values[2 : 2 + n]), values[2 + n : 2 + 2 * n], values[2 + 2 * n :]


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids, at most half of them of either class, in the order of a hash; (doc_id, label, weight).

    weight is how many labelled rows of its class a sampled row stands for. An id labelled more
    than once counts once, with its largest label; null ids and labels do not count.
    """
    clean = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    clean = clean.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r.n for r in clean.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for label in (0, 1):
        taken = min(rows // 2, sizes.get(label, 0))
        of_class = clean.where((F.col("label") > 0) == F.lit(bool(label)))
        parts.append(of_class.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2).select("doc_id", F.lit(label).alias("label"), F.lit(sizes.get(label, 0) / max(1, taken)).alias("weight")))
    return parts[0].unionByName(parts[1])


class Examples:
    """Labelled examples (id, label, weight, terms, counts) by numbered terms, and each term's association with the label among them."""

    def __init__(self, rows):
        ids: dict[str, int] = {}
        found = []
        for doc, label, weight, terms, counts in rows:
            numbers = np.fromiter((ids.setdefault(t, len(ids)) for t in terms.split(" ")) if terms else (), np.int32)
            found.append((doc, label, weight, numbers, np.frombuffer(counts, "<u4")))
        found.sort(key=lambda r: r[0])
        names = sorted(ids)  # numbers follow the terms' order, whatever the order of the rows
        number = np.empty(len(names), np.int32)
        number[np.fromiter((ids[t] for t in names), np.int64, len(names))] = np.arange(len(names))
        self.names = names
        self.ids = np.array([r[0] for r in found], np.int64)
        self.labels = np.array([r[1] for r in found], np.int64)
        self.weights = np.array([r[2] for r in found])
        self.terms = number[np.concatenate([r[3] for r in found])] if found else np.zeros(0, np.int32)
        self.counts = np.concatenate([r[4] for r in found]) if found else np.zeros(0, np.uint32)
        self.owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(r[3]) for r in found])
        n1, n0 = float(self.labels.sum()), float(len(found) - self.labels.sum())
        toxic = self.labels[self.owner] == 1
        a, b = (np.bincount(self.terms[m], minlength=len(names)).astype(float) for m in (toxic, ~toxic))
        with np.errstate(divide="ignore", invalid="ignore"):
            phi2 = (a * (n0 - b) - b * (n1 - a)) ** 2 / (n0 * n1 * (a + b) * (n0 + n1 - a - b))
        self.phi = np.sqrt(np.nan_to_num(phi2, nan=0.0, posinf=0.0))

    def factors(self, frequency: np.ndarray, total: int) -> tuple[np.ndarray, float]:
        """(idf times association of every numbered term, that of terms which no example holds).

        A term that none of n examples holds is taken to be in one of n + 1 documents and to be
        as loosely tied to the label as chance makes it, which is 1 / sqrt(n).
        """
        n = max(1, len(self.ids))
        return (np.log((1 + total) / (1 + frequency)) + 1) * self.phi, (math.log((1 + total) / (1 + total / (n + 1))) + 1) / math.sqrt(n)


class BlockMaxIndex:
    """Sparse unit vectors (owner, terms, weights) in blocks, with per-term block maxima; exact k best by cosine."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int):
        n = len(ids)
        heaviest = np.full(n, -1, np.int64)
        by_weight = np.lexsort((terms, weights, owner)).astype(np.int32)
        heaviest[owner[by_weight]] = terms[by_weight]  # the last one written is the heaviest
        del by_weight
        self.order = np.lexsort((ids, heaviest))  # examples with the same heaviest term are neighbours
        self.ids = ids[self.order]
        self.blocks = max(1, -(-n // BLOCK))
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        place = place[owner]
        held = np.bincount(terms, minlength=size)
        frequent = np.nonzero(held >= max(BLOCK, n * FREQUENT))[0]
        self.row = np.full(size, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        row = self.row[terms]
        many = row >= 0
        self.dense = np.zeros((self.blocks, len(frequent), BLOCK), np.float32)
        self.dense[place[many] // BLOCK, row[many], place[many] % BLOCK] = weights[many]
        self.highest = self.dense.max(axis=2).T
        few = np.nonzero(~many)[0]
        few = few[np.lexsort((place[few], terms[few]))]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(terms[few], minlength=size))])
        self.place, self.weight = place[few].astype(np.int32), weights[few]
        del few, many, row
        by_place = np.lexsort((terms, place)).astype(np.int32)
        self.vector, self.value = terms[by_place].astype(np.int32), weights[by_place]
        del by_place
        self.first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=n))])
        self.query = np.zeros(size)

    def _add(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What rare terms add to every example's product, from their postings."""
        begin = self.start[terms]
        size = self.start[terms + 1] - begin
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        return np.bincount(self.place[at], self.weight[at] * np.repeat(weights, size), self.blocks * BLOCK)

    def _products(self, places: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole products with single examples, from their own vectors."""
        self.query[terms] = weights
        begin, end = self.first[places], self.first[places + 1]
        held = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist())]
        vector, value = (np.concatenate([x[at] for at in held]) if held else x[:0] for x in (self.vector, self.value))
        out = np.bincount(np.repeat(np.arange(len(places)), end - begin), self.query[vector] * value, len(places))
        self.query[terms] = 0.0
        return np.round(out, 12)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray, int | None]], k: int) -> list[list[tuple[int, float]]]:
        """Per query (terms, weights, id of the text itself): [(position in the index, cosine)] of the k most similar others with a cosine above 0; ties to the smaller id."""
        n = len(self.ids)
        scores = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        asked = np.zeros((len(queries), self.dense.shape[1]), np.float32)
        for i, (terms, weights, _) in enumerate(queries):
            row = self.row[terms]
            few = row < 0
            scores[i] = self._add(terms[few], weights[few])
            asked[i, row[~few]] = weights[~few]
        bound = scores.reshape(len(queries), self.blocks, BLOCK).max(axis=2) + asked @ self.highest + SLACK
        opened = np.zeros(bound.shape, bool)
        want = bound >= np.sort(bound, axis=1)[:, -min(2, self.blocks)][:, None]
        for _ in range(2):  # the most promising blocks give a floor; of the others only those are opened that can reach it
            for b in np.nonzero(want.any(axis=0))[0].tolist():
                rows = np.nonzero(want[:, b])[0]
                scores[rows, b * BLOCK : (b + 1) * BLOCK] += asked[rows] @ self.dense[b]
            opened |= want
            # k others reach the floor, the text's own example aside
            floor = np.partition(scores, -k - 1, axis=1)[:, -k - 1] - 2 * SLACK if scores.shape[1] > k + 1 else np.zeros(len(queries))
            want = ~opened & (bound >= floor[:, None])
        out = []
        for i, (terms, weights, own) in enumerate(queries):
            places = np.nonzero((scores[i, :n] >= floor[i]) & (scores[i, :n] > 0))[0]
            exact = self._products(places, terms, weights)
            best = sorted((-s, x, p) for s, x, p in zip(exact.tolist(), self.ids[places].tolist(), places.tolist()) if s > 0 and x != own)[:k]
            out.append([(p, -s) for s, _, p in best])
        return out

    def shared_terms(self, place: int, terms: np.ndarray, weights: np.ndarray, limit: int = 8) -> list[int]:
        """The weightiest terms of a vector that the example at a place holds."""
        held = self.vector[self.first[place] : self.first[place + 1]]
        self.query[held] = 1.0
        common = self.query[terms] > 0
        self.query[held] = 0.0
        terms, weights = terms[common], weights[common]
        return terms[np.argsort(-weights, kind="stable")[:limit]].tolist()


def example_rows(taken: DataFrame) -> list[tuple]:
    """The sampled examples (doc_id, label, weight, text) as (doc_id, label, weight, terms, counts) on the driver; bounded by the sample."""

    def run(batches):
        for batch in batches:
            found = [text_terms(text.as_py()) for text in batch.column(3)]
            names = pa.array([" ".join(f) for f in found], pa.string())
            counts = pa.array([np.array(list(f.values()), "<u4").tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, counts], ["doc_id", "label", "weight", "terms", "counts"])

    found = taken.select("doc_id", "label", "weight", "text").mapInArrow(run, "doc_id long, label int, weight double, terms string, counts binary")
    return [(r.doc_id, r.label, r.weight, r.terms, bytes(r.counts)) for r in found.collect()]


def counted_rows(rows: DataFrame, shared, size: int) -> DataFrame:
    """(row, doc_id, data, slice): a packed vector per row, and once per task and slice of the vocabulary how many of its rows hold each term."""
    names = ["row", "doc_id", "data", "slice"]

    def batch_of(keys, ids, data, slices):
        return pa.RecordBatch.from_arrays([keys, ids, pa.array(data, pa.binary()), pa.array(slices, pa.int32())], names)

    def run(batches):
        vocabulary, counts = vocabulary_of(shared.value), np.zeros(size + 1, np.int64)
        for batch in batches:
            data = []
            for text in batch.column(2):
                found = vocabulary.counts(text.as_py())
                counts[found[0]] += 1
                data.append(pack_vector(*found))
            counts[size] += batch.num_rows
            yield batch_of(batch.column(0), batch.column(1), data, [None] * batch.num_rows)
        parts = [(i, counts[i * SLICE : (i + 1) * SLICE]) for i in range(size // SLICE + 1)]
        parts = [(i, zlib.compress(p.astype("<i8").tobytes(), 1)) for i, p in parts if p.any()]
        yield batch_of(pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), [p for _, p in parts], [i for i, _ in parts])

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, data binary, slice int")


def document_frequencies(counted: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(in how many rows each numbered term occurs, number of rows); packets of one slice are summed as they stream in."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(data), "<i8")
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slice", "counts"])

    out = np.zeros((size // SLICE + 1) * SLICE, np.int64)
    packets = counted.where("slice is not null").select("slice", "data").repartition("slice")
    for r in packets.mapInArrow(add, "slice int, counts binary").collect():  # one row per slice of the vocabulary
        part = np.frombuffer(bytes(r.counts), "<i8")
        out[r.slice * SLICE : r.slice * SLICE + len(part)] = part
    return out[:size], int(out[size])


def nearest_label_scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out_mod: int = 5,
    held_out_is: int = 0,
    sample_rows: int = 4000,
    sample_bytes: int = 64_000_000,
    k: int = 15,
    prior_votes: float = 0.2,
    row_col: str | None = None,
) -> DataFrame:
    """Per input row: doc_id, held_out, score (0 to 1), predicted, neighbours (ids), similarities, evidence.

    Labels are learnt only where crc32(doc_id) mod held_out_mod is not held_out_is, from at most
    sample_rows of them, half of each class at most, and at most sample_bytes of their texts (the
    documented bound; index and vocabulary are bounded by it). Every term of a text takes part.
    The k nearest examples vote with the weight of their class over their distance (1.05 - cosine),
    joined by prior_votes at the rate of label 1; a row's own example never votes. evidence names
    the weightiest terms (eight at most) that the text shares with the nearest example.
    Null and empty texts, and texts that share no term with any example, get the rate of label 1.
    Without labels of both classes every score is 0. Ties in similarity go to the smaller id; an
    example id with several texts counts with the smallest. Repeated rows each give a row; null ids
    are held out by the crc32 of the empty text like any id; other columns are ignored, but row_col
    may name one that tells rows apart and is returned as `row`; an empty table gives no rows.
    """
    held = (F.pmod(crc32_of_id("doc_id"), F.lit(held_out_mod)) == held_out_is).alias("held_out")
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    carried = ["row"] if row_col else []
    marked = labels.where(F.pmod(crc32_of_id(id_col), F.lit(held_out_mod)) != held_out_is)
    sample = cut(labelled_sample(marked, id_col, label_col, sample_rows))  # at most sample_rows short rows
    taken = cut(rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label", "weight").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")))
    sizes = taken.select("doc_id", "label", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most sample_rows
    fits, number = set(), {}
    for label in (0, 1):
        of_class = [r for r in sizes if r.label == label]
        kept, room = [], sample_bytes // 2
        for r in of_class:  # a text that does not fit is left out, those after it are not
            if r.n <= room:
                kept.append(r.doc_id)
                room -= r.n
        fits.update(kept)
        number[label] = len(of_class) / max(1, len(kept))
    whole = len(fits) == len(sizes)
    examples = Examples([(i, y, w * number[y], *rest) for i, y, w, *rest in example_rows(taken if whole else taken.where(F.col("doc_id").isin(list(fits))))])
    context = docs.sparkSession.sparkContext
    if len(set(examples.labels.tolist())) < 2:
        nothing = [F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast("array<long>").alias("neighbours"), F.array().cast("array<double>").alias("similarities"), F.lit("").alias("evidence")]
        return rows.select(*carried, "doc_id", held, *nothing)
    size = len(examples.names)
    words = context.broadcast(" ".join(examples.names))  # bounded by the sample's terms
    counted = cut(counted_rows(rows, words, size))
    frequency, total = document_frequencies(counted, size)
    factor, other = examples.factors(frequency, total)
    raw = (1 + np.log(examples.counts)) * factor[examples.terms]
    norm = np.sqrt(np.bincount(examples.owner, raw**2, len(examples.ids)))
    weights = raw / np.where(norm > 0, norm, 1)[examples.owner]
    prior = float((examples.labels * examples.weights).sum() / examples.weights.sum())
    index = BlockMaxIndex(examples.ids, examples.owner, examples.terms, weights, size)
    label_of, weight_of = examples.labels[index.order].astype(float), examples.weights[index.order]
    del examples, raw, weights
    shared = context.broadcast((factor, other, index, label_of, weight_of))  # bounded by the sample

    def score(batches):
        factor, other, index, label, weight = shared.value
        names = None
        for batch in batches:
            scores, near, similar, evidence = [], [], [], []
            for a in range(0, batch.num_rows, TOGETHER):
                queries = []
                for doc, data in zip(batch.column(1)[a : a + TOGETHER].to_pylist(), batch.column(2)[a : a + TOGETHER]):
                    terms, counts, others = unpack_vector(data.as_py())
                    ws = (1 + np.log(counts)) * factor[terms]
                    norm = math.sqrt(float((ws**2).sum()) + other**2 * float(((1 + np.log(others)) ** 2).sum()))
                    queries.append((terms, ws / norm if norm > 0 else ws, doc))
                for (terms, ws, _), best in zip(queries, index.nearest(queries, k)):
                    votes = [(weight[at] / (1.05 - s), label[at]) for at, s in best]
                    scores.append(min(1.0, (sum(v * y for v, y in votes) + prior_votes * prior) / (sum(v for v, _ in votes) + prior_votes)))
                    near.append([int(index.ids[at]) for at, _ in best])
                    similar.append([s for _, s in best])
                    names = names or words.value.split(" ")
                    evidence.append(" ".join(names[t] for t in index.shared_terms(best[0][0], terms, ws)) if best else "")
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(similar, pa.list_(pa.float64())), pa.array(evidence, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "score", "neighbours", "similarities", "evidence"])

    out = counted.where("slice is null").select("row", "doc_id", "data").mapInArrow(score, "row long, doc_id long, score double, neighbours array<long>, similarities array<double>, evidence string")
    return out.select(*carried, "doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "similarities", "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns.

    Each row is judged by its own text: rows with null ids go if their text is toxic, and a clean
    row stays though it shares its id with a toxic one. An empty table gives no rows.
    """
    rows, names = numbered(docs, id_col)
    judged = nearest_label_scores(rows.withColumnsRenamed({names[id_col]: "doc_id", names[text_col]: "text"}).select("row", "doc_id", "text"), labels, row_col="row", **options)
    return without_rows(rows, names, judged.where("predicted = 1"))
