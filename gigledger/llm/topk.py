"""Exact top-k inner-product search over norm buckets.

Quantised vectors are range-dealt by length, longest first, and cut into buckets of similar
length. A first pass scores every query against its longest bucket for a lower bound of its k-th
score; a bucket whose longest vector cannot reach that bound is not visited. In a visited bucket the bound becomes a
local cosine threshold per query: a high one leaves few vectors by coordinate ranges, a lower one
cuts the bucket at a length; what is left is verified with exact integer products. Queries meet
buckets in packed blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import cut

BUCKET = 4096  # vectors of one bucket at most
QUERIES = 512  # queries of one block at most
NARROW = 0.8  # a bucket ends where lengths fall below this share of its longest, once it has LEAST vectors
LEAST = 256
COORDINATE_FROM = 0.7  # local cosine threshold from which coordinates prune better than length
FOCUS = 4  # coordinates that are looked at
EXACT = 2.0**52


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v array<long>): floor(scale * x) of vectors without null or non-finite components; row numbers them."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(good).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


_BLOCK = "block string, part int, n int, width int, longest double, shortest double, ids binary, rows binary, vectors binary"


def _pack(rows, limit: int, narrow: float, least: int):
    """Packed blocks of rows (id, row, vector, length) that come longest first."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[int, int, list[int], float]] = []

    def block():
        nonlocal number
        number += 1
        width = max((len(v) for _, _, v, _ in held), default=0)
        matrix = np.zeros((len(held), width), "<i8")
        for i, (_, _, v, _) in enumerate(held):
            matrix[i, : len(v)] = v
        small = not matrix.size or np.abs(matrix.astype(np.float64)).max() < 2**31
        data = matrix.astype("<i4" if small else "<i8").tobytes()
        return (f"{part}-{number}", part, len(held), width, held[0][3], held[-1][3], np.array([h[0] for h in held], "<i8").tobytes(), np.array([h[1] for h in held], "<i8").tobytes(), data)

    for i, row, v, length in rows:
        if held and (len(held) >= limit or len(held) >= least and length < narrow * held[0][3]):
            yield block()
            held = []
        held.append((i, row, v, length))
    if held:
        yield block()


def _blocks(vectors: DataFrame, limit: int, narrow: float, least: int) -> DataFrame:
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "v", "length")))

        for b in _pack(rows(), limit, narrow, least):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(b, kinds)], names)

    return vectors.mapInArrow(run, _BLOCK)


def _matrix(n: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * width else "<i8").reshape(n, width)


class Bucket:
    """One bucket of vectors, longest first, ready to be searched."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.raw = ids, rows, vectors
        self.values = vectors.astype(np.float64)
        self.lengths = np.sqrt((self.values**2).sum(axis=1))
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.units = self.values / np.where(self.lengths > 0, self.lengths, 1)[:, None]

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted list of one coordinate of the unit vectors, and the order that sorts it."""
        if f not in self._sorted:
            order = np.argsort(self.units[:, f], kind="stable")
            self._sorted[f] = (self.units[order, f], order)
        return self._sorted[f]

    def products(self, chosen, queries: np.ndarray, exact: bool) -> np.ndarray:
        """Integer products of queries (rows) with chosen vectors; float64 holds them exactly where bounds allow."""
        width = min(queries.shape[1], self.raw.shape[1])
        if exact:
            return (queries[:, :width].astype(np.float64) @ self.values[chosen][:, :width].T).astype(np.int64)
        return queries[:, :width].astype(np.int64) @ self.raw[chosen][:, :width].astype(np.int64).T

    def by_coordinates(self, query: np.ndarray, cosine: float) -> np.ndarray:
        """Indices that may have at least this cosine with the unit query: its largest coordinates bound theirs."""
        slack = np.sqrt(max(0.0, 1 - cosine * cosine))
        found = None
        for f in np.argsort(-np.abs(query[: self.units.shape[1]]), kind="stable")[:FOCUS].tolist():
            middle, reach = query[f] * cosine, slack * np.sqrt(max(0.0, 1 - query[f] ** 2))
            low = -1.0 if query[f] <= -cosine else middle - reach
            high = 1.0 if query[f] >= cosine else middle + reach
            if found is None:
                values, order = self.coordinate(f)
                found = order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, side="right")]
            else:
                column = self.units[found, f]
                found = found[(column >= low - 1e-9) & (column <= high + 1e-9)]
        return np.arange(len(self.ids)) if found is None else found


def search(bucket: Bucket, query_rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(place of the query, vector id, its row, score) of each query's k best in the bucket that are not below its bound, its own row aside."""
    values = queries.astype(np.float64)
    lengths = np.sqrt((values**2).sum(axis=1))
    longest = float(bucket.lengths[0]) if len(bucket.ids) else 0.0
    exact = bool(len(lengths)) and lengths.max() * longest < EXACT
    out: list[tuple[int, int, int, int]] = []

    def keep(q: int, at: np.ndarray, scores: np.ndarray):
        good = (scores >= bounds[q]) & (bucket.rows[at] != query_rows[q])
        at, scores = at[good], scores[good]
        if len(at) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = scores >= edge
            at, scores = at[above], scores[above]
            order = np.lexsort((bucket.rows[at], bucket.ids[at], -scores))[:k]
            at, scores = at[order], scores[order]
        out.extend(zip([q] * len(at), bucket.ids[at].tolist(), bucket.rows[at].tolist(), scores.tolist()))

    by_length: list[tuple[int, int]] = []
    for q in range(len(query_rows)):
        reach = lengths[q] * longest
        if not np.isfinite(bounds[q]) or bounds[q] <= 0 or reach == 0:  # no pruning by a bound that any vector may reach
            if bounds[q] <= 0:
                by_length.append((q, len(bucket.ids)))
            continue
        cosine = bounds[q] / reach * (1 - 1e-12)
        if cosine > 1 + 1e-9:
            continue
        if cosine >= COORDINATE_FROM:
            at = bucket.by_coordinates(values[q] / lengths[q], min(1.0, cosine))
            if len(at):
                keep(q, at, bucket.products(at, queries[q : q + 1], exact)[0])
        else:
            shortest = bounds[q] / lengths[q] * (1 - 1e-9)
            by_length.append((q, int(np.searchsorted(-bucket.lengths, -shortest, side="right"))))
    by_length.sort(key=lambda x: x[1])
    for a in range(0, len(by_length), 64):
        part = by_length[a : a + 64]
        n = part[-1][1]
        if n:
            scores = bucket.products(slice(0, n), queries[[q for q, _ in part]], exact)
            for (q, m), row in zip(part, scores):
                keep(q, np.arange(m), row[:m])
    return out


_FOUND = "query_id long, query_row long, vec_id long, row long, score long"


def _found(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_row", "vec_id", "row", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, query_every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of every row whose id is divisible by query_every with all other rows.

    Ties go to the smaller vec_id; with fewer rows all are returned. Null ids, null vectors and
    vectors with a null or non-finite component take no part; vectors shorter than others count as
    padded with zeros (an empty one scores 0). Rows that share an id are
    rows of their own: a query's candidates are all rows but itself, each query row has a result. Components beyond the range of long saturate, and products of components beyond 2**31
    wrap as long arithmetic does. Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(quantised(vectors, id_col, vector_col, scale))  # rows keep their numbers
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    rows = rows.withColumn("length", length)
    order = [F.col("length").desc(), F.col("vec_id"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    buckets = cut(_blocks(dealt, BUCKET, NARROW, LEAST))
    asked = rows.where(F.col("vec_id") % query_every == 0)
    queries = cut(_blocks(asked.repartitionByRange(*order).sortWithinPartitions(*order), QUERIES, 0.0, QUERIES))
    # one row per range partition, of which there are as many as shuffle partitions
    parts = sorted((-r.longest, r.part) for r in buckets.groupBy("part").agg(F.max("longest").alias("longest")).collect())
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank_of = {part: i for i, (_, part) in enumerate(parts)}
    reach = [-longest for longest, _ in parts]
    ranked = buckets.withColumn("part", F.element_at(F.create_map(*[F.lit(x) for kv in rank_of.items() for x in kv]), F.col("part")))

    # the bound: each query against the longest bucket, one block of at most BUCKET vectors
    top = buckets.where(F.col("part") == parts[0][1]).orderBy(F.col("longest").desc(), "block").first()
    shared = vectors.sparkSession.sparkContext.broadcast((bytes(top.ids), bytes(top.rows), top.n, top.width, bytes(top.vectors)))

    def bound(batches):
        top_ids, top_rows, n, width, data = shared.value
        bucket = Bucket(np.frombuffer(top_ids, "<i8"), np.frombuffer(top_rows, "<i8"), _matrix(n, width, data))
        for batch in batches:
            for r in batch.to_pylist():
                own, matrix = np.frombuffer(r["rows"], "<i8"), _matrix(r["n"], r["width"], r["vectors"])
                found = search(bucket, own, matrix, np.full(len(own), -np.inf), k)
                scores: dict[int, list[int]] = {}
                for q, _, _, s in found:
                    scores.setdefault(q, []).append(s)
                bounds = np.array([min(s) if len(s := scores.get(q, [])) == k else -np.inf for q in range(len(own))])
                lengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
                need = np.where((bounds > 0) & (lengths > 0), bounds / np.where(lengths > 0, lengths, 1), 0.0)
                least = float(need.min()) * (1 - 1e-9) if len(need) else 0.0
                last = max([0] + [i for i, x in enumerate(reach) if x >= least])
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([bounds.astype("<f8").tobytes()], pa.binary()), pa.array([last], pa.int32())], ["block", "bounds", "last"])

    named = [F.col(c).alias(f"b_{c}") for c in ("n", "width", "ids", "rows", "vectors")]
    bounds = cut(queries.select("block", "n", "width", "rows", "vectors").mapInArrow(bound, "block string, bounds binary, last int"))

    def verify(batches):
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.frombuffer(r["ids"], "<i8")
                if held is None or held[0] != r["b_block"]:
                    held = (r["b_block"], Bucket(np.frombuffer(r["b_ids"], "<i8"), np.frombuffer(r["b_rows"], "<i8"), _matrix(r["b_n"], r["b_width"], r["b_vectors"])))
                own = np.frombuffer(r["rows"], "<i8")
                found = search(held[1], own, _matrix(r["n"], r["width"], r["vectors"]), np.frombuffer(r["bounds"], "<f8"), k)
                if found:
                    yield _found([(int(ids[q]), int(own[q]), i, row, s) for q, i, row, s in found])

    pairs = queries.drop("part", "longest", "shortest").join(bounds, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pairs = pairs.join(ranked.select("part", F.col("block").alias("b_block"), *named), "part")
    found = pairs.select("n", "width", "ids", "rows", "vectors", "bounds", "b_block", "b_n", "b_width", "b_ids", "b_rows", "b_vectors").mapInArrow(verify, _FOUND)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
