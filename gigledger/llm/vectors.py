"""Whole-number vectors: quantised rows, exact squared distances, and sums per group over all tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written

MOST = 2**62  # components beyond this saturate
SAFE = 2**27  # up to here squared distances of 256 components fit a long
LONGEST = 2**63 - 1
ROWS = 4096  # vectors handled at once in a task


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, width: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A written table (vec_id long, width int, v binary, carried columns): floor(scale * x) of each vector as little-endian longs.

    Vectors that are null or hold a null or non-finite component are left out, and those of
    another width where one is given.
    """
    names = [f"c{i}" for i in range(len(carry))]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            given = np.asarray(lists.is_valid())
            sizes = np.where(given, np.asarray(lists.value_lengths().fill_null(0)), 0)
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # nulls are NaN
            finite = np.isfinite(flat)
            whole = np.where(finite, np.clip(np.where(finite, flat, 0), -MOST, MOST), 0).astype("<i8")
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~finite)])
            good = given & (bad[starts[1:]] == bad[starts[:-1]])
            if width is not None:
                good &= sizes == width
            at = np.flatnonzero(good)
            data = pa.array([whole[starts[i] : starts[i + 1]].tobytes() for i in at], pa.binary())
            taken = [batch.column(i).take(pa.array(at)) for i in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([taken[0], pa.array(sizes[at], pa.int32()), data, *taken[1:]], ["vec_id", "width", "v", *names])

    packed = rows.mapInArrow(run, ", ".join(["vec_id long, width int, v binary", *[f"{n} {kinds[n]}" for n in names]]))
    return written(packed.withColumnsRenamed(dict(zip(names, carry))))


def matrices(batches, column: int, width: int):
    """(batch, its vectors as a matrix of longs) in pieces of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            data = b"".join(x.as_py() for x in piece.column(column))
            yield piece, np.frombuffer(data, "<i8").reshape(piece.num_rows, width)


def narrow(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as longs where squared distances fit, else as Python's whole numbers, which never overflow."""
    if all(not a.size or (-SAFE <= a.min() and a.max() <= SAFE) for a in arrays) and max(a.shape[-1] for a in arrays) <= 256:
        return [np.asarray(a, np.int64) for a in arrays]
    return [np.asarray(a).astype(object) for a in arrays]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows; the arrays come from narrow()."""
    d = a - b
    return (d * d).sum(axis=-1)


def exact_distances(queries: np.ndarray, entries: np.ndarray):
    """A function (rows, numbers) -> exact squared distances of those queries (down) to those entries (across).

    Where every product and sum is a whole number below 2**53, float64 holds them all exactly and a
    matrix product gives them; else they are summed as whole numbers.
    """
    most = max([1, *(int(np.abs(a).max()) for a in (queries, entries) if a.size)])
    if queries.dtype != object and (2 * most) ** 2 * queries.shape[1] < 2**53:
        q, e = queries.astype(np.float64), entries.astype(np.float64)
        qq, ee = (q * q).sum(axis=1), (e * e).sum(axis=1)
        return lambda rows, numbers: (qq[rows, None] - 2 * (q[rows] @ e[numbers].T) + ee[numbers]).astype(np.int64)
    return lambda rows, numbers: np.stack([squared(queries[rows], entries[k]) for k in numbers], axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def as_longs(values) -> pa.Array:
    """Longs; what does not fit saturates."""
    return pa.array([min(int(x), LONGEST) for x in values], pa.int64()) if getattr(values, "dtype", None) == object else pa.array(np.asarray(values, np.int64))


_TOTALS = "part int, entry int, place int, n long, total decimal(38,0)"


def totals_batch(part: int, entries: np.ndarray, vectors: np.ndarray, weights: np.ndarray | None = None) -> list[tuple]:
    """(part, entry, place, n, total) of one chunk: componentwise sums per entry; place -1 holds the sum of the weights."""
    out = []
    if vectors.dtype != object and np.abs(vectors).max(initial=0) > SAFE:
        vectors = vectors.astype(object)
    order = np.argsort(entries, kind="stable")
    ranked = entries[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ranked)]):
        own = order[a:b]
        out += [(part, int(ranked[a]), i, b - a, int(s)) for i, s in enumerate(vectors[own].sum(axis=0))]
        if weights is not None:
            out.append((part, int(ranked[a]), -1, b - a, int(weights[own].sum())))
    return out


class Totals:
    """Sums per (part, entry, place) of one task, added up chunk by chunk."""

    def __init__(self):
        self.of: dict[tuple[int, int, int], list[int]] = {}

    def add(self, rows: list[tuple]) -> None:
        for part, entry, place, n, total in rows:
            held = self.of.setdefault((part, entry, place), [0, 0])
            held[0] += n
            held[1] += total

    def batch(self) -> pa.RecordBatch:
        from decimal import Decimal

        rows = [(*k, n, Decimal(t)) for k, (n, t) in self.of.items()]
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "entry", "place", "n", "total"])


def gathered(table: DataFrame, run) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(part, entry, place) -> (n, total) over all tasks. run maps batches to one Totals batch a task; what returns has one row per entry and place."""
    rows = table.mapInArrow(run, _TOTALS).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    return {(r.part, r.entry, r.place): (r.n, int(r.total)) for r in rows}


def moved(entries: np.ndarray, part: int, totals: dict) -> np.ndarray:
    """The entries after a round: the floor of the mean of each one's vectors; unused ones stay."""
    out = entries.copy()
    for (p, e, i), (n, total) in totals.items():
        if p == part and i >= 0:
            out[e, i] = total // n
    return out


def entries_sha256(values) -> str:
    """Lower-case hex digest of whole numbers in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in values).encode()).hexdigest()
