"""Vector codes: product quantisation with a GNAT over each codebook's entries.

Each part of a vector is coded by its nearest codebook entry. The entries of a part form a
geometric near-neighbour access tree: a node has split points, every other entry belongs to its
nearest one, and each split point stores the range of its distances to every child. A query's
distances to the split points rule out all children of which one range lies farther from it than the
best distance; bounds are widened before they rule anything out, and exact whole-number distances decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written
from .vectors import Totals, as_longs, entries_sha256, exact_distances, gathered, matrices, moved, narrow, roots, squared, totals_batch, whole_vectors

SPLITS = 8  # split points of a node
LEAF = 8  # entries of a node without children
SLACK = 1e-9


class Gnat:
    """A geometric near-neighbour access tree over the rows of entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(list(range(len(entries))))

    def _build(self, members: list[int]) -> dict:
        if len(members) <= LEAF:
            return {"splits": members, "children": []}
        (points,) = narrow(self.entries[members])
        chosen = [0]
        away = roots(squared(points, points[0]))
        while len(chosen) < SPLITS:  # far from one another; equal entries are never two split points
            far = int(np.argmax(away))
            if away[far] == 0:
                break
            chosen.append(far)
            away = np.minimum(away, roots(squared(points, points[far])))
        reach = np.stack([roots(squared(points, points[c])) for c in chosen])
        owner = reach.argmin(axis=0)
        owner[chosen] = np.arange(len(chosen))
        near = np.stack([reach[:, owner == s].min(axis=1) for s in range(len(chosen))])
        far = np.stack([reach[:, owner == s].max(axis=1) for s in range(len(chosen))])
        children = []
        for s, c in enumerate(chosen):
            inner = [members[i] for i in np.flatnonzero(owner == s) if i != c]
            equal = len(chosen) == 1  # one after another, however many
            children.append({"splits": inner, "children": []} if equal else self._build(inner) if inner else None)
        return {"splits": [members[c] for c in chosen], "children": children, "near": near, "far": far}

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index, and how many distances were computed."""
        queries, entries = narrow(queries, self.entries)
        n = len(queries)
        best, least, radius = np.full(n, -1, np.int64), np.zeros(n, queries.dtype), np.full(n, np.inf)
        distances = exact_distances(queries, entries)
        computed, todo = 0, [(self.root, np.arange(n), np.zeros(n))]
        while todo:
            node, rows, bound = todo.pop()
            rows = rows[bound <= radius[rows] * (1 + SLACK) + SLACK]  # what has been found meanwhile may rule more out
            splits, inner = node["splits"], node["children"]
            if not len(rows) or not splits:
                continue
            found = distances(rows, splits)
            computed += found.size
            order = np.argsort(splits)  # among equal distances the lowest index comes first
            at = found[:, order].argmin(axis=1)
            number, nearest = np.asarray(splits)[order][at], found[np.arange(len(rows)), order[at]]
            better = ((best[rows] < 0) | (nearest < least[rows]) | ((nearest == least[rows]) & (number < best[rows]))).astype(bool)
            to = rows[better]
            best[to], least[to] = number[better], nearest[better]
            radius[to] = roots(least[to])
            if not any(inner):
                continue
            reach = roots(found)
            kept = []
            for c, child in enumerate(inner):
                if child:
                    near, far = node["near"][c], node["far"][c]
                    low = (np.maximum(near - reach, reach - far) - SLACK * (reach + far)).max(axis=1)
                    keep = low <= radius[rows] * (1 + SLACK) + SLACK  # strictly farther subtrees go
                    if keep.any():
                        kept.append((float(low.mean()), c, child, rows[keep], low[keep]))
            todo += [x[2:] for x in sorted(kept, key=lambda x: (-x[0], x[1]))]  # the one with the lowest bounds is opened first
        return best, least, computed


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row per kept vector: vec_id, code (two hex digits per part), error, label_error, codebooks_sha256.

    Kept are vectors without null or non-finite components, as whole numbers floor(scale * x), cut
    into equal consecutive parts; all must have the width of the kept vector with the smallest id
    whose width the parts divide, others take no part. A part's codebook starts as that
    part of the vectors with the smallest ids (null ids last, rows that share an id in order of their components'
    bytes), fewer entries if there are fewer vectors. Each round assigns every part to its nearest
    entry (ties: lower index) and moves used entries to the floor of their parts' mean; then parts are
    assigned again. label_error sums the errors of all rows with an equal label, nulls together.
    Repeated rows count like any other; a missing label column counts as null, other columns are
    ignored; an empty table gives no rows. Components beyond 2**62 and results beyond a long saturate.
    At most 256 entries fit two hex digits.

    A round sends at most entries * (width + parts) numbers a task, added up by key; the driver holds the codebooks.
    """
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    given = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("x"), label.alias("label"))
    rows = whole_vectors(given, "i", "x", scale, carry=("label",)).where((F.col("width") > 0) & (F.col("width") % parts == 0))
    by_id = [F.col("vec_id").asc_nulls_last(), "v"]
    lead = rows.orderBy(*by_id).select("width").first()
    width = lead.width if lead else parts
    rows = rows.where(F.col("width") == width)
    size = width // parts
    first = np.array([np.frombuffer(bytes(r.v), "<i8") for r in rows.orderBy(*by_id).limit(entries).collect()], object).reshape(-1, width)
    books = [first[:, p * size : (p + 1) * size] for p in range(parts)]

    def trees():
        return spark.sparkContext.broadcast([Gnat(b) for b in books])  # entries * width numbers

    for _ in range(rounds if len(first) else 0):
        shared = trees()

        def run(batches, shared=shared):
            held = Totals()
            for _, matrix in matrices(batches, 0, width):
                for p, tree in enumerate(shared.value):
                    own = matrix[:, p * size : (p + 1) * size]
                    held.add(totals_batch(p, tree.nearest(own)[0], own))
            yield held.batch()

        totals = gathered(rows.select("v"), run)
        books = [moved(b, p, totals) for p, b in enumerate(books)]
        shared.unpersist()
    shared = trees()

    def code(batches):
        for piece, matrix in matrices(batches, 2, width):
            errors, digits = np.zeros(len(matrix), object), np.zeros((len(matrix), parts), np.uint8)
            for p, tree in enumerate(shared.value):
                number, least, _ = tree.nearest(matrix[:, p * size : (p + 1) * size])
                digits[:, p] = number
                errors = errors + least
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([bytes(d).hex() for d in digits]), as_longs(np.asarray(errors, object))], ["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    out = written(rows.select("vec_id", "label", "v").mapInArrow(code, f"vec_id long, label {kind}, code string, error long"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = out.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), most).cast("long").alias("label_error"))
    digest = entries_sha256(x for b in books for x in b.ravel())
    joined = out.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
