"""Centroid clustering with a vantage-point tree over the centroids.

Each round the driver builds a vantage-point tree over the few centroids and broadcasts it; tasks
assign their vectors by best-first branch and bound and send one sum per centroid and component.
Bounds come from floating-point roots and are widened, a bound that equals the best distance is
still visited, and what decides are exact whole-number distances, ties to the smaller number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Totals, as_longs, entries_sha256, gathered, matrices, moved, narrow, roots, squared, totals_batch, whole_vectors

LEAF = 2  # centroids of a leaf at most
SLACK = 1e-9


class VantageTree:
    """A vantage-point tree: every node has a vantage centroid; those nearer than the median distance form one child, the rest the other, each with its range of distances."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.leaves: dict[int, list[int]] = {}
        self.vantage: dict[int, int] = {}
        self.children: dict[int, list[tuple[int, float, float]]] = {}
        self.nodes = 0
        if len(centroids):
            self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        node, self.nodes = self.nodes, self.nodes + 1
        if len(members) <= LEAF:
            self.leaves[node] = members
            return node
        (points,) = narrow(self.centroids[members])
        spread = [float(np.var(roots(squared(points, p)))) for p in points]
        first = int(np.argmax(spread))
        rest = [m for i, m in enumerate(members) if i != first]
        reach = roots(squared(np.delete(points, first, axis=0), points[first]))
        order = np.argsort(reach, kind="stable")
        half = (len(rest) + 1) // 2
        self.vantage[node] = members[first]
        self.children[node] = []
        for side in (order[:half], order[half:]):
            if len(side):
                self.children[node].append((self._build([rest[i] for i in side]), float(reach[side].min()), float(reach[side].max())))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and how many distances were computed.

        Every row keeps its own frontier of nodes by lower bound and opens the lowest one first;
        rows that open the same node do so together.
        """
        vectors, centroids = narrow(vectors, self.centroids)
        n = len(vectors)
        best = np.full(n, -1, np.int64)
        least = np.zeros(n, vectors.dtype)
        radius = np.full(n, np.inf)
        bounds = np.full((n, self.nodes), np.inf)
        bounds[:, 0] = 0
        computed, active = 0, np.arange(n)

        def try_centroid(rows: np.ndarray, number: int) -> np.ndarray:
            nonlocal computed
            found = squared(vectors[rows], centroids[number])
            computed += len(rows)
            better = (best[rows] < 0) | (found < least[rows]) | ((found == least[rows]) & (number < best[rows]))
            to = rows[better.astype(bool)]
            best[to], least[to] = number, found[better.astype(bool)]
            radius[to] = roots(least[to])
            return roots(found)

        while len(active):
            node = bounds[active].argmin(axis=1)
            low = bounds[active, node]
            visit = np.isfinite(low) & (low <= radius[active] * (1 + SLACK) + SLACK)  # inclusive
            active, node = active[visit], node[visit]
            bounds[active, node] = np.inf
            for k in np.unique(node).tolist():
                rows = active[node == k]
                if k in self.leaves:
                    for number in self.leaves[k]:
                        try_centroid(rows, number)
                    continue
                reach = try_centroid(rows, self.vantage[k])
                for child, near, far in self.children[k]:
                    bounds[rows, child] = np.maximum(0, np.maximum(near - reach, reach - far) - SLACK * (reach + far))
        return best, least, computed


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, cluster_size.

    Kept are vectors of exactly `width` components, none null or non-finite, as whole numbers
    floor(scale * x). The first centroids are the k vectors with the smallest sha256 of
    `<seed>:<id>`; null ids come last and rows that share an id in order of their components' bytes. Each round every
    vector goes to its nearest centroid (ties: smaller number) and each used centroid becomes the
    floor of its vectors' mean; then vectors are assigned once more. Fewer vectors than k give as
    many centroids; an empty table gives no rows. Repeated rows and null ids count like any other,
    other columns are ignored. Components beyond 2**62 and results beyond a long saturate.

    A round sends k * (width + 1) numbers a task, added up by key; the driver holds the centroids.
    """
    sc = vectors.sparkSession.sparkContext
    rows = whole_vectors(vectors, id_col, vector_col, scale, width)
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([np.frombuffer(bytes(r.v), "<i8") for r in first], object).reshape(-1, width)

    def round_totals(tree):
        def run(batches):
            held = Totals()
            for _, matrix in matrices(batches, 0, width):
                number, distance, _ = tree.value.nearest(matrix)
                held.add(totals_batch(0, number, matrix, distance))
            yield held.batch()

        return gathered(rows.select("v"), run)

    for _ in range(rounds if len(centroids) else 0):
        tree = sc.broadcast(VantageTree(centroids))  # k centroids
        centroids = moved(centroids, 0, round_totals(tree))
        tree.unpersist()
    tree = sc.broadcast(VantageTree(centroids))
    sums = {e: (n, total) for (_, e, place), (n, total) in round_totals(tree).items() if place < 0} if len(centroids) else {}
    inertia = sum(total for _, total in sums.values())
    digests = [entries_sha256(c) for c in centroids]

    def run(batches):
        for piece, matrix in matrices(batches, 1, width):
            number, distance, _ = tree.value.nearest(matrix)
            of = [sums[e] for e in number.tolist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(number, pa.int32()), as_longs(distance), as_longs(np.array([t for _, t in of], object)), as_longs(np.full(len(of), inertia, object)), pa.array([digests[e] for e in number.tolist()]), pa.array([n for n, _ in of], pa.int64())],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size"],
            )

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
