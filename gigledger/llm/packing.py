"""Packing documents into sequences by a grouping genetic algorithm over islands.

What decides a packing is how many pieces there are of each length, and there are at most
`capacity` lengths however large the corpus is. So the islands evolve run-length-coded packings: a
genome maps a bin's content (lengths, longest first) to how many bins hold it. Documents meet their
places at the end by closed form: the k-th piece of a length takes the k-th slot of that length.
"""

from __future__ import annotations

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_vocabulary, ids_of_texts
from .util import cut

Genome = dict[tuple[int, ...], int]


def best_fit(bins: Genome, items: dict[int, int], capacity: int, rank=None) -> Genome:
    """Put items (length -> count) into the bins or new ones, longest first, each where least room is left.

    rank may reorder the lengths; equal lengths go together, as many bins of one content at a time
    as there are.
    """
    rooms: dict[int, Genome] = defaultdict(dict)
    open_rooms = 0  # bit r: some bin has room r
    for content, n in bins.items():
        room = capacity - sum(content)
        rooms[room][content] = n
        open_rooms |= 1 << room
    for size in sorted(items, key=rank or (lambda s: -s)):
        left = items[size]
        while left:
            fits = open_rooms >> size
            if not fits:
                each = capacity // size
                for k, n in ((each, left // each), (left % each, 1)):
                    if k and n:
                        rooms[capacity - k * size][(size,) * k] = rooms[capacity - k * size].get((size,) * k, 0) + n
                        open_rooms |= 1 << (capacity - k * size)
                left = 0
                break
            room = size + (fits & -fits).bit_length() - 1
            content, n = rooms[room].popitem()
            used = min(n, left)
            if used < n:
                rooms[room][content] = n - used
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            grown = tuple(sorted((*content, size), reverse=True))
            rooms[room - size][grown] = rooms[room - size].get(grown, 0) + used
            open_rooms |= 1 << (room - size)
            left -= used
    return {content: n for held in rooms.values() for content, n in held.items()}


def crossover(one: Genome, other: Genome, items: dict[int, int], capacity: int, rng: random.Random) -> Genome:
    """Inject whole well-filled bins of the other parent, drop bins of this one that repeat their items, best-fit what that displaces."""
    full = sorted(other, key=lambda c: (-sum(c), c))
    full = full[: max(1, int(len(full) * rng.uniform(0.3, 0.9)))]
    chosen = {c: other[c] for c in full if rng.random() < 0.7}
    left = Counter(items)
    for content, n in chosen.items():
        for size in content:
            left[size] -= n
    child = dict(chosen)
    for content in sorted(one, key=lambda c: (-sum(c), rng.random())):
        need = Counter(content)
        n = min(one[content], min(left[s] // k for s, k in need.items()))
        if n > 0:
            child[content] = child.get(content, 0) + n
            for s, k in need.items():
                left[s] -= n * k
    return best_fit(child, {s: n for s, n in left.items() if n}, capacity)


def fullest(left: Counter, room: int, limit: int = 400) -> list[int]:
    """Lengths at hand that fill the room best, larger ones tried first; the search stops at a perfect fill or after `limit` steps."""
    sizes = sorted((s for s in left if s <= room), reverse=True)
    best, found, chosen, steps = room, [], [], 0
    at, used = [0], Counter()
    while at and steps < limit and best:
        i = at[-1]
        while i < len(sizes) and (sizes[i] > room or used[sizes[i]] >= left[sizes[i]]):
            i += 1
        if i < len(sizes):  # take it and go on from here
            steps += 1
            at[-1] = i + 1
            at.append(i)
            chosen.append(sizes[i])
            used[sizes[i]] += 1
            room -= sizes[i]
            if room < best:
                best, found = room, list(chosen)
        else:
            at.pop()
            if chosen:
                size = chosen.pop()
                used[size] -= 1
                room += size
    return found


def refill(left: Counter, capacity: int) -> Genome:
    """Bins for displaced items, the largest first, each filled as full as can be found."""
    bins: Genome = {}
    left = +left
    while left:
        size = max(left)
        content = [size]
        left[size] -= 1
        for s in fullest(left := +left, capacity - size):
            left[s] -= 1
            content.append(s)
        left = +left
        key = tuple(sorted(content, reverse=True))
        bins[key] = bins.get(key, 0) + 1
    return bins


def mutate(genome: Genome, capacity: int, rng: random.Random, moves: int = 120) -> Genome:
    """Again and again empty some badly filled bins and a few others, refill from what they held, and keep what is not worse."""
    genome = dict(genome)
    for _ in range(moves):
        part = [c for c in genome if sum(c) < capacity]
        full = [c for c in genome if sum(c) == capacity and len(c) > 1]
        worst = sorted(part, key=lambda c: (sum(c) + rng.random() * capacity / 16, c))[: rng.randint(2, 12)]
        out = {*worst, *rng.sample(part, min(len(part), rng.randint(2, 10))), *rng.sample(full, min(len(full), rng.randint(0, 6)))}
        displaced: Counter = Counter()
        for content in out:
            displaced.update(content)
        new = refill(displaced, capacity)
        if fitness(new, capacity) > fitness(dict.fromkeys(out, 1), capacity):
            continue
        for content in out:
            genome[content] -= 1
            if not genome[content]:
                del genome[content]
        for content, n in new.items():
            genome[content] = genome.get(content, 0) + n
    return genome


def fitness(genome: Genome, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly (more of them full): smaller is better."""
    return sum(genome.values()), -sum(n * (sum(c) / capacity) ** 2 for c, n in genome.items())


def first_genomes(items: dict[int, int], capacity: int, size: int, rng: random.Random) -> list[Genome]:
    """Best-fit decreasing, then packings that first close bins with exact pairs."""
    out = [best_fit({}, items, capacity)]
    while len(out) < size:
        left, paired = Counter(items), {}
        for s in sorted(items, key=lambda _: rng.random()):
            t = capacity - s
            n = min(left[s], left[t]) if t != s else left[s] // 2
            if t > 0 and n and rng.random() < 0.9:
                paired[tuple(sorted((s, t), reverse=True))] = n
                left[s] -= n
                left[t] -= n
        shake = {s: s * rng.uniform(0.9, 1.1) for s in items}
        out.append(best_fit(paired, {s: n for s, n in left.items() if n}, capacity, rank=lambda s: -shake[s]))
    return out


def evolve(population: list[Genome], items: dict[int, int], capacity: int, generations: int, rng: random.Random) -> list[Genome]:
    """A few generations on one island; the best genome always survives."""
    least = math.ceil(sum(s * n for s, n in items.items()) / capacity)
    score = lambda g: fitness(g, capacity)
    population = sorted(population, key=score)
    size = len(population)
    for _ in range(generations):
        if score(population[0])[0] <= least:
            break
        children = []
        for _ in range(size):
            one, other = (min(rng.sample(population, min(2, size)), key=score) for _ in range(2))
            child = crossover(one, other, items, capacity, rng)
            children.append(mutate(child, capacity, rng))
            if score(children[-1])[0] <= least:
                break
        population = sorted([*population, *children], key=score)[:size]
    return population


def _write(genomes: list[Genome]) -> str:
    return json.dumps([[[list(c), n] for c, n in sorted(g.items())] for g in genomes])


def _read(text: str) -> list[Genome]:
    return [{tuple(c): n for c, n in g} for g in json.loads(text)]


def pack_lengths(spark, items: dict[int, int], capacity: int, islands: int = 4, population: int = 4, epochs: int = 3, generations: int = 3) -> tuple[Genome, list[int]]:
    """(best packing, bins of the first and of the best genome after each epoch on its island).

    Islands evolve in one task each; after every epoch an island's best genome moves to the next
    island. An island that has reached the lower bound rests.
    """
    import pandas as pd

    def epoch(number):
        def run(key, pdf):
            rng = random.Random(1000 * number + int(key[0]))
            genomes = [g for text in pdf["genomes"] for g in _read(text)] or first_genomes(items, capacity, population, rng)
            score = lambda g: fitness(g, capacity)
            past = max(pdf["history"], key=len)
            past = json.loads(past) or [score(genomes[0])[0]]
            genomes = evolve(sorted(genomes, key=score)[:population], items, capacity, generations, rng)
            past = json.dumps([*past, score(genomes[0])[0]])
            after = (int(key[0]) + 1) % islands
            return pd.DataFrame({"island": [int(key[0]), after], "genomes": [_write(genomes), _write(genomes[:1])], "history": [past, "[]"]})

        return run

    state = spark.range(islands, numPartitions=islands).select(F.col("id").alias("island"), F.lit("[]").alias("genomes"), F.lit("[]").alias("history"))
    for number in range(epochs):
        state = state.groupBy("island").applyInPandas(epoch(number), "island long, genomes string, history string")
    rows = state.where("history <> '[]'").select("genomes", "history").collect()  # islands x population genomes over at most `capacity` lengths
    found = [(g, json.loads(r.history)) for r in rows for g in _read(r.genomes)]
    return min(found, key=lambda f: (fitness(f[0], capacity), sorted(f[0])))


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; task and nth number the pieces of one length within a task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def run(batches):
        task = TaskContext.get().partitionId()
        seen: Counter = Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of_texts(batch.column(1), vocabulary)):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                at = 0
                for piece in range(1 + (total - first) // capacity):
                    length = first if not piece else capacity
                    rows.append((doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), task, seen[length]))
                    seen[length] += 1
                    at += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")
            for a in range(0, len(rows), 20000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 20000]), kinds)], list(names))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def slots(genome: Genome) -> dict[str, np.ndarray]:
    """For each length and content that holds it: the first rank that lands there, and where."""
    base, rows, used = 0, [], Counter()
    for content in sorted(genome, reverse=True):
        n, at = genome[content], 0
        for size in content:
            rows.append((size, used[size], base, at))
            used[size] += n
            at += size
        base += n
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, **search) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its byte-level BPE ids, special tokens written in its text included, followed by
    end_id (null and empty texts: end_id alone).
    One longer than capacity is cut into pieces of capacity ids, the first taking the remainder.
    Pieces of equal length are interchangeable, repeated rows and null ids are documents of their
    own, an empty table gives no rows, other columns are ignored. sequence_id has no gaps.
    """
    pieces = cut(token_pieces(docs, id_col, text_col, capacity, end_id, vocabulary or default_vocabulary()))
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    items = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    place = slots(pack_lengths(docs.sparkSession, items, capacity, **search)[0] if items else {})
    before = counts.selectExpr("task", "length", "sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding) as earlier")
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("nth") + F.coalesce("earlier", F.lit(0)))

    def run(batches):
        key = (place["length"] << 44) + place["first"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(place["sequence"][at] + rank - place["first"][at]), pa.array(place["offset"][at])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
