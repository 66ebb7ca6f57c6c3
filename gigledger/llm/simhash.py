"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints come from repeated word shingles hashed by XXH64. Distinct fingerprints are blocked
by combinations of bit pieces, so that any two within the radius meet in some block; inside a
block the bit planes lie vertically (one machine word holds one bit of 64 fingerprints), distances
of 64 pairs grow at once in carry-save counters, and a block of pairs is left as soon as all of
its distances exceed the radius.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, fewer_links
from .util import cut, encode_utf8, numbered, without_rows, written

BLOCK = 1024  # fingerprints compared at once; larger groups are split into blocks
BLOCK_HASHES = 2**23  # shingle hashes of a block
BITS_MOST = 2**30  # bits of a block's shingle sets, beyond which they are intersected one by one


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> tuple[int, int]:
    """(unsigned 64-bit SimHash, number of words) of one whole text."""
    words = encode_utf8(text).lower().split()
    n = len(words)
    if n == 0:
        return 0, 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed), n
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    ends = (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]), n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, n_words long) for every row; fp holds the bits as a signed long."""
    schema = "doc_id long, fp long, n_words long"

    def run(batches):
        for batch in batches:
            pairs = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            fp = np.array([p[0] for p in pairs], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "fp", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def near_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of fps (uint64, one or more words each) that differ in at most radius bits, bit-sliced."""
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little") if n else np.zeros((0, 64), np.uint8)
    padded = np.zeros((bits.shape[1], words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    sign = (-(bits.T.astype(np.int64))).view(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.arange(n) // 64
    q = np.repeat(np.arange(n), words - first)
    w = np.concatenate([np.arange(f, words) for f in range(words) for _ in range(int((first == f).sum()))]) if n else np.zeros(0, np.int64)
    count = [np.zeros(len(q), np.uint64) for _ in range(max(1, int(radius).bit_length()))]
    over = np.zeros(len(q), np.uint64)

    def exceeds():
        above, equal = over.copy(), np.full(len(q), full)
        for i in reversed(range(len(count))):
            if radius >> i & 1:
                equal &= count[i]
            else:
                above |= equal & count[i]
                equal &= ~count[i]
        return above

    for start in range(0, len(planes), 8):
        for b in range(start, start + 8):
            carry = planes[b][w] ^ sign[b][q]
            for i in range(len(count)):
                up = count[i] & carry
                count[i] ^= carry
                carry = up
            over |= carry
        keep = exceeds() != full
        if not keep.all():
            q, w, over, count = q[keep], w[keep], over[keep], [c[keep] for c in count]
        if not len(q):
            break
    hits = ~exceeds()
    some = hits != 0
    q, w, hits = q[some], w[some], hits[some]
    lane = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, col = np.nonzero(lane)
    i, j = q[row], w[row] * 64 + col
    good = (j > i) & (j < n)
    return i[good], j[good]


def _star(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each fingerprint to the smallest of its component within fps."""
    fps = np.unique(fps)
    i, j = near_pairs(fps, radius)
    label = np.arange(len(fps))
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


def fingerprint_links(fps: DataFrame, radius: int = 2, pieces: int | None = None) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose components are those of the relation "differ in at most radius bits".

    Fingerprints are cut into radius + 2 pieces; two within the radius agree in at least two, so
    each pair of pieces is one blocking key. A key shared by more than BLOCK fingerprints is split
    into sub-blocks whose pairs are compared in tasks of their own. Each block emits a star per
    component, never all pairs.
    """
    pieces = pieces or radius + 2
    bounds = [64 * k // pieces for k in range(pieces + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        mask = sum(((1 << (bounds[c + 1] - bounds[c])) - 1) << bounds[c] for c in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    shared = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("fp", "t"), parts)
    blocks = keyed.join(shared, ["t", "key"]).withColumns({"parts": parts, "own": own})
    blocks = blocks.select("fp", "t", "key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))).alias("b"))
    blocks = blocks.select("fp", "t", "key", "b.i", "b.j").repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches):
        held = np.zeros(0, np.uint64)
        last = None

        def out(part):
            a, b = _star(part, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1, 5)])
            if not len(fp):
                continue
            new = np.ones(len(fp), bool)
            new[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
            new[0] = last is None or (group[:, 0] != last).any()
            last = group[:, -1].copy()
            starts = np.nonzero(new)[0] + len(held)
            held = np.concatenate([held, fp])
            done = 0  # whole groups go together until a chunk has BLOCK fingerprints
            for s in starts.tolist():
                if s - done >= BLOCK:
                    yield out(held[done:s])
                    done = s
            held = held[done:]
        if len(held):
            yield out(held)

    return blocks.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_words.

    component_id is the smallest doc_id whose fingerprint can be reached by steps of at most
    radius bits, the row's own id included. Null and blank texts have the fingerprint zero, linked
    like any other; texts shorter than a shingle hash whole. Repeated rows each give a row; null
    ids never become a component_id unless the component has no other. An empty table gives no
    rows; other columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = components(fingerprint_links(reps, radius))
    low = cut(linked.join(reps, linked.node == reps.fp).groupBy("root").agg(F.min("low").alias("component_id")))
    linked = linked.join(low, "root").select(F.col("node").alias("fp"), "component_id")
    found = cut(reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_words")


def similar_sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, f1 long, f2 long): a 128-bit SimHash of each text's set of distinct word shingles."""

    def run(batches):
        for batch in batches:
            prints = np.array([_sketch(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(prints[:, i].view(np.int64)) for i in (0, 1)]], ["doc_id", "f1", "f2"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, f1 long, f2 long")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """(n, 2) uint64: 128-bit hashes of the distinct word shingles, sorted; a shorter text is one shingle, one without words none."""
    words = encode_utf8(text).lower().split()
    n = len(words)
    if not n:
        return np.zeros((0, 2), np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: max(1, n - shingle + 1)].tolist()
    ends = (ends - 1)[min(shingle, n) - 1 :].tolist()
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(sorted({digest(joined[a:b]) for a, b in zip(starts, ends)})), "<u8").reshape(-1, 2)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def star_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index links that join each fingerprint to the first of its component within fps, by steps within the radius."""
    i, j = near_pairs(fps, radius)
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def in_blocks(rows: DataFrame, keys: list[str], sizes: DataFrame, parts, salt: list[str]) -> DataFrame:
    """rows in blocks (keys, i, j): where `parts` of a key is one, all of its rows; else its rows are dealt to so many sub-blocks and every two sub-blocks meet, with `side` telling them apart."""
    own = F.pmod(F.xxhash64(*salt), F.col("parts"))
    placed = rows.join(sizes.withColumn("parts", parts.cast("long")), keys).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    return placed.withColumn("b", F.explode(pairs)).select(*rows.columns, "b.i", "b.j", (F.col("own") == F.col("b.j")).cast("int").alias("side"))


def candidate_links(reps: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, int]:
    """(links, radius): links (a, b) that join rows (low, f1, f2) whose fingerprints can be reached by steps within the radius.

    A bit of the fingerprints of two sets of the given similarity agrees with probability p; the
    radius is 2.5 standard deviations above the mean distance. Each band takes enough bits that
    about BLOCK fingerprints share a key, and there are enough bands for the stated chance that two
    sets at the threshold share one. All fingerprints of a key are compared bit-sliced, in
    sub-blocks where many share it; each block gives a star per component, never all pairs.
    """
    n = reps.count()
    p = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))) if bits else 1
    radius = math.ceil(128 * (1 - p) + 2.5 * math.sqrt(128 * p * (1 - p)))

    def key(t: int):
        chosen = np.random.default_rng(t).choice(128, bits, replace=False).tolist()
        masks = [sum(1 << (c % 64) for c in chosen if c // 64 == w) for w in (0, 1)]
        masks = [m - (m >> 63 << 64) for m in masks]
        return F.struct(F.lit(t).alias("t"), F.xxhash64(*[F.col(f).bitwiseAND(F.lit(m)) for f, m in zip(("f1", "f2"), masks)]).alias("key"))

    keyed = reps.select("low", "f1", "f2", F.explode(F.array(*[key(t) for t in range(bands)])).alias("k")).select("low", "f1", "f2", "k.t", "k.key")
    sizes = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    blocks = in_blocks(keyed, ["t", "key"], sizes, F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / BLOCK)), ["low", "t"]).drop("side")
    blocks = blocks.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "low")

    def run(batches):
        held, ids, last = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), None

        def out(a, b):
            i, j = star_links(held[a:b], radius)
            return pa.RecordBatch.from_arrays([pa.array(ids[a:b][i]), pa.array(ids[a:b][j])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            group = np.stack(columns[3:])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
            new[0] = last is None or (group[:, 0] != last).any()
            last = group[:, -1].copy()
            starts = np.nonzero(new)[0] + len(held)
            held, ids = np.concatenate([held, np.stack(columns[1:3], axis=1).view(np.uint64)]), np.concatenate([ids, columns[0]])
            done = 0  # whole groups go together until a chunk has BLOCK fingerprints
            for s in starts.tolist():
                if s - done >= BLOCK:
                    yield out(done, s)
                    done = s
            held, ids = held[done:], ids[done:]
        if len(held):
            yield out(0, len(held))

    return blocks.mapInArrow(run, "a long, b long"), radius


class Overlaps:
    """Sizes of the intersections of many sorted sets of 32-bit hashes."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.bits = sets, None
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        if len(sets) <= 8:
            return
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1  # what one set alone holds is in no intersection
        width = int(shared.sum())
        if not width or len(sets) * width > BITS_MOST:
            return
        place = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        good = shared[ids]
        matrix = np.zeros((len(sets), (width + 63) // 64 * 8), np.uint8)
        at, row = place[ids[good]], owner[good]
        np.bitwise_or.at(matrix.reshape(-1), row * matrix.shape[1] + at // 8, np.left_shift(1, at % 8).astype(np.uint8))
        self.bits = matrix.view("<u8")

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.fromiter((len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
        out, step = np.zeros(len(i), np.int64), max(1, 2**22 // self.bits.shape[1])
        for a in range(0, len(i), step):
            out[a : a + step] = np.bitwise_count(self.bits[i[a : a + step]] & self.bits[j[a : a + step]]).sum(axis=1, dtype=np.int64)
        return out


def verified_forest(fps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray | None, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (of different sides, where sides are given) within the radius whose sets reach the similarity.

    Every pair that could join two parts is verified, nearest fingerprints first; a pair within
    one part tells nothing new and is left out.
    """
    n = len(fps)
    if n <= 64:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = near_pairs(fps, radius)
    apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) if len(i) else np.zeros(0, np.int64)
    good = apart <= radius
    if sides is not None:
        good &= sides[i] != sides[j]
    i, j, apart = i[good], j[good], apart[good]
    order = np.argsort(apart, kind="stable")
    i, j = i[order], j[order]
    overlaps = Overlaps(sets) if len(i) else None
    label, links, size = np.arange(n), ([], []), 256
    while len(i):
        a, b = i[:size], j[:size]
        i, j, size = i[size:], j[size:], min(4 * size, 65536)
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        both = overlaps.of(a, b)
        true = both >= similarity * (overlaps.sizes[a] + overlaps.sizes[b] - both) - 1e-9
        joined = False
        for x, y in zip(a[true].tolist(), b[true].tolist()):
            if label[x] != label[y]:
                label[label == max(label[x], label[y])] = min(label[x], label[y])
                links[0].append(x)
                links[1].append(y)
                joined = True
        if joined and len(i):
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    return np.array(links[0], np.int64), np.array(links[1], np.int64)


def verified_links(docs: DataFrame, reps: DataFrame, candidates: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) between rows (low, f1, f2) whose texts' sets of distinct word shingles have at least the given Jaccard similarity; none is missing whose ends share a group (node, root) of `candidates` and lie within the radius.

    The texts' shingle sets travel once to their group; a group of many texts is compared in pairs of sub-blocks.
    Sets travel as 32-bit hashes; two of a text's shingles share one so rarely that the similarity of
    even 20,000 shingles is off by less than 0.0005.
    """
    nodes = reps.join(candidates, reps.low == candidates.node).select("low", "f1", "f2", "root")

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle)[:, 0].astype("<u4")) for t in batch.column(4)]
            columns = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["low", "f1", "f2", "root", "size", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(nodes, F.col("doc_id") == F.col("low")).select("low", "f1", "f2", "root", "text")
    held = written(texts.mapInArrow(sets, "low long, f1 long, f2 long, root long, size long, shingles binary"))
    sizes = held.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    parts = F.when((F.col("n") <= 2 * BLOCK) & (F.col("hashes") <= 2 * BLOCK_HASHES), 1).otherwise(F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("hashes") / BLOCK_HASHES)))
    blocks = in_blocks(held.select("low", "f1", "f2", "root", "shingles"), ["root"], sizes, parts, ["low"])
    blocks = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "low")

    def check(batches):
        last, ids, fps, hashes, sides = None, [], [], [], []

        def out():
            # within (i, i) all are of side 1 and all pairs count
            other = np.array(sides) if last[1] != last[2] else None
            i, j = verified_forest(np.array(fps, np.int64).view(np.uint64).reshape(-1, 2), hashes, other, radius, similarity)
            own = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j])], ["a", "b"])

        for batch in batches:
            low, f1, f2, root, i, j, side = (batch.column(c).to_pylist() for c in ("low", "f1", "f2", "root", "i", "j", "side"))
            shingles = batch.column("shingles")
            for k, block in enumerate(zip(root, i, j)):
                if block != last:
                    if len(ids) > 1:
                        yield out()
                    last, ids, fps, hashes, sides = block, [], [], [], []
                ids.append(low[k])
                fps.append((f1[k], f2[k]))
                hashes.append(np.frombuffer(shingles[k].as_py(), "<u4"))
                sides.append(side[k])
        if len(ids) > 1:
            yield out()

    return blocks.mapInArrow(check, "a long, b long")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.98) -> DataFrame:
    """The documents without near duplicates: of each group linked by sets of `shingle`-word shingles with a Jaccard similarity of at least `similarity`, one row stays.

    Candidates come from 128-bit SimHash fingerprints compared bit-sliced; within a group of
    candidates every pair that could join two parts is verified on the texts' shingle sets. Rows
    whose fingerprints are equal are of one group. Of a group the row with the smallest id stays
    (null ids last, then by the row's own number), so null and repeated ids are rows like any
    other. Null, empty and blank texts are one group, a text shorter than a shingle is one shingle;
    an empty table gives no rows; all columns stay as they are, whatever their names.
    """
    rows, names = numbered(docs, "doc_id")
    text = names[text_col]
    own_id = F.col(names["doc_id"]).cast("long") if "doc_id" in names else F.lit(None).cast("long")
    prints = cut(similar_sketches(rows, "row", text, shingle).withColumnRenamed("doc_id", "row"))
    reps = cut(prints.groupBy("f1", "f2").agg(F.min("row").alias("low")))
    links, radius = candidate_links(reps, similarity, recall)
    linked = components(verified_links(rows, reps, components(fewer_links(links)), "row", text, shingle, similarity, radius))
    group = reps.join(linked.withColumnRenamed("node", "low"), "low", "left").select("f1", "f2", F.coalesce("root", "low").alias("root"))
    placed = rows.select("row", own_id.alias("id")).join(prints.join(group, ["f1", "f2"]).select("row", "root"), "row")
    first = cut(placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select("m.row"))
    return without_rows(rows, names, prints.select("row").join(first, "row", "left_anti"))
