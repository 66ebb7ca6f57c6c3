"""Exact substring dedup over word windows behind a count-min prefilter.

Documents are dealt into units by a hash, and the same dealt rows are read three times:

1. every unit counts its windows in a sparse count-min sketch (a few rows of saturating counters);
   the units' sketches are merged cell by cell in shards, and each unit gets one bit per cell it
   used: is the merged counter above one;
2. windows whose merged estimate is above one in every sketch row - all repeated ones, as a
   count-min estimate is never too small - are grouped exactly by a 128-bit digest of their words,
   again in shards, and each unit gets one bit per digest;
3. words covered by a repeated window are removed.

No sketch, digest set or text goes to the driver or is broadcast. A window shared by a third of
the corpus reaches its shard once per unit, since units send each cell and digest only once.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import encode_utf8, segment_starts

UNIT_BYTES = 4_000_000  # text of one unit, unless packets would then get too small
MOST_BYTES = 64_000_000  # text of one unit at any size of the input
SHARD_WINDOWS = 600_000
PACKET = 256  # entries a packet from a unit to a shard should hold on average
WIDTH_BITS = 24  # counters of one shard in one sketch row
DEPTH = 2
_BASE = 0x9E3779B97F4A7C15
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash mod 2**64 of each run of `window` word hashes, built by doubling."""
    total, width, power = None, 0, 1
    block, size, base = words, 1, _BASE
    rest = window
    while True:
        if rest & 1:
            if total is None:
                total, width, power = block, size, base
            else:  # what is gathered so far, followed by this block
                n = max(0, len(block) - width)
                total = total[:n] * np.uint64(base) + block[width : width + n]
                width += size
        rest >>= 1
        if not rest:
            return total
        n = max(0, len(block) - size)
        block = block[:n] * np.uint64(base) + block[size : size + n]
        size, base = size * 2, base * base % 2**64


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    x = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Unit:
    """One unit's rows in an order that does not depend on how they arrived."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.window = window
        self.joined, self.lengths, counts, hashes = [], [], [], []
        for i in self.order:
            words = encode_utf8(texts[i]).split()
            n = len(words)
            counts.append(n)
            self.joined.append(b" ".join(words))
            self.lengths.append(np.fromiter(map(len, words), np.int32, n))
            if n >= window:
                hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n))
        self.counts = np.array(counts, np.int64)
        self.held = np.nonzero(self.counts >= window)[0]  # documents with a window
        words_of = self.counts[self.held]
        self.windows = words_of - window + 1
        if len(self.held):
            rolled = window_hashes(np.concatenate(hashes), window)
            first = segment_starts(words_of)
            at = np.repeat(first - segment_starts(self.windows), self.windows) + np.arange(self.windows.sum())
            self.hash = rolled[at]
        else:
            self.hash = np.zeros(0, np.uint64)

    def cells(self, row: int, shards: int) -> np.ndarray:
        x = _mix(self.hash, _SEEDS[row])
        return (((x >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32) << np.uint64(WIDTH_BITS)) | (x & np.uint64((1 << WIDTH_BITS) - 1))

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """(n, 2) uint64: a 128-bit digest of the words of each chosen window."""
        out, starts = [], segment_starts(self.windows)
        for k, doc in enumerate(self.held.tolist()):
            a, b = np.searchsorted(chosen, (starts[k], starts[k] + self.windows[k]))
            if a == b:
                continue
            ends = np.cumsum(self.lengths[doc].astype(np.int64) + 1)
            at = chosen[a:b] - starts[k]
            begin = np.where(at > 0, ends[at - 1], 0).tolist()
            text = self.joined[doc]
            out += [xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(begin, (ends[at + self.window - 1] - 1).tolist())]
        return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little").astype(bool)


_PACKET = T.StructType([T.StructField("shard", T.LongType()), T.StructField("unit", T.LongType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("twice", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("unit", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() for f in schema]
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table({f.name: pa.array(c, k) for f, c, k in zip(schema, columns, kinds)})


def _sketch(unit: int, table: pa.Table, window: int, shards: int, depth: int) -> pa.Table:
    held, rows = _Unit(table, window), []
    for row in range(depth):
        cells, counts = np.unique(held.cells(row, shards), return_counts=True)
        shard = (cells >> np.uint64(WIDTH_BITS)).astype(np.int64)
        used, at = np.unique(shard, return_index=True)
        for s, a, b in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(cells)]):
            steps = np.diff(cells[a:b] & np.uint64((1 << WIDTH_BITS) - 1), prepend=np.uint64(0))
            wide = bool((steps > 65535).any())
            data = bytes([wide]) + zlib.compress(steps.astype("<u4" if wide else "<u2").tobytes(), 1)
            rows.append((row * shards + s, unit, b - a, data, _bits(counts[a:b] > 1)))
    return _arrow(rows, _PACKET)


def _repeated(order: np.ndarray, new: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """For sorted entries (order, starts of equal runs): does a run count more than one."""
    starts = np.nonzero(new)[0]
    sums = np.add.reduceat(1 + twice[order].astype(np.int64), starts) > 1
    out = np.empty(len(order), bool)
    out[order] = np.repeat(sums, np.diff(starts, append=len(order)))
    return out


def _answers(shard: int, table: pa.Table, exact: bool) -> pa.Table:
    """Merge the packets of one shard and tell every unit which of its entries count above one."""
    units, n = table.column("unit").to_pylist(), table.column("n").to_pylist()
    twice = np.concatenate([_flags(d, k) for d, k in zip(table.column("twice").to_pylist(), n)])
    if exact:
        keys = np.frombuffer(b"".join(table.column("data").to_pylist()), "<u8").reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        sorted_ = keys[order]
        new = np.append(True, (sorted_[1:] != sorted_[:-1]).any(axis=1))
    else:
        keys = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(d[1:]), "<u4" if d[0] else "<u2"), dtype=np.uint32) for d in table.column("data").to_pylist()])
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
    flags, at = _repeated(order, new, twice), np.cumsum([0, *n])
    return _arrow([(u, int(exact), shard, k, _bits(flags[a : a + k])) for u, k, a in zip(units, n, at.tolist())], _ANSWER)


def _entry_flags(shard_of: np.ndarray, answers: dict[int, bytes], offset: int) -> np.ndarray:
    """The answered bits of a unit's sorted distinct entries, shard by shard."""
    used, counts = np.unique(shard_of, return_counts=True)
    return np.concatenate([_flags(answers[offset + s], k) for s, k in zip(used.tolist(), counts.tolist())]) if len(used) else np.zeros(0, bool)


def _split(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: b for k, s, b in zip(answers.column("kind").to_pylist(), answers.column("shard").to_pylist(), answers.column("bits").to_pylist()) if k == kind}


def _candidates(held: _Unit, answers: pa.Table, shards: int, depth: int) -> np.ndarray:
    """Indices of windows whose estimate is above one in every sketch row."""
    told, flag = _split(answers, 0), np.ones(len(held.hash), bool)
    for row in range(depth):
        cells, back = np.unique(held.cells(row, shards), return_inverse=True)
        flag &= _entry_flags((cells >> np.uint64(WIDTH_BITS)).astype(np.int64), told, row * shards)[back]
    return np.nonzero(flag)[0]


def _distinct(keys: np.ndarray, shards: int):
    """Distinct digests sorted by shard: (digests, shard of each, counts, index of each input)."""
    shard = (((keys[:, 0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((keys[:, 1], keys[:, 0], shard))
    sorted_ = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    starts = np.nonzero(new)[0]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return sorted_[starts], shard[order][starts], np.diff(starts, append=len(order)), back


def _exact(unit: int, table: pa.Table, answers: pa.Table, window: int, shards: int, depth: int) -> pa.Table:
    held = _Unit(table, window)
    keys, shard, counts, _ = _distinct(held.digests(_candidates(held, answers, shards, depth)), shards)
    used, at = np.unique(shard, return_index=True)
    ends = [*at[1:].tolist(), len(keys)]
    return _arrow([(s, unit, b - a, keys[a:b].tobytes(), _bits(counts[a:b] > 1)) for s, a, b in zip(used.tolist(), at.tolist(), ends)], _PACKET)


def _removed(table: pa.Table, answers: pa.Table, window: int, shards: int, depth: int, with_text: bool) -> pa.Table:
    held = _Unit(table, window)
    chosen = _candidates(held, answers, shards, depth)
    _, shard, _, back = _distinct(held.digests(chosen), shards)
    chosen = chosen[_entry_flags(shard, _split(answers, 1), 0)[back]]
    starts, where = segment_starts(held.windows), dict(zip(held.held.tolist(), range(len(held.held))))
    n_removed, digest, kept_text = [], [], []
    original = table.column("text").to_pylist() if with_text else None
    for doc, (joined, lengths) in enumerate(zip(held.joined, held.lengths)):
        gone = 0
        if doc in where and len(chosen):
            k = where[doc]
            a, b = np.searchsorted(chosen, (starts[k], starts[k] + held.windows[k]))
            if a < b:
                step = np.zeros(len(lengths) + 1, np.int32)
                step[chosen[a:b] - starts[k]] += 1
                step[chosen[a:b] - starts[k] + window] -= 1
                cover = np.cumsum(step[:-1]) > 0
                gone = int(cover.sum())
                joined = b" ".join(w for w, c in zip(joined.split(b" "), cover.tolist()) if not c)
        n_removed.append(gone)
        digest.append(hashlib.sha256(joined).hexdigest())
        if with_text:
            kept_text.append(joined.decode("utf-8", "surrogatepass") if gone else original[held.order[doc]])
    out = table.drop_columns(["unit"] + ([] if with_text else ["text"])).take(pa.array(held.order, pa.int64()))
    if with_text:
        out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(kept_text, pa.string()))
    for name, values in (("n_words", pa.array(held.counts)), ("n_removed", pa.array(n_removed, pa.int64())), ("kept_sha256", pa.array(digest, pa.string()))):
        out = out.append_column(name, values)
    return out


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, carry: tuple[str, ...] = (), with_text: bool = False, depth: int = DEPTH) -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256, with `text` (what is kept) on request, and the columns named in carry.

    Words are runs of anything but ASCII white space. Every word covered by a window of `window`
    consecutive words that also starts anywhere else, in any row, goes; windows are judged on the
    input. Null texts have no words (their kept text stays null), texts shorter than a window keep
    all, a row repeated whole loses every word that a window covers, and null ids are rows like
    others. A text that loses nothing is returned unchanged, another as its kept words joined by
    one space. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    units = max(1, min(math.ceil(size / UNIT_BYTES), math.ceil(math.sqrt(size / 6 / PACKET))), math.ceil(size / MOST_BYTES))
    shards = max(1, min(math.ceil(size / 6 / SHARD_WINDOWS), units))
    # rows equal in id and text are told apart by the part of the file they stand in, which stays the same whenever it is read
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text", F.input_file_name(), F.input_file_block_start()), F.lit(units)))

    def sketch(key, table):
        return _sketch(key[0].as_py(), table, window, shards, depth)

    def estimate(key, table):
        return _answers(key[0].as_py(), table, False)

    def exact(key, table, answers):
        return _exact(key[0].as_py(), table, answers, window, shards, depth)

    def settle(key, table):
        return _answers(key[0].as_py(), table, True)

    def remove(table, answers):
        return _removed(table, answers, window, shards, depth, with_text)

    by_unit = rows.groupBy("unit")
    estimates = by_unit.applyInArrow(sketch, _PACKET).groupBy("shard").applyInArrow(estimate, _ANSWER)
    answers = by_unit.cogroup(estimates.groupBy("unit")).applyInArrow(exact, _PACKET).groupBy("shard").applyInArrow(settle, _ANSWER)
    schema = T.StructType([f for f in rows.schema if f.name != "unit" and (with_text or f.name != "text")] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    out = by_unit.cogroup(estimates.unionByName(answers).groupBy("unit")).applyInArrow(remove, schema)
    out = out.where("n_words is not null")
    return out.select("doc_id", *(["text"] if with_text else []), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "n_words", "n_removed", "kept_sha256")
