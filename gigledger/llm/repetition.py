"""Quality rules by repetition coverage.

The words of a text become whole numbers; rolling hashes over them give the windows of several
lengths in numpy, and a window whose hash occurs twice marks the words under it. What a rule
judges is coverage: the share of a text's word characters that lie inside windows of a length that stood before, or in lines that stood before. Equal hashes are compared word by word, so no collision
counts as a repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import encode_utf8

REPEAT = 3  # words of the windows that the base rule counts
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
#: Share of word characters inside windows that stood before in the text that it may have, by window length.
MOST_COVERED = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: Share of word characters in lines that stood before.
MOST_IN_LINES = 0.30

_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _repeated(hashes: np.ndarray, ids: np.ndarray, n: int, first: bool) -> np.ndarray | None:
    """Which windows of n ids occur twice or more, or (first false) stood before; None if two different windows share a hash."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    for k in range(n):
        if (ids[a + k] != ids[b + k]).any():
            return None
    out = np.zeros(len(hashes), bool)
    out[b] = True
    if first:
        out[a] = True
    return out


def covered_words(ids: np.ndarray, lengths: dict[int, bool]) -> dict[int, np.ndarray]:
    """For each window length the words (a mask) that lie in a window of that many ids which occurs twice or more; where its value is false, the first of equal windows does not count."""
    out = {}
    for base in _BASES:
        codes, hashes = _mixed(ids), np.zeros(len(ids), np.uint64)
        for n in range(1, max(lengths) + 1):
            m = len(ids) - n + 1
            if m <= 0:
                break
            hashes = hashes[:m] * np.uint64(base) + codes[n - 1 :]
            if n not in lengths or n in out:
                continue
            found = _repeated(hashes, ids, n, lengths[n])
            if found is None:
                continue
            marks = np.zeros(len(ids) + 1, np.int64)
            marks[:m] += found
            marks[n : n + m] -= found
            out[n] = np.cumsum(marks[:-1]) > 0
        if all(n in out or n > len(ids) for n in lengths):
            break
    else:
        for n in lengths:  # every base met a collision: the windows themselves
            if n not in out and n <= len(ids):
                _, firsts, back, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_index=True, return_inverse=True, return_counts=True)
                out[n] = np.zeros(len(ids), bool)
                for k in np.nonzero(counts[back.ravel()] > 1)[0].tolist():
                    if lengths[n] or k != firsts[back.ravel()[k]]:
                        out[n][k : k + n] = True
    none = np.zeros(len(ids), bool)
    return {n: out.get(n, none) for n in lengths}


def measured(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, and the covered characters of each length of MOST_COVERED."""
    raw = encode_utf8(text)
    code = np.frombuffer(raw, np.uint8)
    space = _SPACES[code]
    begins = (code & 0xC0) != 0x80  # one per code point
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in raw.split()], np.int64)
    n = len(ids)
    chars = np.concatenate([[0], np.cumsum(begins & ~space)])  # word characters before each byte
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    lengths = chars[edges[1::2]] - chars[edges[::2]]
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = at = 0
    for line in raw.split(b"\n"):
        end = at + len(line)
        inside = int(chars[end] - chars[at])
        if inside:
            if line in seen:
                dup_lines += 1
                dup_line_chars += inside
            seen.add(line)
        at = end + 1
    masks = covered_words(ids, {REPEAT: True} | dict.fromkeys(MOST_COVERED, False))
    return (n, int(chars[-1]), int(_SYMBOLS[code].sum()), dup_lines, int(masks[REPEAT].sum()), dup_line_chars, *(int(lengths[masks[k]].sum()) for k in MOST_COVERED))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: what its whole text repeats and whether it is kept.

    Columns: doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words (words in three-word windows that occur
    twice or more), dup_line_chars (word characters of those lines), dup_chars_5 to dup_chars_10 (word characters inside
    windows of so many words that stood before), base_failed (fewer than 50 words, or over half of them repeated) and
    kept: not base_failed, and no coverage above MOST_COVERED or MOST_IN_LINES.

    Null and empty texts have no words and fail; white space is the six ASCII characters, words are
    compared as they are. Each row is judged by its own text: repeated rows and null ids are rows
    like any other, other columns are ignored, an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in MOST_COVERED)]

    def run(batches):
        for batch in batches:
            found = np.array([measured(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(len(names))]], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *names]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    over = F.col("dup_line_chars") > F.col("word_chars") * F.lit(MOST_IN_LINES)
    for n, share in MOST_COVERED.items():
        over |= F.col(f"dup_chars_{n}") > F.col("word_chars") * F.lit(share)
    return out.select("doc_id", *names, failed.alias("base_failed"), (~failed & ~over).alias("kept"))
