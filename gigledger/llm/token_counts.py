"""Edit-aware token counts: per document a segment tree over runs of pre-tokens.

A leaf holds a run of whole pre-tokens (some hundred characters) and its token count; inner nodes
hold sums of characters and tokens. An edit descends by characters to the leaves it touches; only
these, and neighbours as long as the border between them could have moved, are encoded again, and
the sums on the way up are updated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordEncoder, default_vocabulary

LEAF_CHARS = 256


def _kind(c: str) -> str:
    """Letter, digit or ASCII punctuation; empty for all else and for what special tokens are made of."""
    if c.isalpha():
        return "letter"
    if "0" <= c <= "9":
        return "digit"
    return "mark" if "!" <= c <= "~" and c not in "<|>'" else ""


def _border(left: str, right: str) -> bool:
    """No pre-token crosses the border: a single space that follows a visible character starts one, as does a change between letters, digits and marks."""
    if not left or not right or left[-1].isspace():
        return False
    if right[0] == " ":
        return len(right) > 1 and not right[1].isspace()
    one, other = _kind(left[-1]), _kind(right[0])
    return bool(one and other and one != other)


class TokenTree:
    """Segment tree of one text; `encoded` counts the characters that were encoded."""

    def __init__(self, text: str, words: WordEncoder, leaf_chars: int = LEAF_CHARS):
        self.words, self.leaf_chars, self.encoded = words, leaf_chars, 0
        leaves = self._cut(text)
        self._build(leaves, [self._count(leaf) for leaf in leaves])

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        """The tree over leaves whose token counts are known."""
        size = 1
        while size < len(leaves):
            size *= 2
        self.size, self.leaves = size, leaves + [""] * (size - len(leaves))
        self.chars, self.tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        self.chars[size : size + len(leaves)] = [len(leaf) for leaf in leaves]
        self.tokens[size : size + len(leaves)] = counts
        level = size
        while level > 1:
            half = level // 2
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.words.ids(text)) // 4

    def _cut(self, text: str) -> list[str]:
        """Runs of at least leaf_chars characters; a run is longer only as far as no pre-token ends (a long word is one)."""
        out, at = [], 0
        while len(text) - at > self.leaf_chars:
            end = at + self.leaf_chars
            while end < len(text) and not _border(text[end - 1], text[end : end + 2]):
                end += 1
            if end >= len(text):
                break
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf that holds the character position, position within it)."""
        node = 1
        while node < self.size:
            node *= 2
            if position >= self.chars[node]:
                position -= int(self.chars[node])
                node += 1
        return node - self.size, position

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        node = self.size + leaf
        self.chars[node], self.tokens[node] = len(text), self._count(text) if text else 0
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace length characters from start (both cut to the text) by the replacement."""
        size = int(self.chars[1])
        start = max(0, min(start, size))
        length = max(0, min(length, size - start))
        if not size:
            first = last = offset = 0
        else:
            first, offset = self._leaf_at(min(start, size - 1))
            offset += start - min(start, size - 1)
            last, _ = self._leaf_at(max(start, min(start + length, size - 1)) if start < size else size - 1)
        text = "".join(self.leaves[first : last + 1])
        text = text[:offset] + replacement + text[offset + length :]
        while True:  # take neighbours in until no pre-token can cross the borders
            left = next((i for i in range(first - 1, -1, -1) if self.leaves[i]), None)
            if left is not None and not _border(self.leaves[left], text):
                first, text = left, self.leaves[left] + text
                continue
            right = next((i for i in range(last + 1, self.size) if self.leaves[i]), None)
            if right is not None and not _border(text, self.leaves[right]):
                last, text = right, text + self.leaves[right]
                continue
            break
        parts = self._cut(text)
        room = last - first + 1
        if len(parts) > room:  # more leaves than places: build anew, encoding only what the edit touched
            counts = self.tokens[self.size : 2 * self.size].tolist()
            leaves = [*self.leaves[:first], *parts, *self.leaves[last + 1 :]]
            counts = [*counts[:first], *map(self._count, parts), *counts[last + 1 :]]
            kept = [i for i, leaf in enumerate(leaves) if leaf] or [0]
            self._build([leaves[i] for i in kept], [counts[i] for i in kept])
            return
        for i in range(room):
            part = parts[i] if i < len(parts) else ""
            if part or self.leaves[first + i]:
                self._set(first + i, part)

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Attach an edit table (doc_id, seq, start, length, replacement) as an `edits` array in seq order."""
    packed = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    return docs.join(packed, id_col, "left")


def derived_edits(text_col: str, id_col: str, n: int = 3):
    """A column of n edits per document that follow from its own id and text: places, lengths and words by hash."""
    size = F.greatest(F.length(text_col), F.lit(1))
    of = lambda i, what: F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"{what}{i}"))
    edit = lambda i: F.struct(
        F.lit(i).cast("long").alias("seq"),
        F.pmod(of(i, "start"), size).alias("start"),
        F.pmod(of(i, "length"), F.lit(24)).alias("length"),
        F.substring(F.coalesce(text_col, F.lit("")), (F.pmod(of(i, "from"), size) + 1).cast("int"), F.pmod(of(i, "span"), F.lit(24)).cast("int")).alias("replacement"),
    )
    return F.array(*[edit(i) for i in range(n)])


def edited_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """Per input row: doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_encoded.

    n_tokens counts the whole text, n_tokens_after the text after its edits in order (arrays of
    seq, start, length, replacement in characters; places beyond the text are cut to it, a null
    place or length counts as 0, a null replacement as empty). n_encoded is how many characters the
    edits caused to be encoded again. Null texts are empty, null edit arrays mean no edits, null
    ids pass through, repeated rows each give a row, other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_encoded"]

    def run(batches):
        words = WordEncoder(path)
        for batch in batches:
            rows = []
            for doc, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                tree = TokenTree(text.as_py() or "", words)
                before, tree.encoded = tree.total, 0
                todo = edits.as_py() or []
                for e in todo:
                    if e:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                rows.append((doc, before, len(todo), tree.total, int(tree.chars[1]), tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 6)], names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
    return chosen.mapInArrow(run, ", ".join(f"{n} long" for n in names))
