"""Byte-level BPE ids by words: pre-tokens never cross a single space, so equal words are encoded once."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 200_000  # encoded words a worker holds; then it starts anew
# Fixed value: the pre-token pattern of this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Tokens of this vocabulary that stand for themselves wherever they are written.
SPECIAL = {"<|endoftext|>": 50256}
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= \S)")
TOGETHER = 8 << 20  # bytes of text whose different words are encoded once
STRETCH = 1 << 20  # characters that one call encodes, up to the next word's end
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # white space as Python and the pattern know it
_UNEVEN = rf"^ |{_SPACE} |{_SPACE}$|^$"  # some space of the text does not lie between two words


def default_vocabulary() -> str:
    """Path of the installed 50k byte-level vocabulary; the ranks and the JSON tokenizer hold the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> ids of a stretch of text without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """How many bytes the token of each id stands for."""
    with open(path, "rb") as f:
        sizes = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, f)}
    return np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)


def _encoded(text: str, encode) -> np.ndarray:
    """Ids of a text without special tokens; a long one is encoded in stretches, as each call makes a list of numbers."""
    out, at = [], 0
    while cut := _CUT.search(text, at + STRETCH):
        out.append(np.array(encode(text[at : cut.start()]), "<u4"))
        at = cut.start()
    return np.concatenate([*out, np.array(encode(text[at:]), "<u4")])


def _whole_ids(text: str, encode) -> bytes:
    return b"".join((np.array([SPECIAL[part]], "<u4") if part in SPECIAL else _encoded(part, encode)).tobytes() for part in _SPECIAL.split(text))


def _word_ids(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Ids of texts whose words lie one space apart: each different word is encoded once, many in one call, and its ids go where it stands."""
    encode = encoder(path)
    split = pc.split_pattern(texts, " ")
    at, words = split.offsets.to_numpy(), split.values.dictionary_encode()
    joined = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), pa.scalar(" ", texts.type))[0].as_py()
    ids = _encoded(joined, encode)
    word_ends = np.cumsum(pc.binary_length(words.dictionary).to_numpy().astype(np.int64) + 1)
    ends = np.searchsorted(np.cumsum(token_bytes(path)[ids]), word_ends) + 1  # no token crosses a word's end
    # A text's first word has no space before it and so has ids of its own.
    firsts = split.values.take(pa.array(at[:-1])).dictionary_encode()
    own = [np.array(encode(w), "<u4") for w in firsts.dictionary.to_pylist()]
    ends = np.concatenate([[0], ends, len(ids) + np.cumsum([len(x) for x in own])]) * 4
    chosen = words.indices.to_numpy().astype(np.int64)
    chosen[at[:-1]] = len(words.dictionary) + firsts.indices.to_numpy()
    by_word = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([ids, *own]))])
    found = by_word.take(pa.array(chosen))
    _, offsets, data = found.buffers()
    bounds = np.frombuffer(offsets, np.int64)[at].tolist()
    data = memoryview(data)
    for a, b in zip(bounds, bounds[1:]):
        yield bytes(data[a:b])


def ids_of_texts(texts: pa.Array, path: str, together: int = TOGETHER) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, as `WordEncoder.ids` gives them, for as many texts at a time as fit `together` bytes."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + together, side="right")))
        some = texts.slice(a, b - a)
        whole = pc.match_substring_regex(some, _UNEVEN)
        for mark in SPECIAL:
            whole = pc.or_(whole, pc.match_substring(some, mark))
        even = some.filter(pc.invert(whole))
        by_words = _word_ids(even, path) if len(even) else iter(())
        for text, alone in zip(some, whole.to_pylist()):
            yield _whole_ids(text.as_py(), encoder(path)) if alone else next(by_words)
        a = b


class WordEncoder:
    """Encodes whole texts word by word with a bounded memory."""

    def __init__(self, path: str):
        self.encode, self.known = encoder(path), {}

    def _ids(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = np.array(self.encode(word), "<u4").tobytes()
            if len(word) < 64:
                self.known[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; special tokens are cut out first."""
        if not text:
            return b""
        if "<|" in text and _SPECIAL.search(text):
            return b"".join(np.array([SPECIAL[part]], "<u4").tobytes() if part in SPECIAL else self._plain(part) for part in _SPECIAL.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _AFTER_SPACE.search(text):  # a space after white space may belong to a longer pre-token
            words = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            words = [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]
        known, slow = self.known, self._ids
        return b"".join([known.get(w) or slow(w) for w in words])
