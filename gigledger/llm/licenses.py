"""License scan: exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words of a document, line breaks or not: runs of twice the
longest template's length, each starting one such length after the last, so that every stretch
of a template's length lies whole in some block. Template words are ordered by how rare they are
over all documents; a block that holds at least the threshold's share of a template's words must
hold one of its rarest (prefix filter), be long enough (length filter) and still be able to reach
the share from where it matches (position filter). What passes is verified exactly: the share,
and that one of the template's telling phrases, which set its license apart from the next, stands in the block.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import encode_utf8

# Phrases whose consecutive words give a label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices of public licenses, and the phrases of which one must stand in a block (none given: no need).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ()),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2", "apache license 2", "apache 2")),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org", ("apache org",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("attribution 4",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("attribution noncommercial sharealike",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ()),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl-2.1", "this library is licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license version 2", "gnu lesser general public license v2", "gnu lgpl version 2", "gnu lgpl v2")),
    ("lgpl-3", "this library is licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "gnu lgpl v3")),
    ("agpl-3", "this program is licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "gnu agpl v3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2", "eclipse public license v 2", "eclipse public license version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ()),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ()),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("the authors be held liable",)),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("artistic-2", "you may redistribute and modify this package under the terms of the artistic license 2 0", ("artistic license 2", "artistic license version 2")),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("open font license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ()),
    ("mit", "licensed under the terms of the mit license", ("mit license",)),
    ("apache-2", "licensed under the terms of the apache license version 2 0", ("apache license version 2", "apache license 2", "apache 2")),
    ("bsd-2", "distributed under the terms of the bsd 2 clause license", ("bsd 2 clause",)),
    ("bsd-3", "distributed under the terms of the bsd 3 clause license", ("bsd 3 clause",)),
    ("mit", "spdx license identifier mit", ("identifier mit",)),
    ("apache-2", "spdx license identifier apache 2 0", ("identifier apache 2",)),
    ("bsd-2", "spdx license identifier bsd 2 clause", ("identifier bsd 2",)),
    ("bsd-3", "spdx license identifier bsd 3 clause", ("identifier bsd 3",)),
    ("isc", "spdx license identifier isc", ("identifier isc",)),
    ("mpl-2", "spdx license identifier mpl 2 0", ("identifier mpl 2",)),
    ("gpl-2", "spdx license identifier gpl 2 0", ("identifier gpl 2",)),
    ("gpl-3", "spdx license identifier gpl 3 0", ("identifier gpl 3",)),
    ("lgpl-2.1", "spdx license identifier lgpl 2 1", ("identifier lgpl 2",)),
    ("lgpl-3", "spdx license identifier lgpl 3 0", ("identifier lgpl 3",)),
    ("agpl-3", "spdx license identifier agpl 3 0", ("identifier agpl 3",)),
    ("cc0", "spdx license identifier cc0 1 0", ("identifier cc0",)),
    ("unlicense", "spdx license identifier unlicense", ("identifier unlicense",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies do what the fuck you want to public license", ("do what the fuck you want",)),
)
#: Lower-cases A-Z and turns every byte that is no word byte into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def block_words(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        sought = b" " + phrase.encode() + b" "
        at, seen, index = joined.find(sought), 0, 0
        while at >= 0:
            index += joined.count(b" ", seen, at)
            seen = at
            out.append((index, label))
            at = joined.find(sought, at + 1)
    return out


class TemplateIndex:
    """Prefix index of word sets under one global order, rarest word first."""

    def __init__(self, templates, frequency: dict[str, int], threshold: float):
        self.rank = {w.encode(): i for i, w in enumerate(sorted({w for _, t, _ in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w)))}
        self.step = max(len(t.split()) for _, t, _ in templates)
        self.sets, self.prefix = [], {}
        for number, (label, text, tells) in enumerate(templates):
            words = sorted({w.encode() for w in text.split()}, key=self.rank.__getitem__)
            need = math.ceil(threshold * len(words) - 1e-9)
            self.sets.append((label, frozenset(words), len(words), need, [b" " + t.encode() + b" " for t in tells]))
            for at, word in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(word, []).append((number, at))

    def blocks(self, words: list[bytes]):
        """The blocks of a text that hold a prefix word."""
        step, last = self.step, max(0, -(-len(words) // self.step) - 2)
        wanted = set()
        for at, word in enumerate(words):
            if word in self.prefix:
                wanted.update(k for k in (at // step - 1, at // step) if 0 <= k <= last)
        for k in sorted(wanted):
            yield words[k * step : (k + 2) * step]

    def matches(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that the block holds to the threshold, with a telling phrase."""
        out, seen, words, joined = [], set(), set(block), None
        common = sorted(words & self.rank.keys(), key=self.rank.__getitem__)
        for at, word in enumerate(common):
            for number, position in self.prefix.get(word, ()):
                label, wanted, size, need, tells = self.sets[number]
                if number in seen or len(words) < need or min(size - position, len(common) - at) + min(position, at) < need:
                    continue
                seen.add(number)
                share = len(words & wanted)
                if share >= need:
                    joined = joined or b" " + b" ".join(block) + b" "
                    if not tells or any(t in joined for t in tells):
                        out.append((label, share / size))
        return out


def template_word_counts(docs: DataFrame, text_col: str, templates) -> dict[str, int]:
    """How often each template word occurs over all whole texts."""
    wanted = {w.encode() for _, t, _ in templates for w in t.split()}

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(filter(wanted.__contains__, block_words(encode_utf8(text.as_py()))))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.collect()}  # at most the templates' words


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns tell where the phrases stand in the whole text's words. labels joins the base
    labels and those of every template (label, text, telling phrases) of whose distinct words some
    block holds at least the threshold's share, and one of its telling phrases if it has any; score is the largest such share, or 1 with a base place, else 0. Null and
    empty texts have no words and empty label strings, repeated rows each give a row, null ids pass
    through, other columns are ignored, an empty table gives no rows.
    """
    index = TemplateIndex(templates, template_word_counts(docs, text_col, templates), threshold)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode_utf8(text.as_py())
                words = block_words(data)
                places = phrase_places(words, phrases)
                base = {label for _, label in places}
                found = []
                if not index.prefix.keys().isdisjoint(words):
                    for block in index.blocks(words):
                        found += index.matches(block)
                starts = [at for at, _ in places]
                score = max([1.0] if places else [0.0], default=0.0)
                score = max([score, *(s for _, s in found)])
                rows.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {label for label, _ in found})), score))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
