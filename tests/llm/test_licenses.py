import math
import random
import re

from gigledger.llm.licenses import PHRASES, TEMPLATES, TemplateIndex, scan_licenses


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc, text):
    words = words_of(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    m = max(len(t.split()) for _, t, _ in TEMPLATES)
    for start in range(0, max(1, len(words) - m), m):
        block = words[start : start + 2 * m]
        for label, template, tells in TEMPLATES:
            t = set(template.split())
            telling = not tells or any(block[i : i + len(x.split())] == x.split() for x in tells for i in range(len(block)))
            if telling and len(t & set(block)) >= math.ceil(0.8 * len(t) - 1e-9):
                found.append((label, len(t & set(block)) / len(t)))
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return (doc, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), max([1.0 if places else 0.0, *(s for _, s in found)]))


def test_equals_brute_force(spark):
    r = random.Random(1)
    pool = [w for _, t, _ in TEMPLATES for w in t.split()] + ["ü", "and", "of", "mit", "x"]
    rows = []
    for i in range(300):
        lines = []
        for _ in range(r.randint(0, 6)):
            if r.random() < 0.5:
                t = r.choice(TEMPLATES)[1].split()
                t = [w for w in t if r.random() < 0.9]
                r.shuffle(t) if r.random() < 0.5 else None
                lines.append(" ".join(t).title() + ".")
            else:
                lines.append(", ".join(r.choice(pool) for _ in range(r.randint(1, 30))))
        rows.append((i, "\n".join(lines)))
    rows += [(400, None), (401, ""), (None, "CC BY-NC CC-BY-NC under the MIT License"), (402, "cc by nc cc by nc"), (402, "cc by nc cc by nc"), (403, "a " * 50000 + "Apache License, Version 2.0")]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, labels string")
    key = lambda x: tuple((v is None, v or 0) for v in x[:2]) + tuple(map(str, x))
    assert sorted((tuple(x) for x in scan_licenses(docs).collect()), key=key) == sorted((brute(*x) for x in rows), key=key)
    assert scan_licenses(docs.limit(0)).collect() == []


def test_licenses_are_told_apart(spark):
    mit = next(t for label, t, _ in TEMPLATES if label == "mit" and "obtaining" in t)
    cases = [
        ("Some words. Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("This library is licensed under the GNU Lesser General Public License version 3", "lgpl-3"),
        ("released under the BSD license", ""),
        ("Distributed under the terms of the BSD 3-Clause license.", "bsd-3"),
        ("// SPDX-License-Identifier: Apache-2.0", "apache-2"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "gpl-2"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: none", ""),
        ("word " * 77 + "\n".join(" ".join(mit.split()[i : i + 4]) for i in range(0, 20, 4)) + " word" * 99, "mit"),
        ("the mit license " + "other " * 200 + "released under", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_filters_lose_no_block():
    r = random.Random(2)
    templates = [(str(i), " ".join(r.sample([f"w{k}" for k in range(30)], r.randint(1, 9))), ()) for i in range(40)]
    index = TemplateIndex(templates, {f"w{k}": k * 7 % 11 for k in range(30)}, 0.7)
    for _ in range(500):
        block = {f"w{k}".encode() for k in r.sample(range(40), r.randint(0, 20))}
        want = sorted((label, len(set(t.encode().split()) & block) / len(t.split())) for label, t, _ in templates if len(set(t.encode().split()) & block) >= math.ceil(0.7 * len(t.split()) - 1e-9))
        assert sorted(index.matches(list(block))) == want
