import random
import re
from collections import Counter

import numpy as np

from gigledger.llm import repetition
from gigledger.llm.repetition import MOST_COVERED, MOST_IN_LINES, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)

    def covered(k, first):
        windows = [tuple(words[i : i + k]) for i in range(n - k + 1)]
        counts = Counter(windows)
        return {p for i, w in enumerate(windows) if counts[w] > 1 and (first or windows.index(w) < i) for p in range(i, i + k)}

    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                lines += 1
                line_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars = sum(map(len, words))
    repeat = len(covered(3, True))
    dup = [sum(len(words[p]) for p in covered(k, False)) for k in MOST_COVERED]
    failed = n < 50 or 100 * repeat > 50 * n
    over = line_chars > chars * MOST_IN_LINES or any(d > chars * s for d, s in zip(dup, MOST_COVERED.values()))
    return (n, chars, len(re.findall(r"[#*$%&|<>]", text)), lines, repeat, line_chars, *dup, failed, not failed and not over)


def texts():
    r = random.Random(5)
    pool = ["straße", "né", "東京", "a", "bb", "<b>", "#tag", "50%", "\xa0", "x\x85y", "\x1c", "ok"]
    out = [None, "", " \t\n", "one", "a a a", "same line\nsame line\n same line\nsame line", "\n\n\n"]
    for _ in range(120):
        words = [r.choice(pool) + str(r.randrange(r.choice([2, 9, 400]))) for _ in range(r.randrange(1, 160))]
        if r.random() < 0.4:
            words = words[: r.randrange(1, 30)] * r.randrange(1, 6) + words
        out.append("".join(w + r.choice([" ", "\n", "\t ", "\r\n", "\x0b", " \n"]) for w in words))
    line = "a line of seven words that repeats"
    out += [("\n".join([line] * 5) + "\n" + " ".join(f"w{i}" for i in range(60)))]
    return out


def test_equals_brute_force(spark):
    rows = [(i % 90 if i % 7 else None, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = sorted(map(tuple, repetition_rules(df).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert {g[-1] for g in got} == {True, False} and any(not g[-2] and not g[-1] for g in got)


def test_a_long_text_and_an_empty_table(spark):
    words = [f"w{i * i % 9973}" for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = repetition_rules(df).first()
    assert row.n_words == 200_000 and row.base_failed and not row.kept
    assert repetition_rules(df.where("doc_id > 1")).collect() == []


def test_colliding_hashes_are_no_repetition(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 9, 300)
    want = repetition.covered_words(ids, {3: True, 4: False})
    monkeypatch.setattr(repetition, "_mixed", lambda x: (x % 2).astype(np.uint64))
    got = repetition.covered_words(ids, {3: True, 4: False})
    assert all((want[n] == got[n]).all() for n in (3, 4)) and want[3].any() and not want[4].all()
