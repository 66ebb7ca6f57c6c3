import random

from gigledger.llm.token_counts import TokenTree, derived_edits, edited_token_counts, with_edits
from gigledger.llm.tokens import WordEncoder, default_vocabulary
from pyspark.sql import functions as F


def full(text, words):
    return len(words.ids(text)) // 4


def test_any_edits_equal_a_full_count():
    r = random.Random(4)
    words = WordEncoder(default_vocabulary())
    bits = [" ", "  ", "\n", "word", "é", "it's", "12", ",", " the", "日本", " ", "\t", "<|endoftext|>", "|>", "a1", "!!", "'", "ll"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 120)))
        tree = TokenTree(text, words, leaf_chars=r.choice([4, 16, 64]))
        assert tree.total == full(text, words)
        for _ in range(6):
            start, length = r.randint(0, len(text) + 3), r.randint(0, 30)
            new = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
            tree.edit(start, length, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + length :]
            assert tree.text == text and tree.total == full(text, words), (text, start)


def test_only_touched_regions_are_encoded():
    words = WordEncoder(default_vocabulary())
    tree = TokenTree("some words here " * 20000, words)
    tree.encoded = 0
    tree.edit(100_000, 5, "other")
    assert tree.encoded < 1500


def test_leaves_stay_small():
    words = WordEncoder(default_vocabulary())
    tree = TokenTree("some words", words, leaf_chars=64)
    text = "some words"
    for i in range(40):
        new = f" piece{i} of text, and more of it" * 10
        at = len(text) // 2
        tree.edit(at, 0, new)
        text = text[:at] + new + text[at:]
    assert tree.text == text and tree.total == full(text, words) and max(map(len, tree.leaves)) < 200
    for line in ("x=1,y=2;" * 4000, "词语,和、数123" * 3000):  # no spaces at all
        tree = TokenTree(line, words)
        tree.encoded = 0
        tree.edit(9000, 3, "abc")
        line = line[:9000] + "abc" + line[9003:]
        assert tree.total == full(line, words) and tree.encoded < 1500


def test_table_form(spark):
    docs = spark.createDataFrame([(1, "one two three", 5), (2, None, 6), (3, "", 7), (None, "x y", 8), (1, "one two three", 5)], "doc_id long, text string, n_tokens int")
    edits = spark.createDataFrame([(1, 1, 0, 3, "1"), (1, 2, None, None, None), (2, 1, 9, 9, "new text")], "doc_id long, seq long, start long, length long, replacement string")
    words = WordEncoder(default_vocabulary())
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_after) for r in edited_token_counts(with_edits(docs, edits)).collect())
    one = (1, full("one two three", words), 2, full("1 two three", words))
    assert got == sorted([one, one, (2, 0, 1, full("new text", words)), (3, 0, 0, 0), (0, full("x y", words), 0, full("x y", words))])
    given = docs.withColumn("edits", derived_edits("text", "doc_id"))
    rows = {(r.doc_id, r.text): r for r in given.collect()}
    for (i, text), r in rows.items():
        text = text or ""
        for e in r.edits:
            s = min(e.start, len(text))
            text = text[:s] + e.replacement + text[s + e.length :]
        after = edited_token_counts(given.where(F.col("doc_id").eqNullSafe(i))).first()
        assert after.n_tokens_after == full(text, words) and after.n_chars_after == len(text)
    assert edited_token_counts(given.limit(0)).collect() == []
