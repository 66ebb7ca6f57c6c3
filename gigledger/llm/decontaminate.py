"""Benchmark decontamination by typed templates.

Texts become template words: numbers (digits or number words, several of them if they form one number), capitalised names and units of measure are
replaced by typed placeholders, everything else is lower-cased; a second form leaves names as
lower-cased words, so that letter case does not matter. Windows of template words are hash-joined
between documents and benchmark. Where a document, at one place, covers enough of an item's words
with placeholders filled consistently, it repeats the item even with other numbers, names or units.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import window_hashes
from .util import cut, numbered, without_rows

REMEMBERED = 200_000  # words whose templates a worker holds; then it starts anew
CELL_BITS = 22  # the prefilter has 2**22 cells whatever the benchmark's size
SLIP = 4  # windows whose place shifts by fewer words belong to one alignment
LEAST_WORDS = 3  # items with fewer template words match nothing
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
PLACEHOLDERS = (NUMBER, NAME, UNIT)
# Units of measure that are replaced by a placeholder.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years meter meters metre metres mile miles yard yards foot feet inch inches gram grams kilogram kilograms liter liters litre litres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters millimetre millimetres milligram milligrams milliliter milliliters ton tons tonne tonnes pound pounds ounce ounces gallon gallons acre acres dollar dollars euro euros cent cents percent degree degrees kph mph kmh".split())
# Words for numbers.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
# Those of them that other number words follow or precede within one number.
_ONES = frozenset("one two three four five six seven eight nine".split())
_TENS = frozenset("twenty thirty forty fifty sixty seventy eighty ninety".split())
_MAGNITUDES = frozenset("hundred thousand million billion".split())
NUMBER_MARK = "\0"  # stands before a number of several words
OTHER_WORD, ONES, WHOLE, TENS, MAGNITUDE, DIGITS, AND = range(7)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_HAS_DIGIT = re.compile(r"\d")


def template_word(raw: str) -> tuple[str, str]:
    """The word's two forms: with names typed, and without; both empty for punctuation alone."""
    word = raw if raw.isalnum() else _EDGE.sub("", raw)
    if not word:
        return "", ""
    low = word.lower()
    if low in NUMBER_WORDS or not word.isalpha() and (_HAS_DIGIT.search(word) or "-" in low and NUMBER_WORDS.issuperset(low.split("-"))):
        return NUMBER, NUMBER
    if low in UNITS:
        return UNIT, UNIT
    if word[0].isupper() and not (len(word) > 1 and word.isupper()):
        return NAME, low
    return low, low


def number_class(raw: str) -> int:
    """What the word can be within a number of several words (64 added if it ends, 128 if it begins with punctuation)."""
    word = _EDGE.sub("", raw)
    low = word.lower()
    last = low.rsplit("-", 1)[-1]
    if low == "and":
        kind = AND
    elif template_word(raw)[0] != NUMBER:
        return OTHER_WORD
    elif last in _MAGNITUDES:
        kind = MAGNITUDE
    elif low in _ONES:
        kind = ONES
    elif low in _TENS:
        kind = TENS
    else:
        kind = DIGITS if _HAS_DIGIT.search(low) else WHOLE
    return kind + 64 * (not raw.endswith(word)) + 128 * (not raw.startswith(word))


def within_numbers(classes: np.ndarray) -> np.ndarray:
    """Which words continue the number before them: "two hundred", "hundred and five", "twenty five", "2 million"."""
    kind, ends, begins = classes & 63, classes & 64, classes & 128
    out = np.zeros(len(kind), bool)
    if len(kind) < 2:
        return out
    a, b = kind[:-1], kind[1:]
    part = (b >= ONES) & (b <= TENS)
    number = (a >= ONES) & (a <= DIGITS)
    out[1:] = ((ends[:-1] | begins[1:]) == 0) & (number & (b == MAGNITUDE) | (a == MAGNITUDE) & part | (a == TENS) & (b == ONES))
    if len(kind) > 2:
        linked = (kind[:-2] == MAGNITUDE) & (b[:-1] == AND) & part[1:] & ((ends[:-2] | begins[1:-1] | ends[1:-1] | begins[2:]) == 0)
        out[1:-1] |= linked
        out[2:] |= linked
    return out


def _digest(form: str) -> int:
    return xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass")) | 1


class _Known(dict):
    """word -> its place among the hashes of its two forms (0 for punctuation alone) and its class; each word is looked at once."""

    def __init__(self):
        self.hashes = array("Q"), array("Q")
        self.classes = array("B")

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        typed, plain = template_word(word)
        first = _digest(typed) if typed else 0
        self.hashes[0].append(first)
        self.hashes[1].append(first if plain == typed else _digest(plain))
        self.classes.append(number_class(word) if typed == NUMBER or plain == "and" else OTHER_WORD)
        return at


class Templates:
    """Hashes of the template words of whole texts."""

    def __init__(self):
        self.known = _Known()

    def words(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(raw words, with what continues a number joined to its first word, positions of those that are template words, hashes of their two forms)."""
        raw = (text or "").split()
        if len(self.known) >= REMEMBERED:
            self.known = _Known()
        places = np.fromiter(map(self.known.__getitem__, raw), np.int64, len(raw))
        hashes = np.array([np.frombuffer(h, np.uint64)[places] for h in self.known.hashes])
        inner = within_numbers(np.frombuffer(self.known.classes, np.uint8)[places])
        at = np.nonzero((hashes[0] != 0) & ~inner)[0]
        for k in np.flatnonzero(inner[1:] & ~inner[:-1]).tolist():
            end = k + 1
            while end < len(raw) and inner[end]:
                end += 1
            raw[k] = NUMBER_MARK + " ".join(raw[k:end])
        return raw, at, hashes[:, at]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - CELL_BITS)


def _made(raw: list[str], at: np.ndarray, start: int, length: int):
    """(template text, slot values or null per word) of the one or two forms of the window at a template word."""
    words = [raw[i] for i in at[start : start + length]]
    forms = list(zip(*((NUMBER, NUMBER) if w[0] == NUMBER_MARK else template_word(w) for w in words)))
    for form in forms if forms[0] != forms[1] else forms[:1]:
        if any(w not in PLACEHOLDERS for w in form):  # placeholders alone tell nothing
            yield " ".join(form), [_EDGE.sub("", w).lower() if f in PLACEHOLDERS else None for w, f in zip(words, form)]


_SCHEMA = "row long, id long, template string, position int, n_words int, length int, slots array<string>"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(_KINDS), _KINDS)], [c.split()[0] for c in _SCHEMA.split(", ")])


def template_windows(table: DataFrame, id_col: str, text_col: str, window: int, cells: np.ndarray | None = None, lengths: list[int] | None = None, row_col: str | None = None) -> DataFrame:
    """(row, id, template, position, n_words, length, slots) per window and form.

    Without cells these are a benchmark's: an item shorter than the window is one window. With
    cells they are a document's windows of the given lengths whose hash cell is set. row numbers
    the table's rows (row_col, or a number of its own).
    """

    def run(batches):
        templates = Templates()
        nth = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                row, nth = nth if row is None else row, nth + 1
                raw, at, hashes = templates.words(text.as_py())
                if len(at) < LEAST_WORDS:
                    continue
                for length in lengths or [min(window, len(at))]:
                    starts = np.arange(max(0, len(at) - length + 1))
                    if cells is not None and len(starts):
                        starts = starts[cells[_cell(window_hashes(hashes[0], length))] | cells[_cell(window_hashes(hashes[1], length))]]
                    rows += [(row, i, template, p, len(at), length, slots) for p in starts.tolist() for template, slots in _made(raw, at, p, length)]
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    return table.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)


def used_cells(benchmark: DataFrame, text_col: str, window: int) -> tuple[np.ndarray, list[int]]:
    """(which hash cells the benchmark's windows use, lengths of its windows); at most 2**CELL_BITS numbers for each of at most `window` lengths reach the driver."""

    def run(batches):
        templates = Templates()
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {}
            for text in batch.column(0):
                _, at, hashes = templates.words(text.as_py())
                if len(at) >= LEAST_WORDS:
                    length = min(window, len(at))
                    found.setdefault(length, []).extend(_cell(window_hashes(h, length)) for h in hashes)
            for length, parts in found.items():
                cells = np.unique(np.concatenate(parts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), length, np.int32)), pa.array(cells)], ["length", "cell"])

    cells = np.zeros(1 << CELL_BITS, bool)
    used = benchmark.select(F.col(text_col).alias("text")).mapInArrow(run, "length int, cell long").distinct().toPandas()
    cells[used["cell"].to_numpy(np.int64)] = True
    return cells, sorted({int(x) for x in used["length"].unique()})


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 5,
    least_share: float = 0.8,
    least_consistency: float = 0.85,
    row_col: str | None = None,
) -> DataFrame:
    """(doc_id, item_id, n_covered, n_words, share, consistency) for each row of docs that repeats a benchmark item.

    Judged at one alignment of document and item (windows shift by less than twice SLIP words), the
    best one counts: share is the part of the item's template words that windows found in the
    document cover; consistency the part of the item's slots that hold the document value which
    their value meets most often (1 without slots). Both must reach their least value. Windows of
    placeholders only do not count. An item shorter than a window is one window, one with fewer
    than LEAST_WORDS template words matches nothing, nor do null and empty texts. Each row of docs
    is judged alone: rows with null or repeated ids each give rows of their own (row_col may name a
    column that numbers them, returned as `row`). Items that share an id, or have none, count as
    one: the best match is returned. Other columns are ignored; empty tables give no rows.
    """
    cells, lengths = used_cells(benchmark, item_text_col, window)
    items = cut(template_windows(benchmark, item_col, item_text_col, window))
    items = items.select(F.col("row").alias("item"), F.col("id").alias("item_id"), "template", F.col("position").alias("item_position"), "n_words", "length", F.col("slots").alias("item_slots"))
    hits = template_windows(docs, id_col, text_col, window, cells, lengths, row_col) if lengths else template_windows(docs.limit(0), id_col, text_col, window)
    hits = cut(hits.select("row", F.col("id").alias("doc_id"), "template", "position", "slots"))

    shift = F.floor((F.col("position") - F.col("item_position")) / SLIP)
    bands = F.explode(F.array(shift, shift - 1)).alias("band")
    places = hits.select("row", "doc_id", "template", "position").join(items.drop("item_slots"), "template")
    places = places.select("row", "doc_id", "item", "item_id", "n_words", "length", "item_position", bands)
    # covered words: every window adds its own words less those of the window before it
    add = lambda a, p: F.struct((a["n"] + F.least(F.col("length"), p + F.col("length") - a["to"])).alias("n"), (p + F.col("length")).alias("to"))
    covered = F.aggregate(F.array_sort("found"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), add)["n"]
    matched = places.groupBy("row", "doc_id", "item", "item_id", "band", "n_words", "length").agg(F.collect_set("item_position").alias("found"))  # at most an item's positions
    matched = matched.withColumn("n_covered", covered).withColumn("share", F.col("n_covered") / F.col("n_words")).where(F.col("share") >= least_share)
    matched = cut(matched.drop("found", "length"))

    near = (shift == F.col("band")) | (shift - 1 == F.col("band"))
    wanted = matched.select("row", "item", "band").join(items.select("item", "template", "item_position", "item_slots"), "item")
    slots = wanted.join(hits.select("row", "template", "position", "slots"), ["row", "template"]).where(near)
    slots = slots.select("row", "item", "band", "item_position", "position", F.posexplode(F.arrays_zip("item_slots", "slots")).alias("at", "pair")).where("pair.item_slots is not null")
    slots = slots.select("row", "item", "band", (F.col("item_position") + F.col("at")).alias("place"), (F.col("position") + F.col("at")).alias("doc_place"), F.col("pair.item_slots").alias("value"), F.col("pair.slots").alias("met")).distinct()
    values = slots.groupBy("row", "item", "band", "value", "met").agg(F.count(F.lit(1)).alias("n"))
    values = values.groupBy("row", "item", "band", "value").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    values = values.groupBy("row", "item", "band").agg((F.sum("most") / F.sum("n")).alias("agree"))
    out = matched.join(values, ["row", "item", "band"], "left").withColumn("consistency", F.coalesce("agree", F.lit(1.0)))
    best = F.max(F.struct("share", "consistency", "n_covered", "n_words")).alias("best")
    out = out.where(F.col("consistency") >= least_consistency).groupBy("row", "doc_id", "item_id").agg(best)
    return out.select(*(["row"] if row_col else []), "doc_id", "item_id", "best.n_covered", "best.n_words", "best.share", "best.consistency")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that repeat no benchmark item, with all their columns; each row is judged by its own text, whatever its id."""
    rows, names = numbered(docs, id_col)
    return without_rows(rows, names, contaminated(rows, benchmark, names[id_col], names[text_col], row_col="row", **options))
