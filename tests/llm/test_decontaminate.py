import re

from gigledger.llm.decontaminate import contaminated, drop_contaminated, template_word

UNITS = {"minutes", "hours", "km", "kg", "dollars", "days", "in", "m", "s", "t", "l", "g", "h"}
NUMBERS = {"two", "three", "five", "seven", "twelve", "thirty", "one", "twenty", "hundred", "thousand", "million"}


def forms(text):
    """(with names typed, without, slot value) per template word, by rules of this test's own."""
    out = []
    text = re.sub(r"(?i)\b(two|one|five|seven|twenty|30) (hundred|thousand|million)( and (five|twenty))?\b", lambda m: "9" + m[0].replace(" ", "x"), text or "")
    text = re.sub(r"(?i)\b(twenty|thirty)[ -](one|two|five|seven)\b", r"9\1x\2", text)
    for raw in text.split():
        word = re.sub(r"^[^\w]+|[^\w]+$", "", raw.replace("_", "-"))
        if not word:
            continue
        low = word.lower()
        if any(c.isdigit() for c in word) or low in NUMBERS:
            out.append(("#", "#", low))
        elif low in UNITS:
            out.append(("@", "@", low))
        elif word[:1].isupper() and not (len(word) > 1 and word.isupper()):
            out.append(("&", low, low))
        else:
            out.append((low, low, low))
    return out


def brute(docs, items, window=5, least=0.8):
    """Without prefilter or joins: every document place against every item place, judged per band of shifts."""
    found = {}
    for item, text in items:
        mine = forms(text)
        w = min(window, len(mine))
        if len(mine) < 3:
            continue
        for doc, body in docs:
            theirs = forms(body)
            bands = {}
            for p in range(len(mine) - w + 1):
                for q in range(len(theirs) - w + 1):
                    for f in (0, 1):
                        a, b = [x[f] for x in mine[p : p + w]], [x[f] for x in theirs[q : q + w]]
                        if a == b and set(a) - {"#", "@", "&"}:
                            for band in ((q - p) // 4, (q - p) // 4 - 1):
                                words, slots = bands.setdefault(band, (set(), set()))
                                words.update(range(p, p + w))
                                slots.update((p + k, q + k) for k in range(w) if a[k] in "#@&")
            for words, slots in bands.values():
                met = {}
                for p, q in slots:
                    values = met.setdefault(mine[p][2], {})
                    values[theirs[q][2]] = values.get(theirs[q][2], 0) + 1
                total = sum(sum(v.values()) for v in met.values())
                agree = sum(max(v.values()) for v in met.values()) / total if total else 1.0
                share = len(words) / len(mine)
                if share >= least - 1e-12 and agree >= 0.85:
                    found[doc, item] = max(found.get((doc, item), (0, 0)), (round(share, 9), round(agree, 9)))
    return found


def test_template_words():
    want = {"12.5": ("<num>",) * 2, "Twelve": ("<num>",) * 2, "(Anna)": ("<name>", "anna"), "km,": ("<unit>",) * 2, "Hours": ("<unit>",) * 2, "THE": ("the", "the"), "Über": ("<name>", "über"), "--": ("", ""), "x2": ("<num>",) * 2, "walks.": ("walks", "walks")}
    assert {w: template_word(w) for w in want} == want


APPLES = "Anna buys 12 apples and gives 5 apples to Ben , how many apples does Anna keep at the end ?"
OTHER = "Carl buys 30 apples and gives 7 apples to Dora , how many apples does Carl keep at the end ?"
ITEMS = [
    (1, APPLES),
    (2, "a train goes from the old harbour to the new station in 35 minutes and comes back by night"),
    (3, "too short"),
    (4, None),
    (5, "a train goes from the old harbour to the new station in 35 minutes and comes back by night"),
    (6, "what is 2 plus"),
    (7, "the bright yellow lamp stands near a wooden door behind the quiet garden"),
]


def cases():
    fill = " ".join(f"word{chr(97 + i % 26)} of the" for i in range(200))
    return [
        (1, fill + " " + APPLES + " " + fill),
        (2, fill + " " + OTHER + " " + fill),
        (3, OTHER.replace("Carl keep", "Emil keep")),
        (4, "a Train goes from the old harbour to the new station in 80 hours and comes back by night"),
        (5, "a train goes from the old harbour to the new station"),
        (6, fill),
        (7, None),
        (8, ""),
        (9, "a train goes from the old harbour to the new station in 35 minutes and comes back by night " * 40),
        (10, APPLES + " " + fill + " " + OTHER),
        (11, OTHER + " " + OTHER.replace("Carl", "Fritz").replace("30", "8") + " so"),
        (12, fill + " " + APPLES.lower()),
        (13, APPLES.upper() + " " + fill),
        (14, APPLES.replace("12", "twelve").replace("5", "five")),
        (15, "who knows what is 2 plus that"),
        (16, "the bright yellow lamp stands near a painted door behind the quiet garden"),
        (17, "the bright yellow lamp stands near a very heavy wooden door behind the quiet garden"),
        (19, APPLES.replace("12", "twenty-five").replace("5 apples", "two hundred apples")),
        (20, fill + " " + APPLES.replace("12", "Two hundred and five").replace("5 apples", "thirty seven apples")),
        (21, APPLES.replace("12", "30 million").replace("5 apples", "seven thousand apples")),
        (18, "Anna buys 12 apples " + fill + " and gives 5 apples to Ben , how many " + fill + " apples does Anna keep at the end ?"),
    ]


def test_numbers_of_several_words_are_one_placeholder():
    from gigledger.llm.decontaminate import Templates

    def made(text):
        raw, at, _ = Templates().words(text)
        return [raw[i].strip("\0") for i in at]

    assert made("two hundred and five men , one two and three") == ["two hundred and five", "men", "one", "two", "and", "three"]
    assert made("twenty-five thousand") == ["twenty-five thousand"] and made("2 million and x") == ["2 million", "and", "x"]
    assert made("hundred, five") == ["hundred,", "five"] and made("thirty (five)") == ["thirty", "(five)"] and made("5 6 seventy one") == ["5", "6", "seventy one"]
    assert made("") == [] and made("and") == ["and"]


def test_equals_brute_force(spark):
    docs = cases()
    d = spark.createDataFrame([(*x, "t") for x in docs], "doc_id long, text string, template string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, row int")
    got = {(r.doc_id, r.item_id): (round(r.share, 9), round(r.consistency, 9)) for r in contaminated(d, b).collect()}
    assert got == brute(docs, ITEMS)
    # verbatim beside a re-parameterised copy, two such copies, other letter case, number words, short items, one word changed or added
    assert {k for k in got if k[1] in (1, 6, 7)} == {(i, 1) for i in (1, 2, 10, 11, 12, 13, 14, 19, 20, 21)} | {(15, 6), (16, 7), (17, 7)}
    assert {k[0] for k in got if k[1] == 2} == {4, 9}


def test_rows_without_or_with_shared_ids(spark):
    docs = [(None, APPLES), (None, "nothing of the kind here"), (1, APPLES), (1, "nothing of the kind here"), (1, APPLES), (2, "x " * 30000 + APPLES)]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, row int, c0 int")
    b = spark.createDataFrame(ITEMS + ITEMS[:1] + [(None, "an item that nobody numbered but some repeat")], "item_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in contaminated(d, b).collect()) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (True, 0, 1)]
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, docs[1][1]), (True, docs[1][1])]
    assert contaminated(d.limit(0), b).collect() == [] and contaminated(d, b.limit(0)).collect() == []
    assert drop_contaminated(d, b.limit(0)).count() == len(docs)
