import random
import re

from weftgraph.llm import decontam as dc

from .helpers import docs, empty, prose, rows

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour and Alice Smith waits 45 minutes for it. How far does the train travel before Alice Smith boards it?"),
    (2, "Was st the thonen of in. Erntor er en therha onbleble athethndan and it and thhahaer inwhly, erthble he."),
    (3, "seven tiny words"),
    (4, "too short"),
    (5, None),
    (6, "If 3 apples cost 12 dollars then 3 pears cost 15 dollars and 12 dollars buys the apples, said Bob to Carol over lunch."),
    (7, ""),
]
SAME = "A train leaves Denver at 80 km per hour and Maria Lopez Diaz waits 30 minutes for it. How far does the train travel before Maria Lopez Diaz boards it?"


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


CASES = [
    (1, prose(1, 50) + ". " + ITEMS[0][1] + " " + prose(2, 50)), (2, SAME), (3, prose(3, 2000)), (4, None), (5, ""), (6, ITEMS[1][1].upper()), (7, "well, Seven TINY words!"), (8, "too short"), (16, "It is too short."), (17, "Too SHORT!"),
    (9, ITEMS[1][1][: len(ITEMS[1][1]) // 2]), (10, "If 4 apples cost 10 dollars then 4 pears cost 19 dollars and 10 dollars buys the apples, said Dave to Erin over lunch."),
    (11, "If 4 apples cost 10 dollars then 5 pears cost 19 dollars and 33 dollars buys the apples, said Dave to Erin over lunch."), (None, ITEMS[1][1]), (12, ITEMS[1][1]), (12, ITEMS[1][1]), (13, "x" * 100000 + " " + ITEMS[1][1]),
    (14, ITEMS[1][1].replace("athethndan", "changed")), (15, "1 2 3 4 5 6 7 8 9 " * 200),
]
WANT = {1: (1, "verbatim"), 2: (1, "reparameterised"), 6: (2, "verbatim"), 7: (3, "verbatim"), 8: (4, "verbatim"), 17: (4, "verbatim"), 10: (6, "reparameterised"), None: (2, "verbatim"), 12: (2, "verbatim"), 13: (2, "verbatim")}


def valued(text, starts=False):
    """Plain Python version of the template: (word or placeholder, kind, value)."""
    out, stop = [], True
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        core = re.sub(r"[!-/:-@\[-`{-~]", "", m[0])
        gap = text[out[-1][2] : m.start()] if out else ""
        lead = re.match(r"[!-/:-@\[-`{-~]*", m[0])[0]
        if not core:
            continue
        low = "".join(c.lower() if c.isascii() else c for c in core)
        stop = not out or bool(re.search(r"[.!?:\n]", text[out[-1][3] : m.start() + len(lead)]))
        kind = 0
        if re.search("[0-9]", low) or low in dc.NUMBER_WORDS:
            kind = dc.NUMBER
        elif out and out[-1][1] == dc.NUMBER and low in dc.UNIT_WORDS:
            kind = dc.UNIT
        elif (not stop or starts and low not in dc.COMMON_WORDS) and len(core) > 1 and core[0].isupper() and core[1].islower():
            kind = dc.NAME
        out.append((low, kind, m.end(), m.start() + len(lead), stop))
    merged = [x for i, x in enumerate(out) if not (i and x[1] == dc.NAME and out[i - 1][1] == dc.NAME and not x[4])]
    return [(("", "<num>", "<name>", "<unit>")[k] or w, k, w) for w, k, *_ in merged]


def template(text):
    return [w for w, *_ in valued(text)]


def plain_match(text, item, starts):
    """Whether the item contaminates the text under a reading: windows, alignment and slots, on lists and dicts."""
    t, d = valued(item, starts), valued(text, starts)
    n = min(len(t), dc.WINDOW)
    if not n or n < dc.LEAST and len(d) != n:
        return None
    gram = lambda x, i: tuple(w for w, *_ in x[i : i + n])
    ours = [gram(t, i) for i in range(len(t) - n + 1)]
    theirs = [gram(d, j) for j in range(len(d) - n + 1)]
    if len(set(ours) & set(theirs)) < dc.SIMILARITY * len(set(ours)):
        return None
    pairs = [(i, j) for i, g in enumerate(ours) for j, h in enumerate(theirs) if g == h]
    votes = {}
    for i, j in pairs:
        votes[j - i] = votes.get(j - i, 0) + 1
    shift = max(votes, key=lambda x: (votes[x], -x))
    word = {}
    for i in sorted({i for i, _ in pairs}):
        j = min((j for k, j in pairs if k == i), key=lambda j: (abs(j - i - shift), j))
        for k in range(n):
            word.setdefault(i + k, j + k)
    slots = [(t[i][1:], d[j][1:]) for i, j in word.items() if t[i][1]]
    if all(a == b for a, b in slots):
        return "verbatim"
    kept = tested = 0
    for value in {a for a, _ in slots}:
        new = [b for a, b in slots if a == value]
        if len(new) > 1:
            tested += len(new)
            kept += max(new.count(b) for b in new)
    return "reparameterised" if kept >= dc.CONSISTENT * tested else None


def shares(text, item):
    t, d = template(item), template(text)
    n = dc.WINDOW if len(t) >= dc.WINDOW else len(t)
    if not n or n < dc.LEAST and len(d) != n:
        return 0.0, 0
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return len(grams(t) & grams(d)) / len(grams(t)), len(grams(t))


def test_planted_cases(spark):
    got = rows(dc.matches(docs(spark, CASES), benchmark(spark)))
    assert {r["doc_id"]: (r["item_id"], r["kind"]) for r in got} == WANT
    assert sum(r["doc_id"] == 12 for r in got) == 2
    for r in got:
        share, n = shares(dict(CASES)[r["doc_id"]], dict(ITEMS)[r["item_id"]])
        assert (r["n_windows"], r["n_matched"]) == (n, round(share * n)), r
    for d, t in CASES:  # nothing else reaches the threshold, but for the question with inconsistent slots
        for i, x in ITEMS:
            assert shares(t, x)[0] < dc.SIMILARITY or WANT.get(d, (0,))[0] == i or (d, i) == (11, 6), (d, i)


def test_any_filter_and_any_way_to_join(spark, monkeypatch):
    one = sorted(map(str, rows(dc.matches(docs(spark, CASES), benchmark(spark)))))
    monkeypatch.setattr(dc, "FILTER", 64)  # lets nearly everything through
    monkeypatch.setattr(dc, "sent", lambda df: df)
    many = sorted(map(str, rows(dc.matches(docs(spark, CASES).repartition(3), benchmark(spark, ITEMS + ITEMS[:2])))))
    assert one == many


def test_random_items_against_plain_python(spark):
    """Items cut up and pieced together at random: the shares of windows decide, as in the plain version."""
    r = random.Random(4)
    vocabulary = ["ab", "cd", "ef", "gh", "Ij", "Kl", "7", "12", "km", "x.", "two"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.randint(1, 14))) for k in range(25)]
    cases = []
    for k in range(120):
        text = say(r.randint(0, 6)) + " " + r.choice(items)[1] + " " + say(r.randint(0, 6))
        words = text.split()
        if r.random() < 0.5 and words:
            words[r.randrange(len(words))] = r.choice(vocabulary)
        cases.append((k, " ".join(words)))
    got = {(x["doc_id"], x["item_id"]): x["n_matched"] for x in rows(dc.matches(docs(spark, cases), benchmark(spark, items)))}
    for d, text in cases:
        for i, item in items:
            share, n = shares(text, item)  # names inside sentences only: the other reading may find more
            if (d, i) in got and share >= dc.SIMILARITY:
                assert got[d, i] == round(share * n)
            buf, offs = dc.wh.buffers(dc.pa.array([text]))
            direct = {x[1]: x[3] for x in dc.find_either(dc._readings([item]), buf, offs)}
            assert (got.get((d, i)) == direct.get(0)), (d, i)
    assert len(got) > 60


def test_slots_follow_one_renaming(spark):
    item = (1, "Bag one holds 3 nuts and bag two holds 5 nuts while bag three holds 3 nuts and bag four holds 9 nuts in all.")
    swap = lambda a, b, c, d: f"Bag one holds {a} nuts and bag two holds {b} nuts while bag three holds {c} nuts and bag four holds {d} nuts in all."
    cases = [(1, swap(4, 6, 4, 8)), (2, swap(4, 4, 4, 4)), (3, swap(4, 6, 7, 8)), (4, swap(3, 5, 3, 9)), (5, swap(5, 3, 5, 2))]
    got = {r["doc_id"]: r["kind"] for r in rows(dc.matches(docs(spark, cases), benchmark(spark, [item])))}
    assert got == {1: "reparameterised", 2: "reparameterised", 4: "verbatim", 5: "reparameterised"}
    assert dc.consistent(dc.Counter({("a", "x"): 3, ("a", "y"): 1, ("b", "x"): 2, ("c", "z"): 1})) == (5, 6)
    assert dc.consistent(dc.Counter({("a", "x"): 1, ("b", "x"): 1, ("c", "x"): 1})) == (0, 0)
    assert dc.consistent(dc.Counter({("a", "x"): 1, ("b", "y"): 1})) == (0, 0)


def test_clean(spark):
    source = docs(spark, CASES)
    kept = rows(dc.clean(source, benchmark(spark)))
    assert [r["doc_id"] for r in kept] == [d for d, _ in CASES if d not in WANT]
    assert dc.clean(source, benchmark(spark)).columns == source.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(dc.matches(empty(spark), benchmark(spark))) == []
    assert rows(dc.matches(docs(spark, CASES), none)) == []
    assert len(rows(dc.clean(docs(spark, CASES), none))) == len(CASES)


def test_names_that_begin_sentences(spark):
    items = [(1, "Anna has 3 apples. Anna gives 2 to Tom."), (2, "Tom sells 4 old bikes to Ida Berg. How many bikes does Tom Reed still own now? The shop of Ida Berg opens at 9.")]
    cases = [
        (1, "Maria has 5 apples. Maria gives 1 to Tim."), (2, "Exercise: Maria has 5 apples. Maria gives 1 to Tim. " + prose(4, 30)), (3, "well then Maria has 5 apples. Maria gives 1 to Tim."),
        (4, "Ulf sells 7 old bikes to Eva Lund. How many bikes does Ulf Holm still own now? The shop of Eva Lund opens at 8."), (5, items[0][1]),
        (6, "Maria has 5 pears. Maria sells 1 to Tim."), (7, prose(5, 300).title()),
    ]
    got = {r["doc_id"]: (r["item_id"], r["kind"]) for r in rows(dc.matches(docs(spark, cases), benchmark(spark, items)))}
    assert got == {1: (1, "reparameterised"), 2: (1, "reparameterised"), 3: (1, "reparameterised"), 4: (2, "reparameterised"), 5: (1, "verbatim")}
    assert [r["doc_id"] for r in rows(dc.clean(docs(spark, cases), benchmark(spark, items)))] == [6, 7]


def test_all_pairs_against_the_plain_version(spark):
    """Every pair of document and item, found or not, and its kind."""
    r = random.Random(11)
    vocabulary = ["ab", "cd", "ef", "gh", "Ij", "Kl", "7", "12", "12", "km", "x.", "two", "The", "3"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.randint(1, 16))) for k in range(30)]
    cases = []
    for k in range(150):
        words = (say(r.randint(0, 6)) + " " + r.choice(items)[1] + " " + say(r.randint(0, 6))).split()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words))
            words[at] = r.choice(["7", "12", "99", "Ij", "Zz"]) if words[at] in ("7", "12", "3", "two", "Ij", "Kl") else words[at] if r.random() < 0.7 else r.choice(vocabulary)
        cases.append((k, " ".join(words)))
    got = {(x["doc_id"], x["item_id"]): x["kind"] for x in rows(dc.matches(docs(spark, cases), benchmark(spark, items)))}
    want = {(d, i): kind for d, text in cases for i, item in items if (kind := plain_match(text, item, False) or plain_match(text, item, True))}
    assert got == want and {"verbatim", "reparameterised"} == set(want.values()) and len(want) > 60


SHAPES = [
    "{A} has {x} apples and {y} pears in the box.",
    "A shop sells {x} pens for {y} dollars and {z} books, so how much do {x} pens and one book cost {A} today?",
    "If {A} walks {x} km and {B} walks {y} km before noon, how far did {A} and {B} walk together when they met {C} at {z} hours?",
    "The tank of {A} loses {x} liters in {y} minutes. After how many minutes has it lost {z} liters?",
]


def test_recall_on_new_parameters(spark):
    """Items filled with new parameters, values that agree by chance included, all in prose; and the same with a recurring value broken."""
    r = random.Random(6)
    names, numbers = ["Anna", "Bob", "Carla", "Dave", "Erin", "Frank Hill"], [str(n) for n in range(3, 13)]
    fill = lambda shape: shape.format(**{k: r.choice(names) for k in "ABC"}, **{k: r.choice(numbers) for k in "xyz"})
    items = [(k, shape.format(A="Greta", B="Hugo", C="Ida", x="15", y="16", z="17")) for k, shape in enumerate(SHAPES)]
    cases = [(100 * k + n, prose(n, 30) + ". " + fill(shape) + " " + prose(n + 1, 30)) for k, shape in enumerate(SHAPES) for n in range(50)]
    found = {(x["doc_id"] // 100, x["item_id"]) and x["doc_id"] for x in rows(dc.matches(docs(spark, cases), benchmark(spark, items))) if x["doc_id"] // 100 == x["item_id"]}
    assert len(found) >= 0.98 * len(cases)
    told = [(1, "Anna has 7 apples and 7 pears in the box."), (2, "A shop sells 4 pens for 5 dollars and 6 books, so how much do 9 pens and one book cost Bob today?")]
    assert {(x["doc_id"], x["item_id"]) for x in rows(dc.matches(docs(spark, told), benchmark(spark, items)))} == {(1, 0)}


def test_a_document_that_quotes_the_whole_benchmark(spark, monkeypatch):
    """Its items are dealt over rows of a few each."""
    monkeypatch.setattr(dc, "ITEMS", 3)
    items = [(k, prose(500 + k, 14)) for k in range(40)]
    cases = [(1, ". ".join(t for _, t in items)), (None, ". ".join(t for _, t in items[:7])), (2, items[5][1])]
    got = sorted((str(x["doc_id"]), x["item_id"]) for x in rows(dc.matches(docs(spark, cases), benchmark(spark, items))))
    assert got == sorted([("1", k) for k in range(40)] + [("None", k) for k in range(7)] + [("2", 5)])
