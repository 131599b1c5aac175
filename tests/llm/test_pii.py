import random
import re
from itertools import product

import pytest

from weftgraph.llm import pii

from .helpers import docs, empty, prose, rows

KEY = b"test"


def kinds(text):
    return [(text[a:b], k) for a, b, k, _ in pii.find(text, KEY)]


def masked(text):
    return pii.replace(text, pii.find(text, KEY))


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_feistel_is_a_permutation(size):
    out = [pii.feistel(v, size, KEY, b"t") for v in range(size)]
    assert sorted(out) == list(range(size))
    assert [pii.feistel(v, size, KEY, b"t", back=True) for v in out] == list(range(size))


VALID = [
    ("dbhcoh.37@mail4.example.com", "email"), ("4111 1111 1111 1111", "card"), ("4111-1111-1111-1111", "card"), ("378282246310005", "card"), ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"), ("123-45-6789", "ssn"),
    ("25.86.162.211", "ip"), ("233.233.171.252", "ip"), ("+1 (152) 555-8590", "phone"), ("1987-03-05", "date"), ("03/25/1987", "date"), ("25/03/1987", "date"), ("5.3.1987", "date"), ("March 5, 1987", "date"), ("5 March 1987", "date"), ("+1 (386) 555-3733", "phone"), ("386-555-3733", "phone"), ("(386) 555-3733", "phone"), ("+49 30 123456", "phone"),
]


@pytest.mark.parametrize("value,kind", VALID)
def test_valid_values_are_found_and_keep_their_format(value, kind):
    text = f"Ask (or not): {value}, é then."
    assert kinds(text) == [(value, kind)]
    new = masked(text)
    assert new != text and kinds(new) and kinds(new)[0][1] == kind and len(kinds(new)) == 1
    assert re.sub(r"\b0", "", pii.restore(new, KEY)) == re.sub(r"\b0", "", text)  # dates may come back with leading zeros
    got = kinds(new)[0][0]
    if kind not in ("ip", "date"):
        assert re.sub(r"\d", "0", re.sub("[a-z]", "a", got)) == re.sub(r"\d", "0", re.sub("[a-z]", "a", value)) or kind == "iban"
    assert pii.find(text, b"other")[0][3] != pii.find(text, KEY)[0][3]


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "1987-02-30", "999.1.1.1", "000-12-3456", "v1.2.3.4.5", "DE00 3704 0044 0532 0130 00", "call 555 now", "a@b", "x1987-03-05", "1234567890", "no digits", "3.14159 2024", "0.0.0.0", "(000) 555-1234"])
def test_invalid_values_stay(text):
    assert kinds(text) == [] and masked(text) == text


def test_equal_values_stay_linked_whatever_their_spelling():
    digits = lambda t: re.sub(r"\D", "", masked(t))
    assert digits("4111 1111 1111 1111") == digits("4111-1111-1111-1111") == digits("4111111111111111")
    assert digits("+1 (386) 555-3733")[1:] == digits("386.555.3733") == digits("(386) 555-3733")
    assert masked("Ab.C@Mail.Org").lower() == masked("ab.c@mail.org")
    assert pii._read_date(masked("1987-03-25"))[0] == pii._read_date(masked("March 25, 1987"))[0]


def test_different_values_differ():
    cards = {c for c in (f"40000000000{a:05d}" for a in range(3000)) if pii.luhn(c)}
    assert len({masked(c) for c in cards}) == len(cards)
    days = [f"{y}-{m:02d}-{d:02d}" for y, m, d in product((1999, 2000), range(1, 13), range(1, 29))]
    assert len({masked(d) for d in days}) == len(days)
    slashes = [f"{a:02d}/{b:02d}/1999" for a, b in product(range(1, 29), range(1, 29)) if min(a, b) <= 12]
    assert len({masked(d) for d in slashes}) == len({d for d in slashes if pii._read_date(d)}) + sum(pii._read_date(d) is None for d in slashes)


def test_table(spark):
    r = random.Random(1)
    values = [v for v, _ in VALID]
    pairs = [(i, " ".join(x for w in prose(i, 40).split() for x in ([w, r.choice(values) + "."] if r.random() < 0.1 else [w]))) for i in range(40)] + [(None, None), (50, ""), (51, "x" * 200000 + " 1987-03-05"), (52, values[0]), (52, values[0]), (53, " ".join(values * 300))]
    source = docs(spark, pairs)
    out = rows(pii.pseudonymise(source, KEY))
    assert pii.pseudonymise(source, KEY).columns == source.columns and len(out) == len(pairs)
    assert [(r["doc_id"], r["text"]) for r in out] == [(d, masked(t)) for d, t in pairs]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out)
    for (d, t), g in zip(pairs, rows(pii.digest(source, KEY))):
        assert g["doc_id"] == d and g["text"] == (masked(t) or "") and re.sub(r"\b0", "", pii.restore(g["text"], KEY)) == re.sub(r"\b0", "", t or "")
        assert sum(g[f"n_{k}"] for k in pii.KINDS) == len([x for x in g["spans"].split(",") if x])
    assert rows(pii.digest(empty(spark), KEY)) == []


NEIGHBOURS = [
    ("card 4111 1111 1111 1111 12/25", ["4111 1111 1111 1111"]), ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]), ("4111-1111-1111-1111 07", ["4111-1111-1111-1111"]), ("12 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("378282246310005 1234", ["378282246310005"]), ("+1 (826) 555-4081 2024", ["+1 (826) 555-4081"]), ("+1 (826) 555-4081 42", ["+1 (826) 555-4081"]), ("+1 826.555.4081.2024", ["+1 826.555.4081"]), ("+44 20 7946 0958 2024", ["+44 20 7946 0958"]),
    ("+33 1 23 45 67 89 10", ["+33 1 23 45 67 89"]), ("+44 (0) 20 7946 0958", ["+44 (0) 20 7946 0958"]), ("+49 30 123456 03/25/1987", ["03/25/1987", "+49 30 123456"]), ("BE68 5390 0754 7034 2024", ["BE68 5390 0754 7034"]),
    ("2221 0000 0000 0009", ["2221 0000 0000 0009"]), ("2720990000000007", ["2720990000000007"]), ("2720 9900 0000 0007 99", ["2720 9900 0000 0007"]),
]


@pytest.mark.parametrize("text,values", NEIGHBOURS)
def test_short_numbers_beside_a_value_change_nothing(text, values):
    found = pii.find(text, KEY)
    assert sorted(text[a:b] for a, b, *_ in found) == sorted(values)
    for a, b, kind, p in found:
        assert p == pii.pseudonym(kind, text[a:b], KEY) != text[a:b]


def test_numbers_beside_values_are_undone_and_other_2_series_stay():
    for text in ("+1 (826) 555-4081 2024", "+44 20 7946 0958 2024", "+33 1 23 45 67 89 10"):
        assert pii.restore(masked(text), KEY) == text
    for stays in ("2220990000000002", "2721000000000004"):
        assert pii.luhn(stays) and kinds(stays) == []


@pytest.mark.parametrize("zero", [0x0660, 0x0966, 0xFF10, 0x1D7CE])
def test_digits_of_other_scripts_are_ordinary_characters(zero):
    other = str.maketrans({str(k): chr(zero + k) for k in range(10)})
    for value, _ in VALID:
        text = f"room 1, id {value.translate(other)} x"
        assert kinds(text) == [] or all(v.isascii() for v, _ in kinds(text))  # an address may have a part without digits
        assert pii.restore(masked(text), KEY) == text
        half = value[: len(value) // 2].translate(other) + value[len(value) // 2 :]
        assert pii.restore(masked(half), KEY) is not None
    for text in ("1 tel +٤٩ ٣٠ ١٢٣٤ ٥٦٧٨", "room 1, id ٣٤٥-٦٧-٨٩٠١ x", "1 ٢٥.٨٦.١٦٢.٢١١ ١٩٨٧-٠٣-٠٥"):
        assert masked(text) == text
    for value, size in ((10, 10), (-1, 10)):
        with pytest.raises(ValueError):
            pii.feistel(value, size, KEY, b"t")


def planted(seed):
    """A text of plain words with values at known places, made without the operator: (text, [(start, end, kind)])."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = r.choice("3456") + digits(14)
        rest = sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d)))
        d += str(-rest % 10)
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    def iban():
        body = digits(18)
        check = 98 - int(body + "131400") % 97  # D = 13, E = 14
        return f"DE{check:02d}{body}"

    make = {
        "card": card, "iban": iban, "email": lambda: f"p{digits(3)}@mail.example.com", "ssn": lambda: f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "date": lambda: f"{r.randint(1950, 2020)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "phone": lambda: f"+1 ({r.randint(200, 999)}) 555-{digits(4)}",
    }
    text, spans = "", []
    for w in prose(seed, 60).split():
        text += w + " "
        if r.random() < 0.15:
            kind = r.choice(list(make))
            value = make[kind]()
            if kind == "ssn" and value[:3] == "666":
                continue
            spans.append((len(text), len(text) + len(value), kind))
            text += value + "; "
    return text, spans


def test_digest_finds_just_what_was_planted(spark):
    given = {d: planted(d) for d in range(120)}
    got = {r["doc_id"]: r for r in rows(pii.digest(docs(spark, [(d, t) for d, (t, _) in given.items()]).repartition(3), KEY))}
    seen: dict[tuple[str, str], str] = {}
    for d, (text, spans) in given.items():
        r = got[d]
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert all(r[f"n_{k}"] == sum(x[2] == k for x in spans) for k in pii.KINDS)
        at, new = 0, r["text"]  # the text is the same around the values, each of which became another of its format
        for k, (a, b, kind) in enumerate(spans):
            assert new.startswith(text[at:a])
            new = new[a - at :]
            stop = text[b : spans[k + 1][0] if k + 1 < len(spans) else None]
            value, new = new[: new.index(stop[:2])], new[new.index(stop[:2]) :]
            assert seen.setdefault((kind, text[a:b]), value) == value != text[a:b]
            if kind != "ip":
                assert re.sub("[a-z]", "a", re.sub("[0-9]", "0", value)) == re.sub("[a-z]", "a", re.sub("[0-9]", "0", text[a:b]))
            at = b
        assert new == text[at:]
    assert len(set(seen.items())) == len(seen) and len({(k, v) for (k, _), v in seen.items()}) == len(seen) > 500


def test_the_key_is_the_sessions_or_random(spark):
    text = "card 4111 1111 1111 1111"
    one = lambda key=None: rows(pii.pseudonymise(docs(spark, [(1, text)]), key))[0]["text"]
    assert one() == one() != text and one() != one(KEY) == masked(text)
    spark.conf.set(pii.KEY_CONF, "test")
    try:
        assert one() == masked(text)
    finally:
        spark.conf.unset(pii.KEY_CONF)
