"""Personal data: format-preserving Feistel pseudonyms.

Mail addresses, cards (Luhn), IBANs (mod 97), social security numbers, IPv4
addresses, telephone numbers and full dates are found by pattern and kept only
if they are valid. Each is then permuted by a keyed Feistel network within its
own format: the same separators, letter case and kind of character at every
place, walked on until the result is valid again. The permutation acts on the
value without its separators (a date's day number, an address in small
letters, the national digits of a North American number), so that equal values
get equal pseudonyms in all documents whatever their spelling, and different
values different ones.

Cards, IBANs and telephone numbers are first tried at their longest match; if
that is invalid or meets a find of an earlier kind, at the shorter ones that
end before a separator, and then from the next character on. A telephone
number of a country with one national length is tried at that length first.

Digits are the ASCII digits; those of other scripts are ordinary characters. The key is the caller's or the
session's (``spark.weftgraph.pii.key``); without either each application draws its own at random, so that its
pseudonyms are linked among themselves but can't be undone later.

Whoever holds ``key`` can undo it (``restore``), but for leading zeros of a
date that was written without them and for a number before further digits where
the pseudonym and these happen to be one valid number (one in ten cards before
digits that would still fit a card). Defined results: null and
empty texts stay as they are; texts without personal data are unchanged;
overlapping finds go to the kind listed first in ``KINDS``; null ids and
repeated rows are kept; an empty table gives an empty result; further columns
are kept by ``pseudonymise`` and ignored by ``digest``.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b, sha256
from secrets import token_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, texts

KEY_CONF = "spark.weftgraph.pii.key"
ROUNDS = 8

MONTHS = "January February March April May June July August September October November December".split()
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def feistel(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size)."""
    if not 0 <= value < size:
        raise ValueError("the value lies outside the domain")  # the walk would never come back to it
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, wide = (1 << half) - 1, (half + 7) // 8
    f = lambda i, x: int.from_bytes(blake2b(bytes([i]) + x.to_bytes(wide, "big"), key=key[:64], digest_size=min(64, wide + 8), person=blake2b(tweak, digest_size=16).digest()).digest(), "big") & mask
    while True:
        a, b = value >> half, value & mask
        for i in range(ROUNDS):
            if back:
                a, b = b ^ f(ROUNDS - 1 - i, a), a
            else:
                a, b = b, a ^ f(i, b)
        value = a << half | b
        if value < size:  # else it is outside the domain: walk on along the cycle
            return value


def _letters(s: str) -> tuple[int, int]:
    """The digits and small letters of a string as one number, and how many such numbers there are."""
    value, size = 0, 1
    for c in s:
        if "0" <= c <= "9":
            value, size = value * 10 + ord(c) - 48, size * 10
        elif "a" <= c <= "z":
            value, size = value * 26 + ord(c) - 97, size * 26
    return value, size


def _spell(like: str, value: int) -> str:
    out = []
    for c in reversed(like):
        if "0" <= c <= "9":
            value, d = divmod(value, 10)
            c = chr(48 + d)
        elif "a" <= c <= "z":
            value, d = divmod(value, 26)
            c = chr(97 + d)
        out.append(c)
    return "".join(reversed(out))


def _permute(plain: str, valid: Callable[[str], bool], key: bytes, kind: str, back: bool) -> str:
    """Permute digits and small letters in place, walking on until ``valid``."""
    value, size = _letters(plain)
    tweak = f"{kind}:{re.sub('[0-9]', '0', re.sub('[a-z]', 'a', plain))}".encode()
    while True:
        value = feistel(value, size, key, tweak, back)
        if valid(out := _spell(plain, value)):
            return out


def _refill(like: str, chars: str) -> str:
    """Put ``chars`` at the places of the letters and digits of ``like``, in their case."""
    it = iter(chars)
    return "".join((lambda d: d.upper() if c.isupper() else d)(next(it)) if c.isalnum() else c for c in like)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card_valid(d: str) -> bool:
    known = d[0] in "3456" or len(d) == 16 and "2221" <= d[:4] <= "2720"
    return 13 <= len(d) <= 19 and known and luhn(d) and len(set(d)) > 1


def _iban_valid(s: str) -> bool:
    s = s.upper()
    return 15 <= len(s) <= 34 and 2 <= int(s[2:4]) <= 98 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _nanp_valid(d: str) -> bool:
    return d[:3] != "000" and d[3:6] != "000"


def _email(m: str, key: bytes, back: bool) -> str | None:
    head, _, top = m.lower().rpartition(".")
    plain = "".join(c for c in head if c.isalnum())
    return _refill(m[: len(head)], _permute(plain, lambda s: True, key, "email", back)) + m[len(head) :]


def _card(m: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"[^0-9]", "", m)
    if not _card_valid(d):
        return None
    return _refill(m, d[0] + _permute(d[1:], lambda s: _card_valid(d[0] + s), key, "card" + d[0], back))


def _iban(m: str, key: bytes, back: bool) -> str | None:
    s = m.replace(" ", "").lower()
    if not _iban_valid(s):
        return None
    return _refill(m, s[:2] + _permute(s[2:], lambda x: _iban_valid(s[:2] + x), key, "iban" + s[:2], back))


def _ssn(m: str, key: bytes, back: bool) -> str | None:
    d = m.replace("-", "")
    return _refill(m, _permute(d, _ssn_valid, key, "ssn", back)) if _ssn_valid(d) else None


def _ip(m: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in m.split(".")]
    ok = lambda v: v >> 24 > 0
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
        return None
    value = int.from_bytes(bytes(parts), "big")
    if not ok(value):
        return None
    while True:
        value = feistel(value, 1 << 32, key, b"ip", back)
        if ok(value):
            return ".".join(map(str, value.to_bytes(4, "big")))


def _phone(m: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"[^0-9]", "", m)
    plus = m.startswith("+")
    if (d[0] == "1" and len(d) == 11 or not plus and len(d) == 10) and _nanp_valid(d[-10:]):
        return _refill(m, d[:-10] + _permute(d[-10:], _nanp_valid, key, "phone", back))
    if not plus or not 8 <= len(d) <= 15 or d[0] in "01":
        return None
    return _refill(m, d[:2] + _permute(d[2:], lambda s: True, key, "phone" + d[:2], back))


_DATE = {
    "ymd": re.compile(r"([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})"),
    "xyy": re.compile(r"([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})"),
    "long": re.compile(rf"({'|'.join(MONTHS)}) ([0-9]{{1,2}})(,? )([0-9]{{4}})"),
    "dlong": re.compile(rf"([0-9]{{1,2}}) ({'|'.join(MONTHS)}) ([0-9]{{4}})"),
}


def _read_date(m: str):
    """(day number, format) or None. With a slash the month stands first unless that is no month; else the day does."""
    try:
        if x := _DATE["ymd"].fullmatch(m):
            form, (y, mo, d) = ("ymd", x[2], len(x[3]) + len(x[4]) < 4), (int(x[1]), int(x[3]), int(x[4]))
        elif x := _DATE["xyy"].fullmatch(m):
            a, b, y = int(x[1]), int(x[3]), int(x[4])
            us = a <= 12 if x[2] == "/" else b > 12
            form, (mo, d) = ("mdy" if us else "dmy", x[2], len(x[1]) + len(x[3]) < 4), ((a, b) if us else (b, a))
        elif x := _DATE["long"].fullmatch(m):
            form, (y, mo, d) = ("long", x[3], len(x[2]) < 2), (int(x[4]), MONTHS.index(x[1]) + 1, int(x[2]))
        elif x := _DATE["dlong"].fullmatch(m):
            form, (y, mo, d) = ("dlong", " ", len(x[1]) < 2), (int(x[3]), MONTHS.index(x[2]) + 1, int(x[1]))
        else:
            return None
        n = datetime.date(y, mo, d).toordinal()
    except ValueError:
        return None
    return (n, form) if _FIRST_DAY <= n <= _LAST_DAY else None


def _write_date(n: int, form: tuple[str, str, bool]) -> str:
    kind, sep, short = form
    t = datetime.date.fromordinal(n)
    two = (lambda v: str(v)) if short else (lambda v: f"{v:02d}")
    if kind == "ymd":
        return f"{t.year}{sep}{two(t.month)}{sep}{two(t.day)}"
    if kind in ("mdy", "dmy"):
        a, b = (t.month, t.day) if kind == "mdy" else (t.day, t.month)
        return f"{two(a)}{sep}{two(b)}{sep}{t.year}"
    return f"{MONTHS[t.month - 1]} {two(t.day)}{sep}{t.year}" if kind == "long" else f"{two(t.day)} {MONTHS[t.month - 1]} {t.year}"


def _date(m: str, key: bytes, back: bool) -> str | None:
    read = _read_date(m)
    if not read:
        return None
    n, form = read
    while True:
        n = feistel(n - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, key, b"date", back) + _FIRST_DAY
        got = _read_date(_write_date(n, form))
        if got and (got[0], got[1][0]) == (n, form[0]):
            return _write_date(n, form)


KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "card": (r"(?<![\w.-])(?:[0-9][ -]?){12,18}[0-9](?![\w-])(?!\.[0-9])", _card),
    "ssn": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    "ip": (r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)(?!\.[0-9])", _ip),
    "date": (rf"(?<![\w./-])(?:[0-9]{{4}}([-/.])[0-9]{{1,2}}\1[0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\2[0-9]{{4}}|(?:{'|'.join(MONTHS)}) [0-9]{{1,2}},? [0-9]{{4}}|[0-9]{{1,2}} (?:{'|'.join(MONTHS)}) [0-9]{{4}})(?![\w/-])(?!\.[0-9])", _date),
    "phone": (r"(?<![\w.+(-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![\w-])(?!\.[0-9])", _phone),
}
_COMPILED = {k: re.compile(p) for k, (p, _) in KINDS.items()}
_ANY = re.compile(r"[0-9@]").search
#: separators before which a find of the kind may end short of its longest match
_SHORTER = {"iban": " ", "card": " -", "phone": " .-"}
#: digits after the country code where their number is fixed; codes whose digits all stay in the pseudonym
_NATIONAL = {"7": 10, "30": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "65": 8, "90": 10, "91": 10}


@lru_cache(1 << 14)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one value, None if it isn't valid. ``back`` undoes it."""
    return KINDS[kind][1](value, key, back)


def _ends(kind: str, m: str) -> list[int]:
    """Where a find may end, in the order of trial."""
    seps = _SHORTER.get(kind, "")
    ends = [len(m), *(k for k in range(len(m) - 1, 0, -1) if m[k] in seps and m[k - 1].isalnum())]
    if kind == "phone" and m[0] == "+":
        d = re.sub(r"[^0-9]", "", m)
        code = d[:1] if d[:1] in _NATIONAL else d[:2]
        if code in _NATIONAL:
            ends.sort(key=lambda k: sum(c.isdigit() for c in m[:k]) != len(code) + _NATIONAL[code])
    return ends


def find(text: str | None, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid finds, by start."""
    if not text or not _ANY(text):
        return []
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern in _COMPILED.items():
        if kind == "email" and "@" not in text:
            continue
        borders, at = sorted((a, b) for a, b, *_ in taken), 0
        while m := pattern.search(text, at):
            start, at = m.start(), m.start() + 1 if kind in _SHORTER else m.end()
            for n in _ends(kind, m[0]):
                k = bisect_left(borders, (start + n,)) - 1
                if (k < 0 or borders[k][1] <= start) and (p := pseudonym(kind, m[0][:n], key, back)) is not None:
                    taken.append((start, start + n, kind, p))
                    at = start + n
                    break
    return sorted(taken)


def replace(text: str | None, found: list[tuple[int, int, str, str]]) -> str | None:
    out, at = [], 0
    for a, b, _, p in found:
        out += [text[at:a], p]
        at = b
    return "".join(out) + text[at:] if out else text


def restore(text: str | None, key: bytes) -> str | None:
    """Undo ``replace`` with the key."""
    return replace(text, find(text, key, back=True))


def _pseudonymised(key: bytes):
    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            out = [replace(t, find(t, key)) for t in (x.as_py() for x in batch.column(k))]
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return run


_made: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's configuration names under ``KEY_CONF``; without one, a random key of this application, known to nobody."""
    named = spark.conf.get(KEY_CONF, None)
    return named.encode() if named else _made.setdefault(spark.sparkContext.applicationId, token_bytes(32))


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The documents with pseudonyms in ``text``; ``n_chars``, if there, follows it. No ``key``: the session's."""
    key = key or session_key(docs.sparkSession)
    bounded(docs.sparkSession)
    out = docs.mapInArrow(_pseudonymised(key), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _digest(key: bytes):
    def run(batches):
        for batch in batches:
            counts, spans, out = {k: [] for k in KINDS}, [], []
            for x in batch.column("text"):
                text = x.as_py()
                found = find(text, key)
                kinds = [f[2] for f in found]
                for k, c in counts.items():
                    c.append(kinds.count(k))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
                out.append(replace(text, found))
            hashes = [sha256(t.encode()).hexdigest() for t in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(spans, pa.string()), pa.array(hashes, pa.string()), pa.array(out, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "spans", "text_sha256", "text"])

    return run


def digest(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per document: how many finds of each kind, their spans in the input, and the text with pseudonyms (null: empty). No ``key``: the session's."""
    key = key or session_key(docs.sparkSession)
    return texts(docs).mapInArrow(_digest(key), "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "spans string, text_sha256 string, text string")
