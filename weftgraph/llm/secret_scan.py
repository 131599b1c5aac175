"""Secret scan with a randomness test battery, in DataFrame functions only.

Base spans come from three patterns (assign, access, hex). Besides them every
run of 20 or more characters that may stand in an encoded secret is a
candidate. Its encoding is inferred from the characters it uses, and the
battery is computed for it: the chi-squared statistic of the symbol counts, the
number of runs, and the lag-1 serial correlation of the symbols' places in the
alphabet.

Each test of the battery is read twice. Against uniform draws, none may reject
randomness (runs above and below the middle of the alphabet here). Against
ordinary writing, each gives the evidence of its own: symbols are more even than
in writing of that kind (the chi-squared statistic, a linear function of the
equal pairs), there are more runs of digits, small letters and capitals, and
neighbours are less alike. Runs and correlation depend on each other, so the
mean of the two stands beside chi-squared. Where the letters are of one case,
neighbours in writing are hardly alike, either, and the correlation is no
evidence; an alphabet of one kind of character has only chi-squared. The sum is one p-value a candidate, and the
Benjamini-Hochberg rule at ``FDR`` picks the discoveries among the candidates of
similar length in the whole table, so that short strings with their weak
evidence don't hide the long ones. P-values are rounded up to bins, which keeps
the rule conservative and its table bounded (``LENGTHS`` x ``BINS`` rows,
collected to the driver).

Nothing is quadratic in a text: matches are placed ``STEP`` at a time, and a
long candidate is read in parts of ``PART`` characters.

Spans are code points of the whole match, end exclusive. Random spans inside a
base span aren't repeated. Defined results: null and empty texts have no
spans; rows given twice are scanned twice; null ids are kept; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

KINDS = {  # pattern, group whose length counts, least length
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
RANDOM = "random"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
FDR = 0.01
Z_LIMIT, CHI_LIMIT = 3.6, 4.5
BINS, PER_DECADE = 600, 20
LENGTHS = (20, 32, 64, 128, 256)  # strata: from each up to the next
STEP, PART, COUNTED = 512, 4096, 256  # matches placed at once; characters read at once; length up to which symbols are counted in arrays

#: (name, pattern of the whole candidate, alphabet in order, share of equal pairs and serial correlation in ordinary strings of this kind)
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", 0.15, None),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.065, None),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.065, None),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 0.09, 0.0),
    ("hexupper", "^[0-9A-F]+$", "0123456789ABCDEF", 0.09, 0.0),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.06, 0.0),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.06, 0.0),
    ("base36upper", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.06, 0.0),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.055, 0.4),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055, 0.4),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.055, 0.4),
    ("mixed", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 0.055, 0.4),
)
CLASS_CHANGE = 0.15  # changes between character classes for each step in ordinary strings
_SPAN = "array<struct<s:bigint,k:int,e:bigint,t:string>>"


def _matches(text: str, kind: int, pattern: str, group: int, least: int, keep_text: bool = False):
    """Columns of the found strings, what stands between them, and the fold that places them."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    some = F.size("m") > 0
    judged = F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))) if group else F.col("m")
    between = F.when(some, F.split(F.col(text), pattern, -1))
    pieces = F.when(some, F.expr("arrays_zip(m, g, slice(b, 1, size(m)))"))
    parts = f"sequence(0, cast((size(z) - 1) div {STEP} as int))"
    part = f"slice(z, k * {STEP} + 1, {STEP})"
    # where each part begins, then the spans of each part by themselves
    begins = F.when(some, F.expr(f"aggregate({parts}, array(0L), (acc, k) -> array_append(acc, element_at(acc, -1) + aggregate({part}, 0L, (n, x) -> n + char_length(x['2']) + char_length(x.m))))"))
    span = f"named_struct('s', a.at + char_length(x['2']), 'k', {kind}, 'e', a.at + char_length(x['2']) + char_length(x.m), 't', {'x.m' if keep_text else "''"})"
    fold = F.expr(
        f"""coalesce(if(size(m) > 0, flatten(transform({parts}, k -> aggregate({part},
            named_struct('at', element_at(begins, k + 1), 'out', cast(array() as {_SPAN})),
            (a, x) -> named_struct(
                'at', a.at + char_length(x['2']) + char_length(x.m),
                'out', if(char_length(x.g) >= {least}, array_append(a.out, {span}), a.out)),
            a -> a.out))), null), cast(array() as {_SPAN}))"""
    )
    return {"m": found, "g": judged, "b": between, "z": pieces, "begins": begins}, fold


def _spans(df: DataFrame, name: str, *args, **kw) -> DataFrame:
    steps, fold = _matches("text", *args, **kw)
    for step, column in steps.items():
        df = df.withColumn(step, column)
    return df.withColumn(name, fold).drop(*steps)


def _log10_tail(z: str) -> str:
    """-log10 of the upper normal tail for z > 0, by the usual rational-exponential fit of erfc (relative error 1.2e-7)."""
    x, c = f"({z} / sqrt(2.0D))", (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = f"(1.0D / (1.0D + 0.5D * {x}))"
    poly = f"{c[-1]}D"
    for v in reversed(c[:-1]):
        poly = f"({v}D + {t} * {poly})"
    return f"(-(ln(0.5D) + ln({t}) - {x} * {x} + {poly}) / {math.log(10)!r}D)"


def _tested(candidates: str) -> str:
    """SQL: each candidate (s, e, t) with its length stratum, whether the battery passes, and its p-value's bin."""
    encoding = "case " + " ".join(f"when x.t rlike '{p}' then {k}" for k, (_, p, *_) in enumerate(ENCODINGS[:-1], 1)) + f" else {len(ENCODINGS)} end"
    of = lambda values: f"element_at(array({', '.join(values)}), x.enc)"
    alphabet, middle = of([f"'{a}'" for _, _, a, *_ in ENCODINGS]), of([f"'{'0' * -(-len(a) // 2)}{'1' * (len(a) // 2)}'" for _, _, a, *_ in ENCODINGS])
    pairs, alike = of([f"{k}D" for *_, k, _ in ENCODINGS]), of(["cast(null as double)" if k is None else f"{k}D" for *_, k in ENCODINGS])
    letters = lambda text: f"filter(split({text}, ''), c -> c != '')"
    # runs of a string of few symbols: places where two different ones meet
    meet = lambda text, *two: " + ".join(f"(x.n - char_length(replace({text}, '{p}', ''))) / 2" for p in two)
    kinds = "translate(x.t, '0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_', '0000000000" + "1" * 26 + "2" * 26 + "3333')"
    steps = [
        f"transform({candidates}, x -> named_struct('s', x.s, 'e', x.e, 't', x.t, 'n', cast(char_length(x.t) as double), 'enc', {encoding}, 'cl', {kinds}))",
        f"x -> named_struct('s', x.s, 'e', x.e, 't', x.t, 'n', x.n, 'cl', x.cl, 'ab', {alphabet}, 'a', cast(char_length({alphabet}) as double), 'k0', {pairs}, 'c0', {alike}, 'hi', translate(x.t, {alphabet}, {middle}),"
        f" 'ch', if(x.n <= {COUNTED}, {letters('x.t')}, cast(array() as array<string>)))",
        "x -> named_struct('s', x.s, 'e', x.e, 'n', x.n, 'a', x.a, 'k0', x.k0, 'c0', x.c0,"
        f" 'sq', if(x.n <= {COUNTED}, aggregate(array_distinct(x.ch), 0.0D, (acc, d) -> acc + pow(cast(size(filter(x.ch, y -> y = d)) as double), 2)),"
        f" aggregate({letters('x.ab')}, 0.0D, (acc, d) -> acc + pow(x.n - char_length(replace(x.t, d, '')), 2))),"
        f" 'runs', 1.0D + {meet('x.hi', '01', '10')},"
        f" 'change', cast({meet('x.cl', *(p + q for p in '0123' for q in '0123' if p != q))} as double),"
        f" 'lag', aggregate(sequence(0, cast((x.n - 2) / {PART} as int)), 0.0D, (acc, k) -> acc + aggregate({letters(f'substring(x.t, k * {PART} + 1, {PART} + 1)')},"
        " named_struct('p', cast(null as double), 'v', 0.0D), (q, c) -> named_struct('p', instr(x.ab, c) - 1 - (x.a - 1) / 2, 'v', q.v + coalesce(q.p * (instr(x.ab, c) - 1 - (x.a - 1) / 2), 0.0D)), q -> q.v)) / ((x.a * x.a - 1) / 12))",
        "x -> named_struct('s', x.s, 'e', x.e, 'n', x.n, 'c0', x.c0,"
        " 'chi', (x.a * x.sq / x.n - x.n - (x.a - 1)) / sqrt(2 * (x.a - 1) * (x.n - 1) / x.n),"
        " 'runs', (x.runs - 1 - (x.n - 1) / 2) / sqrt((x.n - 1) / 4),"
        " 'lag', x.lag / sqrt(x.n - 1),"
        " 'z1', (x.k0 * x.n * (x.n - 1) / 2 - (x.sq - x.n) / 2) / sqrt(x.k0 * x.n * (x.n - 1)),"
        f" 'z2', (x.change - {CLASS_CHANGE}D * (x.n - 1)) / sqrt({CLASS_CHANGE * (1 - CLASS_CHANGE)}D * (x.n - 1)),"
        " 'z3', (x.c0 - x.lag / (x.n - 1)) * sqrt(x.n - 1))",
        "x -> named_struct('s', x.s, 'e', x.e, 'n', x.n, 'chi', x.chi, 'runs', x.runs, 'lag', x.lag, 'z', case when x.c0 is null then x.z1 when x.c0 = 0 then (x.z1 + x.z2) / sqrt(2.0D) else (x.z1 + (x.z2 + x.z3) / 2) / sqrt(2.0D) end)",
        f"x -> named_struct('s', x.s, 'e', x.e, 'st', {' + '.join(f'if(x.n >= {n}, 1, 0)' for n in LENGTHS)},"
        f" 'ok', x.chi between -{CHI_LIMIT} and {CHI_LIMIT} and abs(x.runs) <= {Z_LIMIT} and abs(x.lag) <= {Z_LIMIT},"
        f" 'bin', if(x.z > 0, cast(floor(least({_log10_tail('x.z')} * {PER_DECADE}, {BINS}D)) as int), 0))",
    ]
    sql = steps[0]
    for step in steps[1:]:
        sql = f"transform({sql}, {step})"
    return sql


def cutoffs(tests: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The least bin that is a discovery in each length stratum; a stratum without any is left out."""
    counts = tests.groupBy("st", "bin").count().collect()  # at most len(LENGTHS) * (BINS + 1) rows
    out: dict[int, int] = {}
    for st in {r.st for r in counts}:
        by_bin = {r.bin: r["count"] for r in counts if r.st == st}
        total, seen = sum(by_bin.values()), 0
        for b in sorted(by_bin, reverse=True):
            seen += by_bin[b]
            if 10 ** (-b / PER_DECADE) <= fdr * seen / total:
                out[st] = b
    return out


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    df = texts(docs)
    for k, (name, (pattern, group, least)) in enumerate(KINDS.items()):
        df = _spans(df, name, k, pattern, group, least)
    df = _spans(df, "tokens", len(KINDS), CANDIDATE, 0, 20, keep_text=True)
    # only digests are kept: what the spans are, never the text
    df = df.select("doc_id", *(F.expr(f"transform({n}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))").alias(n) for n in KINDS), F.expr(_tested("tokens")).alias("tests"))
    df = cut(df)
    limit = cutoffs(df.select(F.inline("tests")), fdr)
    test = "x.ok and (" + (" or ".join(f"(x.st = {st} and x.bin >= {b})" for st, b in sorted(limit.items())) or "false") + ")"
    base = F.array_sort(F.concat(*KINDS))
    df = df.withColumn("base", base).withColumn("found", F.expr(f"filter(tests, x -> {test})"))
    df = df.withColumn("found", F.expr(f"transform(filter(found, x -> not exists(base, y -> y.s <= x.s and x.e <= y.e)), x -> named_struct('s', x.s, 'k', {len(KINDS)}, 'e', x.e))"))
    names = "array(" + ", ".join(f"'{n}'" for n in (*KINDS, RANDOM)) + ")"
    joined = lambda col: F.expr(f"array_join(transform({col}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')")
    df = df.withColumn("every", F.array_sort(F.concat("base", "found")))
    return df.select(
        "doc_id", *(F.size(n).cast("long").alias(f"n_{n}") for n in KINDS), F.size("found").cast("long").alias("n_random"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("every").alias("spans"),
    )
