"""What stands around a query's rows: choosing it, its parameters, the range asked for, caveats and rendering."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gql
from .presets import PRESETS, REQUIRED, Preset

MAX_ROWS, RANGE_ROWS, OUTPUT_CHARS, CELL = 10_000, 200, 12_000, 58


class UsageError(ValueError):
    """What was asked for can't be understood; the message says what would be."""


def nearest(name: str, names) -> str | None:
    """The known name with the longest shared prefix, of three letters at least."""
    shared = lambda a: next((k for k, (x, y) in enumerate(zip(a, name)) if x != y), min(len(a), len(name)))
    best = max(sorted(names), key=shared, default=None)
    return best if best and shared(best) >= 3 else None


def resolve(name: str | None = None, text: str | None = None) -> Preset | str:
    """A preset by name, or raw query text; exactly one of the two."""
    if (name is None) == (text is None):
        raise UsageError("give the name of a query or its text, not both")
    if text is not None:
        return text
    if name not in PRESETS:
        hint = nearest(name, PRESETS)
        raise UsageError(f"no query is named {name}" + (f"; did you mean {hint}?" if hint else ""))
    return PRESETS[name]


def bind(preset: Preset, given: dict[str, object]) -> dict[str, object]:
    """Values for all parameters, read by the type of their defaults."""
    for name in given:
        if name not in preset.params:
            known = ", ".join(preset.params) or "none"
            raise UsageError(f"{preset.name} has no parameter {name}; it has: {known}")
    out = {}
    for name, default in preset.params.items():
        value = given.get(name, default)
        if value is REQUIRED:
            raise UsageError(f"{preset.name} needs {name}")
        if isinstance(default, int) and not isinstance(value, int):
            if not re.fullmatch(r"\s*-?\d+\s*", str(value)):
                raise UsageError(f"{name} is a whole number, not {value!r}")
            value = int(value)
        if isinstance(default, list):
            value = [x.strip() for x in re.split(r"[,\n]", value)] if isinstance(value, str) else list(value)
            value = [x for x in value if x]
            if not value:
                raise UsageError(f"{name} is an empty list")
        out[name] = value
    return out


def row_range(text: str | None) -> tuple[int, int]:
    """First row (from 1) and how many: ``20``, ``11-35``, ``34-end``, ``top 10``, ``rows 11 to 35``."""
    if text is None or not text.strip():
        return 1, RANGE_ROWS
    m = re.fullmatch(r"(?i)\s*(?:rows?\s+)?(?:(?:top|first)\s+)?(\d+)(?:\s*(?:-|to|\.\.)\s*(\d+|end))?\s*", text)
    if not m:
        raise UsageError(f"{text!r} is no range; write 20, 11-35 or 34-end")
    if m[2] is None:
        first, last = 1, int(m[1])
    else:
        first, last = int(m[1]), None if m[2].lower() == "end" else int(m[2])
    if first < 1 or last is not None and last < first:
        raise UsageError(f"{text!r} has no rows")
    return first, min(RANGE_ROWS, (last if last is not None else first + RANGE_ROWS - 1) - first + 1)


@dataclass
class Page:
    columns: list[str]
    rows: list[tuple]
    first: int
    truncated: bool
    caveats: list[str] = field(default_factory=list)


def coverage(nodes: DataFrame, properties) -> dict[str, tuple[int, int]]:
    """(nodes with a value, nodes) of each property, in one pass; a property that isn't there has none."""
    known = [p for p in properties if p in nodes.columns]
    row = nodes.agg(F.count("*").alias("__all"), *(F.count(p).alias(p) for p in known)).first()
    return {p: (row[p] if p in known else 0, row["__all"]) for p in properties}


def caveats(found: dict[str, tuple[int, int]]) -> list[str]:
    out = []
    for name, (have, total) in found.items():
        if not total:
            return ["NOT INGESTED: the graph has no nodes"]
        if not have:
            out.append(f"NOT INDEXED: no node has {name}")
        elif have < total:
            out.append(f"{name} is known for {100 * have / total:.0f} % of the nodes; counts are lower bounds")
    return out


def mentioned(text: str) -> list[str]:
    return sorted({x[2] for e in _expressions(gql.parse(text)) for x in gql.parts_of(e) if x[0] == "prop"})


def _expressions(q: gql.Query):
    yield from q.where
    for items, where in q.stages:
        yield from (e for e, _ in items)
        if where is not None:
            yield where
    yield from (e for e, _ in q.items)
    yield from (e for e, _ in q.order)
    for e in q.where:
        for x in gql.parts_of(e):
            if x[0] == "exists":
                yield from _expressions(x[1])


def analyze(nodes: DataFrame, edges: DataFrame, name: str | None = None, text: str | None = None, rows: str | None = None, **params) -> Page:
    """Run a named query or query text and return the rows asked for, with what to beware of."""
    what = resolve(name, text)
    first, count = row_range(rows)
    if isinstance(what, Preset):
        df, reads = what.run(nodes, edges, **bind(what, params)), what.reads
    else:
        df, reads = gql.run(what, nodes, edges, **params), mentioned(what)
    got = df.limit(min(MAX_ROWS, first + count - 1) + 1).collect()  # one more than is shown, to know of a cut
    shown = got[first - 1 : first - 1 + count]
    notes = caveats(coverage(nodes, reads))
    if not got and "target" in params and nodes.where(F.col("file") == params["target"]).isEmpty():
        notes.append(f"TARGET NOT INDEXED: no node has the file {params['target']}")
    return Page(df.columns, [tuple(r) for r in shown], first, len(got) > first - 1 + count, notes)


def explain_error(error: Exception) -> str:
    if isinstance(error, gql.ReadOnlyError):
        return f"{error}. Only MATCH ... RETURN is possible."
    if type(error).__name__ == "FrontierTooLarge":
        return f"{error}. Start from fewer nodes or take fewer hops."
    return f"{error}. A query is MATCH (a:Label)-[:Type]->(b) WHERE ... RETURN ..." if isinstance(error, gql.GqlError) else str(error)


def render(page: Page) -> str:
    """A text table: numbers to the right with one decimal, long cells cut but never ids, at most ``OUTPUT_CHARS``."""

    def cell(name, v):
        s = "" if v is None else f"{v:.1f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
        return s if name == "id" or len(s) <= CELL else s[: CELL - 1] + "…"

    if len(page.columns) == 1 and len(page.rows) == 1:
        lines = [f"{page.columns[0]}: {cell(page.columns[0], page.rows[0][0])}"]
    else:
        body = [[cell(n, v) for n, v in zip(page.columns, r)] for r in page.rows]
        width = [max([len(n), *(len(r[k]) for r in body)]) for k, n in enumerate(page.columns)]
        right = [any(isinstance(r[k], int | float) for r in page.rows) for k in range(len(width))]
        put = lambda r: "  ".join(x.rjust(w) if to_right else x.ljust(w) for x, w, to_right in zip(r, width, right)).rstrip()
        lines = [put(page.columns), *map(put, body)]
    if page.truncated:
        lines.append(f"... more rows from {page.first + len(page.rows)} on")
    text = "\n".join(lines + page.caveats)
    return text if len(text) <= OUTPUT_CHARS else text[: OUTPUT_CHARS - 1] + "…"
