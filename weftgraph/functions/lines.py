"""Line metrics: which lines are code, comment or blank, and the prose in comments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BLANK, COMMENT, CODE = "Blank", "Comment", "Code"
#: fixed values: line comments, block comments and string quotes of each language
SYNTAX = {
    "python": (("#",), (), ('"""', "'''", '"', "'")),
    "rust": (("//",), (("/*", "*/"),), ('"',)),
    "java": (("//",), (("/*", "*/"),), ('"', "'")),
    "typescript": (("//",), (("/*", "*/"),), ('"', "'", "`")),
}
SYNTAX["javascript"] = SYNTAX["typescript"]
MIN_CHARS, MIN_WORDS, MAX_SYMBOLS, MAX_COMMENT = 12, 3, 0.28, 600
#: fixed values: what marks a comment as addressed to a tool
DIRECTIVES = ("eslint", "prettier", "tslint", "clippy", "rustfmt", "noqa", "type:", "@ts-", "pylint", "coverage:", "safety:", "allow(", "deny(", "cfg(", "!/usr/", "!/bin/", "-*- coding")


def classify(text: str | None, language: str) -> list[str]:
    """The kind of each line; a block or a long string carries on over lines."""
    line, block, quotes = SYNTAX.get(language, ((), (), ()))
    out, end, in_string = [], "", False
    for raw in (text or "").split("\n"):
        seen_code = seen_comment = False
        i = 0
        while i < len(raw):
            if end:
                stop = raw.find(end, i)
                if in_string:
                    seen_code = True
                elif raw[i:].strip():
                    seen_comment = True
                if stop < 0:
                    break
                i, end = stop + len(end), ""
                continue
            if raw[i].isspace():
                i += 1
                continue
            if any(raw.startswith(x, i) for x in line):
                seen_comment = True
                break
            opened = next((b for b in block if raw.startswith(b[0], i)), None)
            if opened:
                seen_comment, end, in_string = True, opened[1], False
                i += len(opened[0])
                continue
            seen_code = True
            quote = next((q for q in quotes if raw.startswith(q, i)), None)
            if quote and (len(quote) == 3 or quote == "`"):
                end, in_string = quote, True
                i += len(quote)
                continue
            if quote:
                m = re.compile(rf"{quote}(?:[^{quote}\\]|\\.)*{quote}").match(raw, i)
                i = m.end() if m else i + 1
                continue
            i += 1
        if end and not raw.strip() and not in_string:
            out.append(BLANK)
        else:
            out.append(CODE if seen_code else COMMENT if seen_comment else BLANK)
    return out


def line_kinds(text: str, language: str) -> Column:
    """One value for each line: Blank, Comment or Code."""

    def kinds(t: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([classify(*pair) for pair in zip(t, x)])

    return F.pandas_udf(kinds, ArrayType(StringType()))(text, language)


def count_kind(kinds: Column, kind: str, start: Column, end: Column) -> Column:
    """How many lines from start to end are of a kind."""
    return F.size(F.filter(F.slice(kinds, start, F.greatest(end - start + 1, F.lit(0))), lambda k: k == kind))


def comment_text(line: Column) -> Column:
    """A comment line without its marks."""
    return F.trim(F.regexp_replace(line, r"^\s*(///?!?|#+|/\*+|\*+/?|--)\s?|\s*\*/\s*$", ""))


def is_prose(text: Column) -> Column:
    """Long enough, a few words with letters, few symbols, no directive, and no end like that of a statement."""
    said = F.trim(F.regexp_replace(text, r"^[/*!#\-=]+", ""))
    size = F.octet_length(said)
    symbols = F.length(F.regexp_replace(said, r"[\p{L}\p{N}\s]", ""))
    words = F.size(F.filter(F.split(said, r"\s+"), lambda w: w.rlike(r"\p{L}")))
    told = F.lower(said).rlike("|".join(re.escape(d) for d in DIRECTIVES))
    return (size >= MIN_CHARS) & (words >= MIN_WORDS) & (symbols <= MAX_SYMBOLS * size) & ~told & ~said.rlike(r"[;{]$")


def prose_comments(files: DataFrame) -> DataFrame:
    """(path, line, text): prose comment lines; a line that recurs (a licence header) counts where it stands first. files: (path, language, text)."""
    marked = files.select("path", F.posexplode(F.arrays_zip(F.split("text", "\n").alias("raw"), line_kinds("text", "language").alias("kind"))).alias("pos", "x"))
    found = marked.where(F.col("x.kind") == COMMENT).select("path", (F.col("pos") + 1).alias("line"), F.substring(comment_text(F.col("x.raw")), 1, MAX_COMMENT).alias("text")).where(is_prose(F.col("text")))
    return found.groupBy("text").agg(F.min(F.struct("path", "line")).alias("at")).select("at.path", "at.line", "text")
