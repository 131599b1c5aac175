"""The language front ends: a parser for each language, from (text, path) to symbols.

A symbol is a dict with ``kind`` and ``name`` and, where they apply, the other
fields of ``SYMBOL``. The first one is the file itself (``kind`` "file"). A
parser names things as well as one file allows: names that the file imports or
declares are qualified, other names stay as they are written, and what can't be
typed is left out. ``register`` adds a language.
"""

from __future__ import annotations

from collections.abc import Callable

from ...functions.lines import CODE, COMMENT, classify
from .braces import parse_java, parse_rust, parse_typescript
from .python import parse_python

Parser = Callable[[str, str], list[dict]]

SYMBOL = dict(
    owner=None, qualified=None, owner_qualified=None, start=1, end=1, doc=None, extends=(), implements=(), calls=(), uses=(), value_refs=(), imports=(), exports=(), marks=(), route=None, params=0, nesting=0
)

#: fixed values: the endings of each language
ENDINGS = {"python": "py", "rust": "rs", "typescript": "ts tsx", "javascript": "js jsx", "java": "java", "markdown": "md mdx markdown", "pdf": "pdf"}
PARSERS: dict[str, Parser] = {"python": parse_python, "rust": parse_rust, "typescript": parse_typescript, "javascript": parse_typescript, "java": parse_java}


def register(language: str, endings: str, parser: Parser) -> None:
    """Add a language, or put another parser in place of one. ``endings``: separated by blanks. Executors need the same call."""
    ENDINGS[language], PARSERS[language] = endings, parser


def languages() -> dict[str, str]:
    """ending -> language."""
    return {e: name for name, endings in ENDINGS.items() for e in endings.split()}


def parse(text: str, language: str, path: str = "") -> list[dict]:
    """The symbols of a file with all fields and line counts; a file of a language without parser is one symbol."""
    found = PARSERS[language](text, path) if language in PARSERS else []
    found = found or [dict(kind="file", name="")]
    found[0]["end"] = text.count("\n") + 1
    kinds = classify(text, language)
    out = []
    for s in found:
        s = SYMBOL | s
        mine = kinds[s["start"] - 1 : s["end"]]
        s |= dict(comment_lines=mine.count(COMMENT), code_lines=mine.count(CODE), doc_lines=sum(bool(x.strip()) for x in (s["doc"] or "").split("\n")))
        out.append(s)
    return out


def call(name: str, owner: str | None = None, arg: str | None = None, qualified: str | None = None, owner_type: str | None = None, argc: int = 0, ctor: bool = False) -> tuple:
    """A call: ``owner`` is the receiver as written, ``arg`` the first argument if it is a string."""
    return (name, owner, arg and arg[:120], qualified, owner_type, argc, ctor)
