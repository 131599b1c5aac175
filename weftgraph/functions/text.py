"""Scalar functions over names, paths and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN, MAX_TOKEN = 2, 32
#: fixed values: what marks a path as a test
TEST_PATHS = r"/(test|tests|__tests__|spec)/|/test_|[_.](test|spec)\."


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_identifier(name) -> Column:
    """The words of camelCase, snake_case and ACRONYMName; digits stay with the word before them."""
    spaced = F.regexp_replace(_col(name), r"[^\p{L}\p{N}]+", " ")
    spaced = F.regexp_replace(spaced, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda w: w != "")


def humanize_identifier(name) -> Column:
    """The words with blanks between; null for a single word and for what is spelt that way already."""
    words = split_identifier(name)
    text = F.array_join(words, " ")
    return F.when((F.size(words) >= 2) & (text != F.lower(_col(name))), text)


def fnv1a_32(token) -> Column:
    """FNV-1a over the UTF-8 bytes, as a long from 0 to 2**32 - 1."""
    raw = F.hex(F.encode(_col(token), "UTF-8"))
    count = F.octet_length(_col(token))
    byte = lambda i: F.conv(F.substr(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    fold = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.when(count > 0, fold).otherwise(F.lit(2166136261).cast("long"))


#: where a run of letters and digits falls into identifier words
WORD_BORDER = r"[\p{Ll}\p{N}]\p{Lu}|\p{Lu}\p{Lu}\p{Ll}"


def _parts(run) -> Column:
    words = split_identifier(run)
    return F.when(F.size(words) > 1, F.concat(F.array(F.lower(run)), words)).otherwise(F.array(F.lower(run)))


def tokenize(text) -> Column:
    """Runs of letters and digits in small letters, each followed by its identifier words if it has several; 2 to 32 bytes."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(F.flatten(F.transform(runs, _parts)), lambda t: F.octet_length(t).between(MIN_TOKEN, MAX_TOKEN))


def exploded_tokens(df, text, *keep: str):
    """One row for each token of ``tokenize``, with the columns ``keep``, but compiled: the text is split once, and the identifier rule is for runs that have a border."""
    runs = df.select(*keep, F.explode(F.split(_col(text), r"[^\p{L}\p{N}]+")).alias("run"))
    several = F.when(F.col("run").rlike(WORD_BORDER), _parts(F.col("run"))).otherwise(F.array(F.lower("run")))
    return runs.select(*keep, F.explode(several).alias("token")).where(F.octet_length("token").between(MIN_TOKEN, MAX_TOKEN))


def folder_of(path) -> Column:
    """The parent folder, empty at the root."""
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def truncate_chars(text, cap: int) -> Column:
    """At most ``cap`` characters, the last an ellipsis where something was cut."""
    t = _col(text)
    return F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap - 1), F.lit("…"))).otherwise(t)


def joined_distinct(items) -> Column:
    """Comma-joined, each once, in the order of first appearance."""
    return F.array_join(F.array_distinct(_col(items)), ",")


def is_test(file, node_type=None, annotations=None, classification=None) -> Column:
    """1 if an annotation, the classification or the path says so; folders and nodes without a file never are."""
    path = F.lower(F.concat(F.lit("/"), _col(file))).rlike(TEST_PATHS)
    hit = path
    if classification is not None:
        hit = hit | F.coalesce(_col(classification) == "test", F.lit(False))
    if annotations is not None:
        hit = hit | F.coalesce(F.exists(_col(annotations), lambda a: F.lower(a).isin("test", "cfg(test)")), F.lit(False))
    never = _col(file).isNull() | (_col(file) == "")
    if node_type is not None:
        never = never | (_col(node_type) == "Folder")
    return F.when(never, 0).otherwise(hit.cast("int"))


def looks_like_constant(name) -> Column:
    """Capitals, digits and underscores only, with a capital among them."""
    return _col(name).rlike(r"^[\p{Lu}\p{N}_]+$") & _col(name).rlike(r"\p{Lu}")


def span_loc(loc, start, end) -> Column:
    return F.coalesce(_col(loc), F.when(_col(end) >= _col(start), _col(end) - _col(start) + 1))


def literal_rank(name, docs, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 in the documentation, 4 not at all; in any letter case."""
    n, q = F.lower(_col(name)), query.lower()
    return F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2).when(F.lower(_col(docs)).contains(q), 3).otherwise(4)


def embed_budget(window) -> Column:
    """Characters that fit a model's window of tokens; 1500 where it is unknown."""
    chars = F.floor(_col(window) * 3.7 - 750)
    return F.coalesce(F.least(F.greatest(chars, F.lit(500)), F.lit(8000)), F.lit(1500)).cast("long")


def normalize_path(path) -> Column:
    """Without query, fragment, ``.`` and ``..``; a ``..`` at the top is dropped."""
    bare = F.regexp_replace(_col(path), r"[?#].*$", "")
    empty = F.array().cast("array<string>")

    def step(kept, part):
        return F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(bare, "/"), empty, step), "/")


def resolve_relative(base_file, link) -> Column:
    """A link in a file, from the file's folder; one that starts with ``/`` is from the root."""
    return F.when(_col(link).startswith("/"), normalize_path(link)).otherwise(normalize_path(F.concat(folder_of(base_file), F.lit("/"), _col(link))))


def dependency_root(spec) -> Column:
    """The package of an import: ``@scope/name`` or the first segment."""
    return F.regexp_extract(_col(spec), r"^(@[^/]+/[^/]+|[^/]+)", 1)


def boundary_label(boundaries) -> Column:
    """``in:kind detail, out:kind detail, +N more`` of an array of (kind, direction, detail) structs."""
    b = _col(boundaries)
    short = lambda x: F.concat(F.when(x["direction"] == "inbound", "in:").otherwise("out:"), x["kind"], F.coalesce(F.concat(F.lit(" "), x["detail"]), F.lit("")))
    more = F.when(F.size(b) > 2, F.concat(F.lit(", +"), (F.size(b) - 2).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.transform(F.slice(b, 1, 2), short), ", "), more)


def annotation_argument(text, name: str | None = None) -> Column:
    """The quoted value of a named argument of an annotation, else its first quoted string; null if none."""
    first = F.regexp_extract(_col(text), r"\"([^\"]*)\"", 1)
    named = F.regexp_extract(_col(text), rf"\b{name}\s*=\s*\"([^\"]*)\"", 1) if name else F.lit("")
    return F.when(named != "", named).when(first != "", first)


def node_text(kind, name, description, notes, related) -> Column:
    """The text that stands for a node in embeddings: kind, name and its words, description, notes, related names."""
    words = humanize_identifier(name)
    head = F.concat(_col(kind), F.lit(": "), _col(name), F.coalesce(F.concat(F.lit(" ("), words, F.lit(")")), F.lit("")))
    part = lambda label, x: F.when(F.coalesce(_col(x), F.lit("")) != "", F.concat(F.lit(label), _col(x)))
    listed = F.when(F.size(_col(related)) > 0, F.concat(F.lit("Related: "), F.array_join(_col(related), ", ")))
    return F.concat_ws(". ", head, part("", description), part("Notes: ", notes), listed)
