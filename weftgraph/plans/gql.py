"""Read-only graph queries as text, compiled to DataFrames.

    [OPTIONAL] MATCH (a:Label)-[r:T1|T2*1..3]->(b), ... [WHERE ...]
    [WITH items [WHERE ...]] RETURN [DISTINCT] items [ORDER BY ...] [LIMIT n]

Each pattern variable becomes the node columns under its name; a path is a
chain of joins, one row for each path, no edge twice on it. Conditions on one
variable are applied before any join, and a chain is walked from its most
selective end, whichever way it was written. A property that the nodes don't
have is null. There are no write verbs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, sent

MAX_PATH = 16
_TOKEN = re.compile(r"(?:\s|//[^\n]*)*(?:(?P<num>\d+\.\d+|\d+(?!\.\d))|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<param>\$\w+)|(?P<word>[A-Za-z_]\w*)|(?P<op><>|<=|>=|->|<-|\.\.|[-=<>()\[\]{}:,.|*+/%]))")
_REST = re.compile(r"(?:\s|//[^\n]*)*")
_WRITES = {"CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP", "INSERT"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class GqlError(ValueError):
    """The text is not a query of this dialect."""


class ReadOnlyError(GqlError):
    """The text would change the graph."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while not _REST.fullmatch(text, at):
        m = _TOKEN.match(text, at)
        if not m:
            raise GqlError(f"unexpected {text[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    for kind, t in out:
        if kind == "word" and t.upper() in _WRITES:
            raise ReadOnlyError(f"{t}: queries are read-only")
    return out


@dataclass
class Node:
    var: str
    label: str | None = None


@dataclass
class Hop:
    var: str | None
    types: list[str]
    lo: int
    hi: int
    out: bool


@dataclass
class Chain:
    nodes: list[Node]
    hops: list[Hop]
    optional: bool = False


@dataclass
class Query:
    chains: list[Chain] = field(default_factory=list)
    where: list = field(default_factory=list)
    stages: list = field(default_factory=list)  # (items, where) of each WITH
    items: list = field(default_factory=list)
    distinct: bool = False
    order: list = field(default_factory=list)
    limit: int | None = None


class Parser:
    def __init__(self, text: str):
        self.t, self.i, self.anonymous = tokens(text), 0, 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def is_word(self, *words: str) -> bool:
        return all(self.peek(k).upper() == w for k, w in enumerate(words))

    def take(self, text: str | None = None) -> str:
        got = self.peek()
        if not got or text is not None and got.upper() != text.upper():
            raise GqlError(f"expected {text or 'more'}, found {got or 'the end'}")
        self.i += 1
        return got

    def accept(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += len(words)
            return True
        return False

    def name(self) -> str:
        if self.i >= len(self.t) or self.t[self.i][0] != "word":
            raise GqlError(f"expected a name, found {self.peek() or 'the end'}")
        return self.take()

    def query(self, inner: bool = False) -> Query:
        q = Query()
        while self.is_word("MATCH") or self.is_word("OPTIONAL", "MATCH"):
            optional = self.accept("OPTIONAL")
            self.take("MATCH")
            while True:
                q.chains.append(self.chain(optional))
                if not self.accept(","):
                    break
            if self.accept("WHERE"):
                q.where += conjuncts(self.expression())
        if not q.chains:
            raise GqlError("a query starts with MATCH")
        while self.accept("WITH"):
            items = self.items()
            q.stages.append((items, self.expression() if self.accept("WHERE") else None))
        self.take("RETURN")
        q.distinct = self.accept("DISTINCT")
        q.items = self.items()
        if self.accept("ORDER", "BY"):
            while True:
                e = self.expression()
                down = self.accept("DESC") or not (self.accept("ASC") or True)
                q.order.append((e, down))
                if not self.accept(","):
                    break
        if self.accept("LIMIT"):
            q.limit = int(self.take())
        if not inner and self.i < len(self.t):
            raise GqlError(f"unexpected {self.peek()}")
        return q

    def node(self) -> Node:
        self.take("(")
        self.anonymous += 1
        var = self.name() if self.t[self.i][0] == "word" else f"anon{self.anonymous}"
        label = self.name() if self.accept(":") else None
        self.take(")")
        return Node(var, label)

    def chain(self, optional: bool) -> Chain:
        c = Chain([self.node()], [], optional)
        while self.peek() in ("-", "<-"):
            back = self.take() == "<-"
            self.take("[")
            var = self.name() if self.peek() != ":" and self.t[self.i][0] == "word" else None
            types, lo, hi = [], 1, 1
            if self.accept(":"):
                types.append(self.name())
                while self.accept("|"):
                    types.append(self.name())
            if self.accept("*"):
                lo, hi = 1, MAX_PATH
                if self.peek().isdigit():
                    lo = hi = int(self.take())
                if self.accept(".."):
                    hi = int(self.take())
            self.take("]")
            self.take("-" if back else "->")
            if not 1 <= lo <= hi <= MAX_PATH:
                raise GqlError(f"a path has 1 to {MAX_PATH} edges")
            c.hops.append(Hop(var, types, lo, hi, not back))
            c.nodes.append(self.node())
        return c

    def items(self) -> list[tuple[object, str]]:
        out = []
        while True:
            start = self.i
            e = self.expression()
            text = "".join(t for _, t in self.t[start : self.i])
            out.append((e, self.name() if self.accept("AS") else text))
            if not self.accept(","):
                return out

    # expressions: nested tuples, the operator first

    def expression(self):
        e = self.conjunction()
        while self.accept("OR"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.negation()
        while self.accept("AND"):
            e = ("and", e, self.negation())
        return e

    def negation(self):
        return ("not", self.negation()) if self.accept("NOT") else self.comparison()

    def comparison(self):
        e = self.sum()
        if self.accept("IS"):
            no = self.accept("NOT")
            self.take("NULL")
            return ("not", ("null", e)) if no else ("null", e)
        for words, op in ((("STARTS", "WITH"), "starts"), (("ENDS", "WITH"), "ends"), (("CONTAINS",), "contains"), (("IN",), "in")):
            if self.accept(*words):
                return (op, e, self.sum())
        if self.is_word("NOT"):
            raise GqlError("write NOT (x IN ...)")
        if self.peek() in ("=", "<>", "<", ">", "<=", ">="):
            return (self.take(), e, self.sum())
        return e

    def sum(self):
        e = self.product()
        while self.peek() in ("+", "-"):
            e = (self.take(), e, self.product())
        return e

    def product(self):
        e = self.atom()
        while self.peek() in ("*", "/", "%"):
            e = (self.take(), e, self.atom())
        return e

    def atom(self):
        if self.i >= len(self.t):
            raise GqlError("unexpected end")
        kind, t = self.t[self.i]
        if self.accept("("):
            e = self.expression()
            self.take(")")
            return e
        if self.accept("["):
            out = []
            while not self.accept("]"):
                out.append(self.expression())
                self.accept(",")
            return ("list", out)
        if self.accept("-"):
            return ("-", ("value", 0), self.atom())
        if kind == "num":
            self.take()
            return ("value", float(t) if "." in t else int(t))
        if kind == "str":
            self.take()
            return ("value", re.sub(r"\\(.)", r"\1", t[1:-1]))
        if kind == "param":
            self.take()
            return ("param", t[1:])
        if self.accept("CASE"):
            arms = []
            while self.accept("WHEN"):
                cond = self.expression()
                self.take("THEN")
                arms.append((cond, self.expression()))
            other = self.expression() if self.accept("ELSE") else ("value", None)
            self.take("END")
            return ("case", arms, other)
        if self.accept("EXISTS"):
            self.take("{")
            q = self.query(inner=True)
            self.take("}")
            return ("exists", q)
        name = self.name()
        if name.upper() in ("TRUE", "FALSE", "NULL"):
            return ("value", {"TRUE": True, "FALSE": False, "NULL": None}[name.upper()])
        if self.accept("("):
            if self.accept("*"):
                self.take(")")
                return ("call", name.lower(), False, None)
            distinct = self.accept("DISTINCT")
            arg = self.expression()
            self.take(")")
            return ("call", name.lower(), distinct, arg)
        return ("prop", name, self.name()) if self.accept(".") else ("var", name)


def parse(text: str) -> Query:
    return Parser(text).query()


def conjuncts(e) -> list:
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


def parts_of(e) -> list:
    """An expression and all expressions in it; an EXISTS is opaque."""
    out = [e]
    if isinstance(e, tuple) and e and e[0] not in ("value", "param", "prop", "var", "exists"):
        for x in e[1:]:
            for y in x if isinstance(x, list) else [x]:
                for z in y if isinstance(y, tuple) and y and not isinstance(y[0], str) else [y]:
                    if isinstance(z, tuple):
                        out += parts_of(z)
    return out


def variables(e) -> set[str]:
    return {x[1] for x in parts_of(e) if x[0] in ("prop", "var")}


def aggregated(e) -> bool:
    return any(x[0] == "call" and x[1] in AGGREGATES for x in parts_of(e))


def ends_suffice(q: Query) -> bool:
    """Whether the result is the same if paths with the same ends count once."""
    first = q.stages[0][0] if q.stages else q.items
    calls = [x for e, _ in first for x in parts_of(e) if x[0] == "call" and x[1] in AGGREGATES]
    if not calls:
        return not q.stages and q.distinct
    return all(x[2] or x[1] in ("min", "max") for x in calls)


class Compiler:
    """``sets``: paths with the same ends count once, so that they aren't listed."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, params: dict | None = None, sets: bool = False):
        self.nodes, self.edges, self.params, self.sets = nodes, edges, params or {}, sets

    def value(self, e, has: set[str], frame: set[str]) -> Column:
        """``has``: pattern variables; ``frame``: columns that exist."""
        op = e[0]
        v = lambda x: self.value(x, has, frame)
        if op == "value":
            return F.lit(e[1])
        if op == "param":
            if e[1] not in self.params:
                raise GqlError(f"parameter ${e[1]} has no value")
            p = self.params[e[1]]
            return F.array(*map(F.lit, p)) if isinstance(p, list | tuple) else F.lit(p)
        if op == "list":
            return F.array(*map(v, e[1]))
        if op == "prop":
            name = f"{e[1]}__{e[2]}"
            return F.col(name) if name in frame else F.lit(None)
        if op == "var":
            if e[1] in frame:
                return F.col(e[1])
            if e[1] in has:
                return F.col(f"{e[1]}__id") if f"{e[1]}__id" in frame else F.col(f"{e[1]}__edge_type")
            raise GqlError(f"unknown name {e[1]}")
        if op in ("and", "or"):
            return v(e[1]) & v(e[2]) if op == "and" else v(e[1]) | v(e[2])
        if op == "not":
            return ~v(e[1])
        if op == "null":
            return v(e[1]).isNull()
        if op == "in":
            items = [v(x) for x in e[2][1]] if e[2][0] == "list" else [F.lit(x) for x in self.params.get(e[2][1], ())] if e[2][0] == "param" else None
            return v(e[1]).isin(*items) if items is not None else F.array_contains(v(e[2]), v(e[1]))
        if op in ("starts", "ends", "contains"):
            a, b = v(e[1]), v(e[2])
            return {"starts": a.startswith, "ends": a.endswith, "contains": a.contains}[op](b)
        if op == "case":
            out = v(e[2])
            for cond, then in reversed(e[1]):
                out = F.when(v(cond), v(then)).otherwise(out)
            return out
        if op == "call":
            return self.call(e, v)
        if op == "exists":
            raise GqlError("EXISTS stands alone in WHERE, or under NOT")
        a, b = v(e[1]), v(e[2])
        return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op] if op in ("=", "<>", "<", ">", "<=", ">=") else {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[op]

    def call(self, e, v) -> Column:
        _, name, distinct, arg = e
        if name in ("elementkey", "id"):
            return v(arg)
        if name in ("labels", "label", "type"):
            return v(("prop", arg[1], "edge_type" if name == "type" else "node_type"))
        if name == "count":
            return F.count("*") if arg is None else F.count_distinct(v(arg)) if distinct else F.count(v(arg))
        if name == "collect":
            return F.collect_set(v(arg)) if distinct else F.collect_list(v(arg))
        if name in AGGREGATES:
            return {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](v(arg))
        scalar = {"tolower": F.lower, "toupper": F.upper, "size": F.size, "length": F.length, "coalesce": F.coalesce, "abs": F.abs}
        if name in scalar:
            return scalar[name](v(arg))
        raise GqlError(f"unknown function {name}")

    def node_frame(self, n: Node, where: list) -> DataFrame:
        df = self.nodes if n.label is None else self.nodes.where(F.col("node_type") == n.label)
        df = df.select(*(F.col(c).alias(f"{n.var}__{c}") for c in self.nodes.columns))
        for e in where:
            df = df.where(self.value(e, {n.var}, set(df.columns)))
        return df

    def hop_frame(self, h: Hop, tag: str, backwards: bool, starts: DataFrame) -> list[DataFrame]:
        """One frame (from, to) for each path length; no edge twice. Of more than one edge only the paths from ``starts`` (id) are made, each length from the written one before."""
        e = self.edges.where(F.col("edge_type").isin(*h.types)) if h.types else self.edges
        a, b = ("source", "target") if h.out != backwards else ("target", "source")
        one = lambda k: e.select(F.col(a).alias(f"{tag}{k}a"), F.col(b).alias(f"{tag}{k}b"), F.col("edge_type").alias(f"{tag}{k}t"))
        same = lambda j, k: (F.col(f"{tag}{j}a") == F.col(f"{tag}{k}a")) & (F.col(f"{tag}{j}b") == F.col(f"{tag}{k}b")) & (F.col(f"{tag}{j}t") == F.col(f"{tag}{k}t"))
        out, path = [], one(1)
        if h.hi > 1:
            path = path.join(sent(cut(starts)), F.col(f"{tag}1a") == F.col("id"), "left_semi")
        for k in range(1, h.hi + 1):
            if k > 1:
                path = sent(cut(path)).join(one(k), F.col(f"{tag}{k - 1}b") == F.col(f"{tag}{k}a"))
                path = path.where(~reduce(lambda x, y: x | y, (same(j, k) for j in range(1, k))))
            if k >= h.lo:
                cols = [F.col(f"{tag}1a").alias(f"{tag}from"), F.col(f"{tag}{k}b").alias(f"{tag}to")]
                if h.var and h.hi == 1:
                    cols.append(F.col(f"{tag}1t").alias(f"{h.var}__edge_type"))
                out.append(path.select(*cols))
        return out

    def reached(self, h: Hop, tag: str, backwards: bool, starts: DataFrame) -> DataFrame:
        """(from, to), each once: what is within ``hi`` edges of the starts. The shortest walk between two nodes uses no edge twice."""
        e = self.edges.where(F.col("edge_type").isin(*h.types)) if h.types else self.edges
        a, b = ("source", "target") if h.out != backwards else ("target", "source")
        step = e.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
        at, out = starts.select(F.col("id").alias("_f"), F.col("id").alias("_t")), None
        for _ in range(h.hi):
            at = at.join(step, F.col("_t") == F.col("_a")).select("_f", F.col("_b").alias("_t")).distinct()
            out = at if out is None else out.unionByName(at)
        return out.distinct().select(F.col("_f").alias(f"{tag}from"), F.col("_t").alias(f"{tag}to"))

    def chain_frame(self, c: Chain, where: list, known: DataFrame | None, number: int) -> DataFrame:
        own = {n.var: [e for e in where if variables(e) == {n.var}] for n in c.nodes}
        nodes, hops = c.nodes, c.hops
        weight = lambda n: sum(3 if e[0] in ("=", "in") else 1 for e in own[n.var]) + bool(n.label)
        bound = known is not None and f"{nodes[0].var}__id" in known.columns
        backwards = known is not None and f"{nodes[-1].var}__id" in known.columns and not bound or not bound and weight(nodes[-1]) > weight(nodes[0])
        if backwards:
            nodes, hops = nodes[::-1], hops[::-1]
        how = "left" if c.optional else "inner"
        first = nodes[0]
        if known is not None and f"{first.var}__id" in known.columns:
            df = known
        else:
            df = self.node_frame(first, own[first.var])
            if known is not None:
                raise GqlError("patterns must share a variable with an earlier one")
        for k, (h, n) in enumerate(zip(hops, nodes[1:])):
            tag = f"h{number}_{k}_"
            starts = df.select(F.col(f"{nodes[k].var}__id").alias("id")).distinct()
            if self.sets and h.lo == 1 and h.hi > 1:
                paths = self.reached(h, tag, backwards, starts)
            else:
                paths = reduce(DataFrame.unionByName, self.hop_frame(h, tag, backwards, starts))
            if f"{n.var}__id" in df.columns:
                df = df.join(paths, (F.col(f"{nodes[k].var}__id") == F.col(f"{tag}from")) & (F.col(f"{n.var}__id") == F.col(f"{tag}to")), how)
            else:
                right = paths.join(self.node_frame(n, own[n.var]), F.col(f"{tag}to") == F.col(f"{n.var}__id"))
                df = df.join(right, F.col(f"{nodes[k].var}__id") == F.col(f"{tag}from"), how)
            df = df.drop(f"{tag}from", f"{tag}to")
        return df

    def patterns(self, q: Query, known: DataFrame | None = None) -> tuple[DataFrame, set[str]]:
        has = {n.var for c in q.chains for n in c.nodes} | {h.var for c in q.chains for h in c.hops if h.var}
        plain = [e for e in q.where if not any(x[0] == "exists" for x in parts_of(e))]
        df = known
        for k, c in enumerate(q.chains):
            df = self.chain_frame(c, plain, df, k if known is None else k + 100)
        single = {n.var for c in q.chains for n in c.nodes}
        for e in q.where:
            if e in plain and not (len(variables(e)) == 1 and variables(e) <= single and known is None):
                df = df.where(self.value(e, has, set(df.columns)))
        for e in q.where:
            if e not in plain:
                negated = e[0] == "not"
                inner = e[1] if negated else e
                if inner[0] != "exists":
                    raise GqlError("EXISTS stands alone in WHERE, or under NOT")
                df = self.exists(df, inner[1], negated, has)
        return df, has

    def exists(self, df: DataFrame, q: Query, negated: bool, has: set[str]) -> DataFrame:
        """A semi or anti join on the variables that the inner pattern shares with the outer."""
        inner, _ = Compiler(self.nodes, self.edges, self.params, True).patterns(q)
        shared = sorted({n.var for c in q.chains for n in c.nodes} & has)
        if not shared:
            raise GqlError("EXISTS shares no variable with its query")
        keys = inner.select(*(F.col(f"{v}__id").alias(f"{v}__key") for v in shared)).distinct()
        on = reduce(lambda a, b: a & b, (F.col(f"{v}__id") == F.col(f"{v}__key") for v in shared))
        return df.join(keys, on, "left_anti" if negated else "left_semi")

    def project(self, df: DataFrame, items: list, has: set[str]) -> DataFrame:
        cols = set(df.columns)
        if not any(aggregated(e) for e, _ in items):
            return df.select(*(self.value(e, has, cols).alias(name) for e, name in items))
        keys = [(e, n) for e, n in items if not aggregated(e)]
        aggs = [self.value(e, has, cols).alias(n) for e, n in items if aggregated(e)]
        return df.groupBy(*(self.value(e, has, cols).alias(n) for e, n in keys)).agg(*aggs).select(*(n for _, n in items))

    def compile(self, q: Query) -> DataFrame:
        df, has = self.patterns(q)
        for items, where in q.stages:
            kept = [(e, n) for e, n in items if e == ("var", n) and n in has]
            if kept and not any(aggregated(e) for e, _ in items):
                extra = [(e, n) for e, n in items if (e, n) not in kept]
                df = df.select("*", *(self.value(e, has, set(df.columns)).alias(n) for e, n in extra))
            else:
                df, has = self.project(df, items, has), set()
            if where is not None:
                df = df.where(self.value(where, has, set(df.columns)))
        by_text = {str(e): n for e, n in q.items}
        names = {n for _, n in q.items}
        keys, extra = [], []
        for k, (e, down) in enumerate(q.order):
            name = e[1] if e[0] == "var" and e[1] in names else by_text.get(str(e))
            if name is None:
                name = f"__order{k}"
                extra.append((e, name))
            keys.append(F.col(f"`{name}`").desc_nulls_last() if down else F.col(f"`{name}`").asc_nulls_last())
        if extra and (q.distinct or any(aggregated(e) for e, _ in q.items)):
            raise GqlError("ORDER BY names a returned item")
        out = self.project(df, q.items + extra, has)
        if q.distinct:
            out = out.distinct()
        if keys:
            out = out.orderBy(*keys)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*(n for _, n in extra)) if extra else out


def run(text: str, nodes: DataFrame, edges: DataFrame, **params) -> DataFrame:
    """The result of a query; lists and values stand for its $parameters."""
    q = parse(text)
    return Compiler(nodes, edges, params, ends_suffice(q)).compile(q)
