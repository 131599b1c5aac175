"""Source divergence audit: how far the term shares of each source lie from those of the other sources and of its language.

Three kinds of tasks count and compare with DuckDB, all in bounded memory and
with one thread each; Spark deals the shards and merges sums and rankings.

1. Each task counts its documents' terms by (lang, source, term): occurrences
   and documents. Spark adds these counts up.
2. Shards by the hash of (lang, term) keep the terms of enough documents of
   their language. From what they write come the sizes of groups and languages.
3. The same shards, term by term, add up what each pair of sources that share
   the term contributes, and rank the terms of each group. All pairs of a
   term's sources are compared, in blocks and summed at once: the result has a
   row for each pair. Nothing is done for sources that lack a term: a source
   without it has one and the same share for all such terms, so that for every
   pair the terms of one source alone come from a table of how many terms it
   has by count, and the terms of neither from their number.

With p0 the share of a term that does not occur, the sum over all kept terms is
    terms of both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
  + terms of the group: f(p, q0)  + terms of the other: f(p0, q)
  + (V - terms of the group - terms of the other) f(p0, q0).

Defined results: null text, lang and source count as ''; groups without terms
have rows (all shares alike); a language without kept terms has pairs of value
0 and no terms; repeated rows and ids are documents of their own; sources that
differ in case or blanks are different; an empty table gives an empty result;
further columns are ignored. All numbers are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import bounded, cut, sent

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
LEAST_DOCS = 3
MOST_TERMS = 200
PIECE = 1 << 20  # bytes of a text that are taken apart at once
ROWS = 300_000  # rows that a task holds before it sums or hands them on
PAIRS = 2_000_000  # pairs of a term's sources that are compared at once
SALTS = 16

_INSIDE = np.ones(256, bool)
_INSIDE[:128] = False
_INSIDE[65:91] = _INSIDE[97:123] = True


def _database():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _pieces(offs: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of pieces of at most about PIECE bytes, cut where no term goes on, and the row of each piece."""
    borders, row = [0], []
    for i in range(len(offs) - 1):
        at, end = int(offs[i]), int(offs[i + 1])
        while end - at > PIECE:
            to = at + PIECE
            while to < end:  # one endless term stays whole
                gap = np.flatnonzero(~_INSIDE[buf[to : min(to + PIECE, end)]])
                if len(gap):
                    to += int(gap[0])
                    break
                to += PIECE
            if to >= end:
                break
            borders.append(to)
            row.append(i)
            at = to
        borders.append(end)
        row.append(i)
    return np.array(borders, np.int64), np.array(row, np.int64)


_COUNT = f"""
    insert into partial
    select d.lang, d.source, term, sum(c), count(*) from (
        select r, term, count(*) as c from (select r, unnest(regexp_extract_all(text, '{TERM}')) as term from pieces) group by r, term) t
    join docs d using (r) group by d.lang, d.source, term"""
_PARTIAL = "create or replace table partial (lang varchar, source varchar, term varchar, c bigint, d bigint)"
_COUNTS = "lang string, source string, term string, c long, d long"


def _done(con, sql: str, *values) -> list[tuple]:
    """The rows of a statement, all of them, so that the connection is free for the next."""
    return con.execute(sql, list(values)).fetchall() if values else con.execute(sql).fetchall()


def _emitted(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=20_000)


def _counted(batches):
    con, empty = _database(), True
    _done(con, _PARTIAL)
    out = "select lang, source, term, sum(c)::bigint as c, sum(d)::bigint as d from partial group by all"
    for batch in batches:
        buf, offs = wh.buffers(batch.column("text"))
        buf = wh.LOWER[buf]
        borders, row = _pieces(offs, buf)
        step = 0
        while step < len(row):  # about PIECE bytes at once, whole documents
            to = max(step + 1, int(np.searchsorted(borders, borders[step] + 4 * PIECE, "right")) - 1)
            to = int(np.searchsorted(row, row[to - 1], "right"))
            at = borders[step : to + 1]
            text = pa.LargeStringArray.from_buffers(to - step, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(buf[at[0] : at[-1]].tobytes()))
            first, last = int(row[step]), int(row[to - 1]) + 1
            con.register("pieces", pa.table({"r": row[step:to], "text": text}))
            con.register("docs", pa.table({"r": np.arange(first, last), "lang": batch.column("lang")[first:last], "source": batch.column("source")[first:last]}))
            _done(con, _COUNT)
            step, empty = to, False
            if _done(con, "select count(*) from partial")[0][0] > ROWS:
                yield from _emitted(con, out)
                _done(con, _PARTIAL)
    if not empty:
        yield from _emitted(con, out)
    con.close()


def _whole_terms(batches) -> Iterator[pa.Table]:
    """The rows, which are sorted by (lang, term), in tables that hold all rows of their terms."""
    held: list[pa.RecordBatch] = []

    def table():
        return pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            t = table()
            other = pc.or_(pc.not_equal(t["lang"], t["lang"][-1]), pc.not_equal(t["term"], t["term"][-1]))
            n = int(np.flatnonzero(other.to_numpy())[-1]) + 1 if pc.any(other).as_py() else 0
            if n:
                yield t.slice(0, n)
            held = t.slice(n).to_batches()
    if held:
        yield table()


def _kept(least):
    sql = f"""
        with s as (select lang, term, sum(c)::bigint as total, min(source) as least from t group by lang, term having sum(d) >= {least})
        select lang, source, term, c, total, (source = least)::int as leads from t join s using (lang, term) order by lang, term"""

    def run(batches):
        con = _database()
        for t in _whole_terms(batches):
            con.register("t", t)
            yield from _emitted(con, sql)
        con.close()

    return run


_P = f"(1 + ({SCALE}::hugeint * ({{c}} + 1)) // ({{n}} + v))::bigint"
_F = "(({0} - {1}) * ({0} - {1}) // {1})"
_SHARES = f"""
    create or replace table shares as
    select *, count(*) over (partition by lang, term) as m, row_number() over (order by lang, term, source) as k from (
        select lang, source, term, {_P.format(c="c", n="n")} as p, {_P.format(c="0", n="n")} as p0, {_P.format(c="total", n="nl")} as q from t) s"""
_PAIRS = f"""
    insert into pairs
    select a.lang, a.source, b.source, sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.p0")} - {_F.format("a.p0", "b.p")} + {_F.format("a.p0", "b.p0")})
    from (select * from shares where k between ? and ?) a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3"""
_BEST = "select * from best qualify row_number() over (partition by lang, source order by value desc, item) <= {0}"


def _compared(most):
    """Contributions of pairs, and each group's best terms of this shard."""

    def run(batches):
        con = _database()
        _done(con, "create table pairs (lang varchar, source varchar, item varchar, value hugeint)")
        _done(con, "create table best (lang varchar, source varchar, item varchar, value bigint)")
        out = "select 'pair' as part, lang, source, item, sum(value)::decimal(38, 0) as value from pairs group by all"
        for t in _whole_terms(batches):
            con.register("t", t)
            _done(con, _SHARES)
            _done(con, f"insert into best select lang, source, term, {_F.format('p', 'q')} from shares where p > q")
            _done(con, f"create or replace table best as {_BEST.format(most)}")
            m = con.sql("select m from shares order by k").to_arrow_table()["m"].to_numpy()
            work, at = np.cumsum(m), 0
            while at < len(m):  # blocks of rows whose pairs are few enough
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + PAIRS, "right")))
                _done(con, _PAIRS, at + 1, to)
                at = to
                if _done(con, "select count(*) from pairs")[0][0] > ROWS:
                    yield from _emitted(con, out)
                    _done(con, "delete from pairs")
        yield from _emitted(con, out)
        yield from _emitted(con, "select 'term' as part, lang, source, item, value::decimal(38, 0) as value from best")
        con.close()

    return run


def _share(c: str, n: str) -> str:
    """p, as a SQL expression; null without kept terms."""
    return f"(1 + ({SCALE} * (cast({c} as decimal(27, 0)) + 1)) div nullif({n} + v, 0))"


def _far(p: str, q: str) -> str:
    return f"cast((({p} - {q}) * ({p} - {q})) div {q} as decimal(38, 0))"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c occurrences, d documents."""
    bounded(docs.sparkSession)
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*columns).mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _sharded(df: DataFrame) -> DataFrame:
    return df.repartition("lang", "term").sortWithinPartitions("lang", "term")


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = cut(_sharded(term_counts(docs)).mapInArrow(_kept(least), "lang string, source string, term string, c long, total long, leads int"))
    occurring = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("c").alias("terms"), F.sum("leads").alias("leads"))
    sizes = occurring.join(sizes, ["lang", "source"], "left").na.fill(0)
    languages = sizes.groupBy("lang").agg(F.sum("n").alias("nl"), F.sum("leads").alias("v"))
    # the shares of terms that a group lacks are the same for all of them
    groups = cut(sizes.join(languages, "lang").selectExpr("lang", "source", "n", "terms", "nl", "v", _share("0", "n") + " as p0"))
    few = sent(groups)
    rows = kept.join(few.select("lang", "source", "n", "nl", "v"), ["lang", "source"])
    if few is groups:  # too many to be sent: the shards are dealt once more
        rows = _sharded(rows)
    found = cut(rows.select("lang", "source", "term", "c", "total", "n", "nl", "v").mapInArrow(_compared(most), "part string, lang string, source string, item string, value decimal(38,0)"))

    other = few.selectExpr("lang", "source as item", "p0 as q0", "terms as other_terms")
    by_count = kept.groupBy("lang", "source", "c").agg(F.count("c").alias("times")).join(few, ["lang", "source"]).selectExpr("lang", "source", "times", "p0", _share("c", "n") + " as p")
    alone = by_count.join(other, "lang").where("source <> item").selectExpr(
        "lang", f"inline(array(named_struct('source', source, 'item', item, 'value', times * {_far('p', 'q0')}), named_struct('source', item, 'item', source, 'value', times * {_far('q0', 'p')})))"
    )
    neither = groups.join(other, "lang").where("source <> item").selectExpr("lang", "source", "item", f"coalesce((v - terms - other_terms) * {_far('p0', 'q0')}, 0) as value")
    wide = [c.selectExpr("lang", "source", "item", "cast(value as decimal(38, 0)) as value") for c in (neither, alone, found.where("part = 'pair'"))]
    pairs = wide[0].unionByName(wide[1]).unionByName(wide[2]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank"))

    terms = found.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    for key in (["lang", "source", "salt"], ["lang", "source"]):  # a hot group's terms are ranked in parts first
        terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)
    return pairs.unionByName(terms.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"))


def sql(least: int = LEAST_DOCS, most: int = MOST_TERMS) -> str:
    """DuckDB SQL of ``audit`` over ``documents``: every pair over every kept term."""
    p = f"1 + ({SCALE}::hugeint * ({{0}} + 1)) // ({{1}} + v)"
    lower = "translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        with d as materialized (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        w as materialized (select r, lang, source, {lower} as term from (select r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) as term from d) t),
        kept as materialized (select lang, term, count(*) as total from w group by lang, term having count(distinct r) >= {least}),
        size as (select lang, count(*) as v, sum(total) as nl from kept group by lang),
        groups as materialized (select distinct lang, source from d),
        counts as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
        every as (select g.lang, g.source, k.term, k.total, coalesce(c.c, 0) as c from groups g join kept k using (lang) left join counts c using (lang, source, term)),
        n as (select lang, source, sum(c) as n from every group by all),
        shares as materialized (select lang, source, term, c, {p.format("c", "n")} as p, {p.format("total", "nl")} as q from every join n using (lang, source) join size using (lang)),
        pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        found as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value from groups g join groups h on g.lang = h.lang and g.source <> h.source left join pairs p on p.lang = g.lang and p.source = g.source and p.item = h.source
            union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from shares where c > 0 and p > q)
        select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found) t where part = 'pair' or rank <= {most}"""
