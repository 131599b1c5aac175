"""A property graph out of the relational tables: the input of the registered graph queries.

Regions and nations are folders, customers files, orders functions, parts
classes, suppliers interfaces. The SQL uses integer arithmetic only and runs
unchanged in Spark and DuckDB; table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: name -> SQL of a step; a step may name tables and earlier steps in braces
STEPS: dict[str, str] = {}

STEPS["geo"] = "select c.c_custkey as ck, c.c_name as c_name, lower(c.c_mktsegment) as lang, c.c_nationkey as nk, r.r_name || '/' || n.n_name as folder from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey"
STEPS["lines"] = "select l_orderkey as ok, l_linenumber as ln, min(l_partkey) as pk from {lineitem} group by l_orderkey, l_linenumber"

STEPS["nexts"] = "select distinct o_orderkey as k, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from {orders}"
STEPS["pairs"] = "select distinct pk, nxt from (select pk, lead(pk) over (partition by ok order by ln) as nxt from {lines}) t where nxt is not null and nxt <> pk"

# every part has each of its edges once, by numbers, so that no text needs to be compared
STEPS["edges"] = """
select 'folder:' || r.r_name as source, 'folder:' || r.r_name || '/' || n.n_name as target, 'Contains' as edge_type from {nation} n join {region} r on n.n_regionkey = r.r_regionkey
    union all select 'folder:' || folder, 'file:c' || cast(ck as varchar(20)), 'Contains' from {geo}
    union all select 'file:c' || cast(ck as varchar(20)), 'function:o' || cast(ok as varchar(20)), 'Contains' from (select distinct o_custkey as ck, o_orderkey as ok from {orders}) t
    union all select 'class:p' || cast(pk as varchar(20)), 'function:o' || cast(ok as varchar(20)), 'Contains' from (select ok, min(pk) as pk from {lines} group by ok) t
    union all select 'function:o' || cast(k as varchar(20)), 'function:o' || cast(nxt as varchar(20)), 'Calls' from {nexts} where nxt is not null
    union all select 'class:p' || cast(pk as varchar(20)), 'class:p' || cast(nxt as varchar(20)), 'Calls' from {pairs}
    union all select 'function:o' || cast(ok as varchar(20)), 'class:p' || cast(pk as varchar(20)), 'References' from (select distinct ok, pk from {lines}) t
    union all select 'class:p' || cast(l_partkey as varchar(20)), 'interface:s' || cast(min(l_suppkey) as varchar(20)), 'Implements' from {lineitem} group by l_partkey
    union all select 'file:c' || cast(ck as varchar(20)), 'file:c' || cast(nxt as varchar(20)), 'Imports' from (select ck, lead(ck) over (partition by nk order by ck) as nxt from {geo}) t where nxt is not null and ck % 2 = 0
    union all select 'class:p' || cast(p_partkey as varchar(20)), 'class:p' || cast(prv as varchar(20)), 'Extends' from (select p_partkey, lag(p_partkey) over (partition by p_brand order by p_partkey) as prv from {part}) t where prv is not null
"""

STEPS["counts"] = "select l_orderkey as ok, count(*) as n from {lineitem} group by l_orderkey"
STEPS["symbols"] = """
select 'file:c' || cast(ck as varchar(20)) as id, c_name as name, 'File' as node_type, folder || '/c' || cast(ck as varchar(20)) as file, ck as key, ck % 400 as loc, cast(null as bigint) as params, 0 as is_test, lang as language, cast('service' as varchar(20)) as classification, folder from {geo}
    union all select 'function:o' || cast(o.o_orderkey as varchar(20)), 'order_' || cast(o.o_orderkey % 500 as varchar(20)), 'Function', g.folder || '/c' || cast(g.ck as varchar(20)), o.o_orderkey, cast(floor(o.o_totalprice / 1000) as bigint), c.n, case when o.o_orderstatus = 'P' then 1 else 0 end, g.lang, lower(o.o_orderpriority), g.folder from {orders} o join {geo} g on o.o_custkey = g.ck left join {counts} c on c.ok = o.o_orderkey
    union all select 'class:p' || cast(p_partkey as varchar(20)), p_name, 'Class', 'parts/' || p_brand || '/p' || cast(p_partkey as varchar(20)), p_partkey, cast(p_size * 3 as bigint), null, 0, 'parts', 'type', 'parts/' || p_brand from {part}
    union all select 'interface:s' || cast(s.s_suppkey as varchar(20)), s.s_name, 'Interface', 'supp/' || n.n_name || '/s' || cast(s.s_suppkey as varchar(20)), s.s_suppkey, s.s_suppkey % 90, null, 0, 'supp', 'type', 'supp/' || n.n_name from {supplier} s join {nation} n on s.s_nationkey = n.n_nationkey
"""
STEPS["facts"] = """
select id, name, node_type, file, key % 1000 + 1 as start_line, key % 1000 + coalesce(loc, 1) as end_line,
    case when key % 4 > 0 then 'about ' || name end as description,
    loc, case when loc is not null then greatest(loc - key % 7, 0) end as code_lines,
    key % 11 as comment_lines, key % 4 as doc_lines, params, case when node_type <> 'File' then key % 6 end as max_nesting,
    case when key % 4 > 0 then 1 else 0 end as has_doc, case when key % 11 > 0 or key % 4 > 0 then 1 else 0 end as has_comments, is_test,
    case when key % 13 = 0 then 1 else 0 end as boundary, case when key % 26 = 0 then 1 else 0 end as boundary_in, case when key % 13 = 0 and key % 26 <> 0 then 1 else 0 end as boundary_out,
    language, classification, folder,
    case when key % 26 = 0 then 'http.endpoint' when key % 13 = 0 then 'db.access' end as boundary_kinds,
    case when key % 26 = 0 then 'http' when key % 13 = 0 then 'jdbc' end as boundary_protocols,
    case when key % 13 = 0 then 'r' || cast(key as varchar(20)) end as boundary_detail
from {symbols}
"""
STEPS["folders"] = """
select 'folder:' || r_name as id, r_name as name, cast('' as varchar(20)) as folder from {region}
    union all select 'folder:' || r.r_name || '/' || n.n_name, n.n_name, r.r_name from {nation} n join {region} r on n.n_regionkey = r.r_regionkey
"""
STEPS["degrees"] = """
select id, sum(i) as i, sum(o) as o, sum(m) as m from (
    select target as id, 1 as i, 0 as o, 0 as m from {edges} where edge_type <> 'Contains'
    union all select source, 0, case when edge_type <> 'Contains' then 1 else 0 end, case when edge_type = 'Contains' then 1 else 0 end from {edges}
) ends group by id
"""
STEPS["every"] = """
select id, name, node_type, file, start_line, end_line, description, loc, code_lines, comment_lines, doc_lines, params, max_nesting, has_doc, has_comments, is_test, boundary, boundary_in, boundary_out, language, classification, folder, boundary_kinds, boundary_protocols, boundary_detail from {facts}
    union all select id, name, 'Folder', null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, folder, null, null, null from {folders}
"""
STEPS["nodes"] = """
select e.id, e.name, e.node_type, e.file, cast(e.start_line as bigint) as start_line, cast(e.end_line as bigint) as end_line, e.description,
    cast(e.loc as bigint) as loc, cast(e.code_lines as bigint) as code_lines, cast(e.comment_lines as bigint) as comment_lines, cast(e.doc_lines as bigint) as doc_lines, cast(e.params as bigint) as params, cast(e.max_nesting as bigint) as max_nesting,
    cast(case when e.node_type in ('Class', 'Interface') and d.m > 0 then d.m end as bigint) as members, cast(e.has_doc as bigint) as has_doc, cast(e.has_comments as bigint) as has_comments, cast(e.is_test as bigint) as is_test,
    cast(coalesce(d.i, 0) as bigint) as in_degree, cast(coalesce(d.o, 0) as bigint) as out_degree, cast(e.boundary as bigint) as boundary, cast(e.boundary_in as bigint) as boundary_in, cast(e.boundary_out as bigint) as boundary_out,
    e.language, e.classification, e.folder, cast(null as varchar(20)) as qualified_name, cast(null as varchar(20)) as route, cast(null as varchar(20)) as annotations, e.boundary_kinds, e.boundary_protocols, e.boundary_detail
from {every} e left join {degrees} d on d.id = e.id
"""

_made: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the tables in ``sf_dir``; written once for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        have = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
        for name, sql in STEPS.items():
            have[name] = spark.sql(sql, **{t: df for t, df in have.items() if "{" + t + "}" in sql})
            if name == "edges":
                # in the order of the source, so that a walk's scan skips most of what is kept; a hub's edges may lie in several parts
                have[name] = cut(have[name].repartitionByRange("source", "target").sortWithinPartitions("source", "target"))
        _made[key] = cut(have["nodes"]), have["edges"]
    return _made[key]


def forget() -> None:
    """Make the graph anew when it is asked for again."""
    _made.clear()


def oracle(sql: str) -> str:
    """The SQL of a query over ``nodes`` and ``edges`` for DuckDB: the projection stands before it."""
    plain = {t: t for t in (*TABLES, *STEPS)}
    steps = ", ".join(f"{name} as materialized ({text.format(**plain)})" for name, text in STEPS.items())
    text = sql.strip()
    for start in ("with recursive ", "with "):
        if text.lower().startswith(start):
            return f"with recursive {steps}, {text[len(start):]}"
    return f"with recursive {steps} {text}"
