"""Registered queries of the operators besides the presets, with their DuckDB counterparts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import classify, globs, text
from ..operators import graph as g
from ..operators import retrieval as r
from ..operators import facts, resolve, tools
from ..operators.reach import bfs
from ..schema import EDGE_WEIGHTS, PROPERTIES, USAGE_EDGES
from ..session import shared_dir
from ..sources import tables
from ..sources.delta import DeltaGraph, weight_of
from ..sources.inverted import InvertedIndex
from ..sources.vector_index import VectorIndex
from ..streaming import incremental
from . import gql
from .projection import graph, oracle

c = F.col
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, over_graph: bool = True, name: str | None = None):
    """Register a query; ``sql`` is its counterpart over nodes and edges, or over the tables."""

    def add(run):
        key = name or run.__name__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = oracle(sql) if over_graph else sql
        return run

    return add


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


_STEP_OUT = "st as (select source as src, target as dst, edge_type from edges)"
_BOTH = "st as (select source as src, target as dst, edge_type from edges union all select target, source, edge_type from edges)"


def _bfs_sql(seeds: str, hops: int, step: str, types: str = "") -> str:
    where = f" and st.edge_type in ({types})" if types else ""
    return f"with recursive {step}, walk(id, d) as ({seeds} union select st.dst, d + 1 from walk join st on st.src = walk.id{where} where d < {hops}), found as (select id, min(d) as distance from walk group by id)"


# -- filters and joins ---------------------------------------------------------------------


@query("select * from edges where lower(edge_type) in ('calls', 'imports')")
def filter_edges_by_type(spark, sf):
    return g.filter_edges_by_type(graph(spark, sf)[1], ["CALLS", "Imports"])


@query("select id, name from nodes where node_type = 'Function' and (lower(name) like '%order_1%' or lower(description) like '%order_1%')")
def keyword_search(spark, sf):
    return r.keyword_search(graph(spark, sf)[0], "ORDER_1", ["Function"]).select("id", "name")


@query("select id, row_number() over (order by id) as distance from (select id from nodes where name like '%order\\_4%' escape '\\' order by id limit 20) t")
def name_search(spark, sf):
    return r.name_search(graph(spark, sf)[0], "order_4", 20)


@query("select node_type, count(*) as n from nodes where node_type in ('Class', 'File') group by 1")
def legacy_where(spark, sf):
    return legacy_filter(graph(spark, sf)[0], "node_type IN ('Class', 'File')").groupBy("node_type").agg(F.count("*").alias("n"))


def legacy_filter(nodes, clause: str | None):
    """``node_type = 'X'``, ``node_type IN (...)`` or ``file LIKE '...'``; any other clause is no filter."""
    clause = (clause or "").strip()
    if m := re.fullmatch(r"(?i)node_type\s*=\s*'([^']*)'", clause):
        return nodes.where(c("node_type") == m[1])
    if m := re.fullmatch(r"(?i)node_type\s+in\s*\(([^)]*)\)", clause):
        return nodes.where(c("node_type").isin(*re.findall(r"'([^']*)'", m[1])))
    if m := re.fullmatch(r"(?i)file\s+like\s+'([^']*)'", clause):
        return nodes.where(c("file").like(m[1]))
    return nodes


@query("select id from nodes where regexp_full_match(file, '(?i)parts/[^/]*/p1[^/]*')")
def glob_match(spark, sf):
    return graph(spark, sf)[0].where(globs.matches(c("file"), "parts/*/P1*", path=True)).select("id")


@query("select case when name = 'order_1' then 0 when starts_with(name, 'order_1') then 1 when name like '%order\\_1%' escape '\\' then 2 when lower(description) like '%order\\_1%' escape '\\' then 3 else 4 end as rank, count(*) as n from nodes group by 1")
def literal_rank(spark, sf):
    return graph(spark, sf)[0].groupBy(text.literal_rank("name", "description", "Order_1").alias("rank")).agg(F.count("*").alias("n"))


@query("select id, file from nodes where starts_with(lower(file), 'a')")
def path_filter(spark, sf):
    return graph(spark, sf)[0].where(globs.path_filter(c("file"), "A")).select("id", "file")


@query("select e.edge_type, a.node_type as source_type, b.node_type as target_type, count(*) as n from edges e join nodes a on a.id = e.source join nodes b on b.id = e.target group by 1, 2, 3")
def endpoint_join(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.endpoint_join(edges, nodes).groupBy("edge_type", "source_type", "target_type").agg(F.count("*").alias("n"))


@query("select t.id, coalesce(n.name, '(unknown node)') as name from (select distinct target as id from edges where edge_type = 'Implements' union all select 'nowhere') t left join nodes n on n.id = t.id")
def lookup_outer(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.lookup_outer(edges.where("edge_type = 'Implements'").select(c("target").alias("id")).distinct().unionByName(_seed(spark, "nowhere")), nodes)


_SET = "(select id from nodes where id like 'class:p1%')"


@query(f"select * from edges where source in {_SET} and target in {_SET}")
def induced(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.induced(edges, nodes.where(c("id").startswith("class:p1")))


@query(f"select distinct * from edges where source in {_SET} or target in {_SET}")
def incident(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.incident(edges, nodes.where(c("id").startswith("class:p1")))


@query(f"select distinct * from edges where source in {_SET} and target in {_SET} and source <> target")
def candidate_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.candidate_edges(edges, nodes.where(c("id").startswith("class:p1")))


# -- walks ---------------------------------------------------------------------------------


@query(_bfs_sql("select 'function:o1' as id, 0 as d", 3, _STEP_OUT) + " select id, distance from found")
def k_hop_bfs(spark, sf):
    return g.k_hop(graph(spark, sf)[1], "function:o1", 3)


_SEEDS = "select id, 0 as d from nodes where id in ('class:p1', 'function:o1')"


@query(_bfs_sql(_SEEDS, 2, _BOTH, "'Calls', 'References'") + " select id, distance from found")
def traverse(spark, sf):
    return g.traverse(graph(spark, sf)[1], _seed(spark, "class:p1", "function:o1"), 2, ("Calls", "References"), "both")[0]


@query(_bfs_sql(_SEEDS, 2, _STEP_OUT, "'Calls', 'References'") + " select distinct e.* from edges e join found f on f.id = e.source where f.distance < 2 and e.edge_type in ('Calls', 'References')")
def traverse_edges(spark, sf):
    return g.traverse(graph(spark, sf)[1], _seed(spark, "class:p1", "function:o1"), 2, ("Calls", "References"), "out")[1]


_USAGE = ", ".join(f"'{t}'" for t in USAGE_EDGES)


@query(
    f"with recursive st as (select target as src, source as dst, edge_type from edges where edge_type in ({_USAGE})), walk(id, d) as (select 'interface:s1', 0 union select st.dst, d + 1 from walk join st on st.src = walk.id where d < 2),"
    f" found as (select id, min(d) as distance from walk group by id), via as (select e.source as id, f.distance, e.edge_type, e.target, row_number() over (partition by e.source order by e.edge_type, e.target) as r from edges e join found t on t.id = e.target join found f on f.id = e.source where f.distance = t.distance + 1 and e.edge_type in ({_USAGE}))"
    " select id, distance, edge_type as via_edge, target as via_target from via where r = 1"
)
def find_usages(spark, sf):
    return g.find_usages(graph(spark, sf)[1], _seed(spark, "interface:s1"), 2)


@query(_bfs_sql("select 'file:c2' as id, 0 as d", 6, _STEP_OUT) + " select distance as length from found where id = 'interface:s1'")
def shortest_path(spark, sf):
    path = g.shortest_path(graph(spark, sf)[1], "file:c2", "interface:s1", True, 6)
    return spark.createDataFrame([(len(path) - 1,)] if path else [], "length int")


@query(_bfs_sql("select 'class:p1' as id, 0 as d", 3, _STEP_OUT) + " select f.distance + 1 as hop, st.edge_type, count(*) as n from found f join st on st.src = f.id where f.distance < 3 group by 1, 2")
def walk_layers(spark, sf):
    return g.walk_layers(graph(spark, sf)[1], "class:p1", 3, stop_after=10**9)


# -- measures and reports ------------------------------------------------------------------

_DEGREE = "deg as (select id, count(*) as degree from (select source as id from edges union all select target from edges) t group by id)"


@query(f"with {_DEGREE} select n.id, coalesce(d.degree, 0) as degree, coalesce(d.degree, 0) / cast((select count(*) - 1 from nodes) as double) as centrality from nodes n left join deg d on d.id = n.id")
def degree_centrality(spark, sf):
    return g.degree_centrality(*graph(spark, sf))


@query(f"with {_DEGREE} select id, degree from deg order by degree desc, id limit 10")
def top_hubs(spark, sf):
    return g.top_hubs(*graph(spark, sf))


@query()
def betweenness(spark, sf):
    nodes, edges = graph(spark, sf)
    return g.betweenness(nodes.where("node_type in ('Class', 'Interface')"), edges, ("Extends", "Implements"))


# every import leads to a greater key, so the count of those that don't is the count of cycles: none
@query("select count(*) as n from edges where edge_type = 'Imports' and cast(substring(target, 7) as bigint) <= cast(substring(source, 7) as bigint)")
def import_cycles(spark, sf):
    return g.cycles(graph(spark, sf)[1], ("Imports",)).limit(1).agg(F.count("*").alias("n"))


@query()
def cycles(spark, sf):
    return g.cycles(graph(spark, sf)[1], ("Calls",))


# a customer's orders follow each other by key, in one chain; the last leads back to the first where the customer's key is even, and to the
# one in the middle where it leaves 1 by 4; every order of a key divisible by 4 that is not the first leads on to the last as well
_ORDER_EDGES = """select 'order:' || lpad(o_orderkey, 12, '0') as source, 'order:' || lpad(to_key, 12, '0') as target, 'Follows' as edge_type from (
 select o_custkey, o_orderkey, r, n, case way when 1 then next_key when 2 then back_key else last_key end as to_key from (
  select *, case when r < n then null when o_custkey % 2 = 0 then first_key when o_custkey % 4 = 1 then middle_key end as back_key,
   max(case when r = n then o_orderkey end) over (partition by o_custkey) as last_key from (
   select *, first_value(o_orderkey) over (partition by o_custkey order by r) as first_key,
    max(case when r = (n + 1) div 2 then o_orderkey end) over (partition by o_custkey) as middle_key from (
    select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r, count(*) over (partition by o_custkey) as n,
     lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as next_key from orders))) cross join (select explode(array(1, 2, 3)) as way)
 where way < 3 or (r > 1 and r < n and o_orderkey % 4 = 0)) where to_key is not null"""


@query(
    """with o as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r, count(*) over (partition by o_custkey) as n from orders),
 kept as (select * from o where k % 2 = 0 or (k % 4 = 1 and r >= (n + 1) // 2))
 select 'order:' || lpad(min(o_orderkey) over (partition by k)::varchar, 12, '0') as component, 'order:' || lpad(o_orderkey::varchar, 12, '0') as id, count(*) over (partition by k) as length from kept""",
    over_graph=False,
)
def order_cycles(spark, sf):
    """Cycles among all orders: rings, chains that end in a ring, and chains without one."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return g.cycles(spark.sql(_ORDER_EDGES.replace("from orders)", "from {orders})"), orders=orders))


def _ppr_sql(rounds: int) -> str:
    weight = "case edge_type " + " ".join(f"when '{k}' then {v}" for k, v in EDGE_WEIGHTS.items()) + " else 0.5 end"
    out = f"with raw as (select source as src, target as dst, sum(cast({weight} as double)) as w from edges group by 1, 2), st as materialized (select src, dst, w / sum(w) over (partition by src) as w from raw), seed as (select * from (values ('class:p1', cast(0.5 as double)), ('function:o1', cast(0.5 as double))) v(id, s)), r0 as (select id, s as score from seed)"
    for k in range(1, rounds + 1):
        out += f", m{k} as materialized (select st.dst as id, sum(r.score * st.w * 0.85) as score from r{k - 1} r join st on st.src = r.id group by 1), r{k} as materialized (select id, sum(score) as score from (select * from m{k} union all select id, s * (select 1 - coalesce(sum(score), 0) from m{k}) from seed) t group by id)"
    return out + f" select id, round(score, 9) as score from r{rounds}"


@query(_ppr_sql(4))
def personalized_pagerank(spark, sf):
    out = g.personalized_pagerank(graph(spark, sf)[1], ["class:p1", "function:o1"], iterations=4)
    return out.select("id", F.round("score", 9).alias("score"))


@query("select node_type, count(*) as n from nodes group by 1 order by n desc, 1 limit 3")
def type_counts(spark, sf):
    return g.type_counts(graph(spark, sf)[0], 3)


@query("select edge_type, source_type, target_type, n from (select edge_type, coalesce(a.node_type, '?') as source_type, coalesce(b.node_type, '?') as target_type, count(*) as n, row_number() over (partition by edge_type order by count(*) desc, coalesce(a.node_type, '?'), coalesce(b.node_type, '?')) as r from edges e left join nodes a on a.id = e.source left join nodes b on b.id = e.target group by 1, 2, 3) t where r <= 4")
def graph_schema(spark, sf):
    return g.edge_shapes(*graph(spark, sf))


@query("select 'node' as kind, node_type as name, count(*) as n from nodes group by 2 union all select 'edge', edge_type, count(*) from edges group by 2")
def graph_stats(spark, sf):
    return g.graph_stats(*graph(spark, sf))


@query(
    "select section, name, n, rank from (select *, row_number() over (partition by section order by n desc, name) as rank from ("
    "select 'totals' as section, 'nodes' as name, count(*) as n from nodes union all select 'totals', 'edges', count(*) from edges union all select 'types', node_type, count(*) from nodes group by 2"
    " union all select 'files', file, count(*) from nodes where node_type not in ('File', 'Folder') and file <> '' group by 2 union all select 'hotspots', id, in_degree from nodes where node_type not in ('File', 'Folder') union all select 'longest', id, loc from nodes where node_type not in ('File', 'Folder') and loc is not null) t) u"
    " where rank <= case section when 'hotspots' then 12 else 10 end"
)
def project_overview(spark, sf):
    return g.project_overview(*graph(spark, sf))


@query(
    "with recursive inside as (select target as id, min(source) as parent from edges where edge_type = 'Contains' group by 1), walk(id, d) as (select n.id, 0 from nodes n where n.node_type in ('Folder', 'File') and n.id not in (select id from inside) union select e.target, d + 1 from walk w join edges e on e.source = w.id and e.edge_type = 'Contains' where d < 8)"
    " select w.id, i.parent, min(w.d) as distance from walk w left join inside i on i.id = w.id group by 1, 2"
)
def catalog_tree(spark, sf):
    return g.catalog_tree(*graph(spark, sf))


@query(
    "with t as (select node_type, row_number() over (order by node_type) - 1 as type_code from (select distinct node_type from nodes) x), deg as (select id, count(*) as degree from (select source as id from edges union all select target from edges where source <> target) y group by id)"
    " select n.id, n.name, t.type_code, n.file, n.start_line, coalesce(d.degree, 0) as degree from nodes n join t on t.node_type = n.node_type left join deg d on d.id = n.id"
)
def slim_index(spark, sf):
    return g.slim_index(*graph(spark, sf))


@query("select count(*) as nodes, " + ", ".join(f"count({p}) as {p}" for p in PROPERTIES) + " from nodes")
def coverage(spark, sf):
    nodes = graph(spark, sf)[0]
    return nodes.agg(F.count("*").alias("nodes"), *(F.count(p).alias(p) for p in PROPERTIES))


@query("select file, count(*) as n from nodes where node_type = 'Function' and loc > 50 group by file order by n desc, file limit 15")
def by_file_summary(spark, sf):
    return graph(spark, sf)[0].where("node_type = 'Function' and loc > 50").groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(15)


@query("select node_type, quantile_disc(loc, 0.5) as p50, quantile_disc(loc, 0.9) as p90, quantile_disc(loc, 0.99) as p99, max(loc) as most from nodes where loc is not null group by 1")
def percentiles(spark, sf):
    q = lambda x: F.expr(f"percentile_disc({x}) within group (order by loc)")
    return graph(spark, sf)[0].where("loc is not null").groupBy("node_type").agg(q(0.5).cast("long").alias("p50"), q(0.9).cast("long").alias("p90"), q(0.99).cast("long").alias("p99"), F.max("loc").alias("most"))


@query("select n.id, (select count(*) from edges e where e.target = n.id and e.edge_type <> 'Contains') as in_degree, (select count(*) from edges e where e.source = n.id and e.edge_type <> 'Contains') as out_degree, nullif(case when n.node_type in ('Class', 'Interface') then (select count(*) from edges e where e.source = n.id and e.edge_type = 'Contains') end, 0) as members from nodes n")
def degree_facts(spark, sf):
    return facts.degree_facts(*graph(spark, sf))


@query("select boundary_kinds as kind, count(*) as n from nodes where boundary_kinds is not null group by 1")
def boundary_kind_counts(spark, sf):
    kinds = graph(spark, sf)[0].select(F.explode(F.split("boundary_kinds", ",")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


# -- retrieval -----------------------------------------------------------------------------

_TOKENS = "tok as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as token from documents), kept as (select * from tok where strlen(token) between 2 and 32)"
_POST = "post as materialized (select id, token, count(*) * 2.2 / (count(*) + 1.2) as w from kept group by 1, 2), total as (select count(*) as n from documents), df as materialized (select token, count(*) as df from post group by 1), idf as materialized (select token, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from df, total)"
_QTOK = "qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as token from benchmark), q as (select qt.query_id, qt.token, count(*) * coalesce(max(idf.idf), (select ln(1 + (n - 0.5) / 1.5) from total)) as qw from qt left join idf on idf.token = qt.token where strlen(qt.token) between 2 and 32 group by 1, 2)"
_BM25 = f"{_TOKENS}, {_POST}, {_QTOK}, scored as (select q.query_id, p.id, round(sum(q.qw * p.w), 9) as score from q join post p on p.token = q.token group by 1, 2), sparse as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored)"
_VEC = "qv as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0), dense as (select *, row_number() over (partition by query_id order by score desc, id) as rank from (select qv.query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], qv.v), 9) as score from embeddings e, qv) t)"


def _lower_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(c("doc_id").alias("id"), F.lower("text").alias("text"))


_indexes: dict[tuple[str, str, str], InvertedIndex | VectorIndex | DeltaGraph] = {}  # what the queries of a session have stored


def _kept_index(spark, sf, kind, batches) -> InvertedIndex:
    """The index of this session, built the first time; ``batches`` are the arguments of ``apply``."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _indexes:
        index = InvertedIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "long")
        for batch in batches:
            index.apply(*batch)
        _indexes[key] = index
    return _indexes[key]


def stored_index(spark, sf) -> InvertedIndex:
    return _kept_index(spark, sf, "documents", [("documents", _lower_docs(spark, sf))])


def _changed_index(spark, sf) -> InvertedIndex:
    docs = _lower_docs(spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.lower(F.concat_ws(" ", F.sort_array(F.collect_list("text")))).alias("text"))
    strangers = turns.select((-1 - c("conv_id")).alias("id"), "text")
    first = docs.select("id", F.when(c("id") % 2 == 0, F.concat("text", F.lit(" earlier words"))).otherwise(F.lit("another text")).alias("text"))
    batches = [("first", first), ("strangers", strangers), ("texts", docs), ("strangers go", docs.limit(0), strangers.select("id")), ("first", first), ("texts again", docs)]
    return _kept_index(spark, sf, "changed", batches)


def _query_texts(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(c("item_id").alias("query_id"), F.lower("text").alias("text"))


def _vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(c("vec_id").alias("id"), c("embedding").alias("vector"))


def _query_vectors(spark, sf):
    return _vectors(spark, sf).where("id % 50 = 0").withColumnRenamed("id", "query_id")


@query(f"with {_TOKENS} select id, token, count(*) as n from kept group by 1, 2", over_graph=False)
def tokenize(spark, sf):
    return _lower_docs(spark, sf).select("id", F.explode(text.tokenize("text")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


@query(f"with {_TOKENS}, {_POST} select token, df, round(idf, 9) as idf from idf", over_graph=False)
def doc_frequency(spark, sf):
    index = stored_index(spark, sf)
    df = index.document_frequency()
    return df.join(r.idf(df, index.documents), "token").select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"with {_TOKENS}, {_POST} select id, token, round(w, 9) as w from post", over_graph=False)
def sparse_doc_vector(spark, sf):
    return r.postings(_lower_docs(spark, sf)).select("id", "token", F.round("w", 9).alias("w"))


@query(f"with {_BM25} select query_id, id, score, rank from sparse where rank <= 10", over_graph=False)
def bm25_score(spark, sf):
    return stored_index(spark, sf).bm25(_query_texts(spark, sf), 10)


@query(f"with {_BM25} select query_id, id, score, rank from sparse where rank <= 10", over_graph=False)
def bm25_scan(spark, sf):
    """The same without a stored index."""
    docs = _lower_docs(spark, sf)
    return r.bm25(r.postings(docs), _query_texts(spark, sf), docs.count(), 10)


@query(f"with {_BM25} select query_id, id, score, rank from sparse where rank <= 10", over_graph=False)
def bm25_after_changes(spark, sf):
    """The index that has taken other texts first, then changes, additions and removals, one batch of them twice, gives what a fresh one gives."""
    return _changed_index(spark, sf).bm25(_query_texts(spark, sf), 10)


@query(f"with {_TOKENS}, {_POST} select token, df from df", over_graph=False)
def df_after_changes(spark, sf):
    return _changed_index(spark, sf).document_frequency()


@query(f"with {_TOKENS}, {_POST} select id, token, round(w, 9) as w from post", over_graph=False)
def postings_after_changes(spark, sf):
    return _changed_index(spark, sf).postings().select("id", "token", F.round("w", 9).alias("w"))


@query(f"with {_VEC} select query_id, id, score, rank from dense where rank <= 10", over_graph=False)
def vector_search(spark, sf):
    return r.vector_search(_vectors(spark, sf), _query_vectors(spark, sf), 10)


def _stored_vectors(spark, sf) -> VectorIndex:
    """The index of this session: built on one half of the vectors turned about, which the second batch replaces with all of them as they are; strangers come and go."""
    key = (spark.sparkContext.applicationId, sf, "vectors")
    if key not in _indexes:
        vectors = _vectors(spark, sf)
        turned = vectors.select("id", F.when(c("id") % 2 == 0, F.transform("vector", lambda x: -x)).otherwise(c("vector")).alias("vector"))
        index = VectorIndex.build(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", turned, "first")
        strangers = vectors.select((-1 - c("id")).alias("id"), "vector")
        index.apply("strangers", strangers)
        index.apply("as they are", vectors, strangers.select("id"))
        index.apply("strangers", strangers)
        _indexes[key] = index
    return _indexes[key]


@query(over_graph=False)
def vector_index_search(spark, sf):
    """Approximate; tests measure its recall against ``vector_search``."""
    return _stored_vectors(spark, sf).search(_query_vectors(spark, sf), 10)


@query(f"with {_VEC} select query_id, id, score, rank from dense where rank <= 10", over_graph=False)
def vector_index_all_cells(spark, sf):
    """All cells probed: the exact rows."""
    index = _stored_vectors(spark, sf)
    return index.search(_query_vectors(spark, sf), 10, len(index.centroids))


_FUSED = f"with {_BM25}, {_VEC}, fused as (select query_id, id, sum(1.0 / (60 + rank)) as score from (select query_id, id, rank from sparse where rank <= 40 union all select query_id, id, rank from dense where rank <= 40) t group by 1, 2), ranked as (select *, row_number() over (partition by query_id order by score desc, id) as rank from fused)"


def _hybrid(spark, sf, k=10):
    pool = max(4 * k, 20)
    return r.rrf(r.vector_search(_vectors(spark, sf), _query_vectors(spark, sf), pool), stored_index(spark, sf).bm25(_query_texts(spark, sf), pool), k=k)


@query(_FUSED + " select query_id, id, round(score, 9) as score, rank from ranked where rank <= 10", over_graph=False)
def hybrid_search(spark, sf):
    return _hybrid(spark, sf).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(f"with {_VEC}, b as (select d.query_id, d.id, d.rank, length(t.text) as chars, sum(length(t.text)) over (partition by d.query_id order by d.rank) as used from dense d join documents t on t.doc_id = d.id where d.rank <= 10) select query_id, id, rank from b where used <= 12000 or rank = 1", over_graph=False)
def char_budget(spark, sf):
    sizes = spark.read.parquet(f"{sf}/documents.parquet").select(c("doc_id").alias("id"), F.length("text").alias("chars"))
    found = r.vector_search(_vectors(spark, sf), _query_vectors(spark, sf), 10).join(sizes, "id")
    return r.char_budget(found, 12000, 10).select("query_id", "id", "rank")


@query(f"with {_VEC}, x as (select d.query_id, d.id, d.rank, e.label, row_number() over (partition by d.query_id, e.label order by d.rank) as inner_rank from dense d join embeddings e on e.vec_id = d.id where d.rank <= 20) select query_id, id, rank, label, row_number() over (partition by query_id order by case when inner_rank > 2 then 1 else 0 end, rank) as place from x", over_graph=False)
def diversify(spark, sf):
    labels = spark.read.parquet(f"{sf}/embeddings.parquet").select(c("vec_id").alias("id"), "label")
    found = r.vector_search(_vectors(spark, sf), _query_vectors(spark, sf), 20).join(labels, "id").select("query_id", "id", "rank", "label")
    return r.diversify(found, "label")


@query(
    f"with {_VEC}, b as (select d.query_id, d.rank, '[#' || d.rank || '] d' || d.id || ' (' || t.source || ':' || d.rank || ')' || chr(10) || t.text as block from dense d join documents t on t.doc_id = d.id where d.rank <= 8),"
    " u as (select *, sum(length(block) + 2) over (partition by query_id order by rank) as total from b), o as (select query_id, min(rank) filter (where total > 12000 and rank > 1) as over_rank from u group by 1)"
    " select u.query_id, string_agg(block, chr(10) || chr(10) order by rank) as context, count(*)::int as used from u join o on o.query_id = u.query_id where over_rank is null or rank < over_rank group by 1",
    over_graph=False,
)
def rag_context(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(c("doc_id").alias("id"), F.concat(F.lit("d"), c("doc_id").cast("string")).alias("name"), c("source").alias("file"), "text")
    found = r.vector_search(_vectors(spark, sf), _query_vectors(spark, sf), 8).join(docs, "id")
    return r.rag_context(found.select("query_id", "rank", "name", "file", c("rank").alias("start_line"), "text"), 12_000)


@query(over_graph=False)
def mmr_rerank(spark, sf):
    vectors, queries = _vectors(spark, sf), _query_vectors(spark, sf)
    found = r.vector_search(vectors, queries, 40).join(vectors, "id").join(queries.select("query_id", c("vector").alias("query")), "query_id")
    return r.mmr(found.select("query_id", "id", "vector", "query"), k=10)


@query()
def search_kb(spark, sf):
    nodes, edges = graph(spark, sf)
    seeds = r.name_search(nodes, "order_4", 8).select("id", c("distance").alias("rank"), F.lit(0).alias("dense"))
    return r.search_kb(seeds, nodes, edges, 10, iterations=5)


@query("with b as (select source as id, target as other from edges union all select target, source from edges), x as (select distinct b.id, n.name from b join nodes n on n.id = b.other), y as (select *, row_number() over (partition by id order by name) as r from x where id like 'interface%') select id, string_agg(name, '|' order by name) as related from y where r <= 128 group by 1")
def related_names(spark, sf):
    nodes, edges = graph(spark, sf)
    return r.related_names(nodes, edges).where(c("id").startswith("interface")).select("id", F.array_join("related", "|").alias("related"))


@query("with b as (select source as id, target as other from edges union all select target, source from edges), x as (select distinct b.id, n.name from b join nodes n on n.id = b.other) select id, string_agg(name, '|' order by name) as related from x group by 1")
def related_names_all(spark, sf):
    return r.related_names(*graph(spark, sf), cap=None).select("id", F.array_join("related", "|").alias("related"))


@query("with t as (select *, sum(length(text)) over (partition by conv_id order by turn desc, role desc rows between unbounded preceding and current row) as used, row_number() over (partition by conv_id order by turn desc, role desc) as back from conversations) select conv_id, count(*) as turns, cast(sum(length(text)) as bigint) as chars, string_agg(role, ',' order by turn, role, text) as roles from t where used <= 2000 or back = 1 group by 1", over_graph=False)
def rag_messages(spark, sf):
    out = r.rag_messages(spark.read.parquet(f"{sf}/conversations.parquet"))
    return out.select("conv_id", F.size("messages").cast("long").alias("turns"), "chars", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


# -- scalar functions ----------------------------------------------------------------------


@query("select p_partkey, list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(range(1, strlen(p_name) + 1), lambda i: cast(ascii(substring(p_name, i, 1)) as bigint))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as h from part", over_graph=False)
def fnv1a_32(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.fnv1a_32("p_name").alias("h"))


@query()
def split_identifier(spark, sf):
    return graph(spark, sf)[0].select("id", text.split_identifier("name").alias("words"), text.humanize_identifier("name").alias("plain"))


@query("select id, regexp_extract(file, '^(.*)/[^/]*$', 1) as folder, coalesce(loc, case when end_line >= start_line then end_line - start_line + 1 end) as loc, case when regexp_full_match(name, '[\\p{Lu}\\p{N}_]+') and regexp_matches(name, '\\p{Lu}') then true else false end as constant, case when length(name) > 12 then substring(name, 1, 11) || '…' else name end as short from nodes where file is not null")
def scalar_facts(spark, sf):
    n = graph(spark, sf)[0].where("file is not null")
    return n.select("id", text.folder_of("file").alias("folder"), text.span_loc("loc", "start_line", "end_line").alias("loc"), text.looks_like_constant("name").alias("constant"), text.truncate_chars("name", 12).alias("short"))


@query("select p_partkey, coalesce(least(greatest(floor(p_size * 3.7 * 40 - 750), 500), 8000), 1500)::bigint as chars from part", over_graph=False)
def embed_budget(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.embed_budget(c("p_size") * 40).alias("chars"))


@query("with l as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as link from pages) select link, count(*) as n, regexp_extract(regexp_replace(link, '^[a-z]+://', ''), '^(@[^/]+/[^/]+|[^/]+)', 1) as root from l group by 1, 3", over_graph=False)
def dependency_join(spark, sf):
    links = tables.html_links(spark.read.parquet(f"{sf}/pages.parquet"))
    return links.groupBy("link", text.dependency_root(F.regexp_replace("link", "^[a-z]+://", "")).alias("root")).agg(F.count("*").alias("n"))


@query(over_graph=False)
def normalize_path(spark, sf):
    links = tables.html_links(spark.read.parquet(f"{sf}/pages.parquet"))
    return links.select("page_id", "link", text.normalize_path("link").alias("path"), text.resolve_relative(F.lit("a/b/c.html"), "link").alias("full"))


@query("select page_id, sha256(html) as hash from pages", over_graph=False)
def hash_file(spark, sf):
    return tables.content_hash(spark.read.parquet(f"{sf}/pages.parquet").select(c("page_id").alias("path"), "html"), "html").withColumnRenamed("path", "page_id")


@query("select id, node_type || ': ' || name || '. ' || description as node_text from nodes where node_type = 'Interface' and description is not null")
def node_text(spark, sf):
    n = graph(spark, sf)[0].where("node_type = 'Interface' and description is not null").withColumn("related", F.array().cast("array<string>"))
    plain = text.node_text("node_type", "name", "description", F.lit(None).cast("string"), "related")
    return n.select("id", F.regexp_replace(plain, r" \([^)]*\)\.", ".").alias("node_text"))


@query("select folder, count(*) as files, case when contains(folder, '/') then split_part(folder, '/', 1) else '' end as parent, len(string_split(folder, '/')) as depth from (select unnest([split_part(file, '/', 1), split_part(file, '/', 1) || '/' || split_part(file, '/', 2)]) as folder from nodes where node_type = 'File') t group by 1")
def extract_folders(spark, sf):
    files = graph(spark, sf)[0].where("node_type = 'File'").select(c("file").alias("path"), "language")
    return tables.folders(files).select("folder", "files", "parent", "depth")


# -- incremental ---------------------------------------------------------------------------


@query(
    "with old as (select id, name as t, loc from nodes where loc is not null and loc % 10 <> 3), new as (select id, case when loc % 10 = 1 then name || '!' else name end as t, case when loc % 10 = 2 then loc + 1 else loc end as loc from nodes where loc is not null and loc % 10 <> 4)"
    " select case when n.id is null then 'remove' when o.id is null or o.t <> n.t then 'embed' when o.loc = n.loc then 'unchanged' else 'rewrite' end as action, count(*) as n from old o full join new n on n.id = o.id group by 1"
)
def incremental_plan(spark, sf):
    n = graph(spark, sf)[0].where("loc is not null")
    old = n.where("loc % 10 != 3").select("id", c("name").alias("node_text"), "loc", F.lit(True).alias("has_vector"))
    new = n.where("loc % 10 != 4").select("id", F.when(c("loc") % 10 == 1, F.concat("name", F.lit("!"))).otherwise(c("name")).alias("node_text"), F.when(c("loc") % 10 == 2, c("loc") + 1).otherwise(c("loc")).alias("loc"))
    return incremental.plan(old, new, ["loc"]).groupBy("action").agg(F.count("*").alias("n"))


@query("select id from nodes where node_type = 'Class' and loc > 60")
def prune(spark, sf):
    n = graph(spark, sf)[0]
    return incremental.prune(n.where("node_type = 'Class'"), n.where("loc > 60")).select("id")


@query("select id, case when node_type = 'Class' then 'new' else name end as name from nodes")
def store_upsert_nodes(spark, sf):
    n = graph(spark, sf)[0].select("node_type", "id", "name")
    return incremental.upsert_nodes(n, n.where("node_type = 'Class'").withColumn("name", F.lit("new"))).select("id", "name")


@query("select source || '|' || edge_type || '|' || target as id, case edge_type " + " ".join(f"when '{k}' then {v}" for k, v in EDGE_WEIGHTS.items()) + " else 0.5 end::double as weight from edges")
def store_upsert_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    return incremental.upsert_edges(edges, edges.where("edge_type = 'Calls'"), nodes).select("id", "weight")


def _changed_graph(spark, sf) -> DeltaGraph:
    """The graph of this session, taken apart and put together again by batches, two of them twice: all classes renamed, calls removed and put back, strangers come and go."""
    key = (spark.sparkContext.applicationId, sf, "graph")
    if key not in _indexes:
        nodes, edges = (df.select(*columns) for df, columns in zip(graph(spark, sf), (("id", "node_type", "name", "loc"), ("source", "edge_type", "target"))))
        edges = edges.distinct().withColumn("weight", weight_of("edge_type"))
        store = DeltaGraph(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", fan=2)
        store.create(nodes, edges, "base")
        classes = nodes.where("node_type = 'Class'").withColumn("name", F.lit("new"))
        calls = edges.where("edge_type = 'Calls'")
        strangers = classes.withColumn("id", F.concat(F.lit("stranger:"), "id"))
        ties = strangers.select(c("id").alias("source"), F.lit("Uses").alias("edge_type"), F.substring_index("id", "stranger:", -1).alias("target"))
        for batch in (("classes", classes), ("calls go", None, None, None, calls.select("source", "edge_type", "target")), ("strangers", strangers, ties), ("calls return", None, calls.drop("weight")), ("classes", nodes), ("strangers go", None, None, strangers.select("id")), ("strangers", strangers, ties)):
            store.apply(*batch)
        _indexes[key] = store
    return _indexes[key]


@query("select id, node_type, loc, case when node_type = 'Class' then 'new' else name end as name from nodes")
def delta_nodes(spark, sf):
    return _changed_graph(spark, sf).nodes()


@query("select distinct source, edge_type, target, case edge_type " + " ".join(f"when '{k}' then {v}" for k, v in EDGE_WEIGHTS.items()) + " else 0.5 end::double as weight from edges")
def delta_edges(spark, sf):
    return _changed_graph(spark, sf).edges()


@query("select case when b.path is null then 'parse' when a.path is null then 'gone' when a.hash = b.hash then 'reuse' else 'parse' end as state, count(*) as n from (select page_id as path, sha256(html) as hash from pages where page_id % 5 <> 0) a full join (select page_id as path, case when page_id % 7 = 0 then 'old' else sha256(html) end as hash from pages where page_id % 3 <> 0) b on a.path = b.path group by 1", over_graph=False)
def index_cached(spark, sf):
    pages = tables.content_hash(spark.read.parquet(f"{sf}/pages.parquet").select(c("page_id").alias("path"), "html"), "html")
    cache = pages.where("path % 3 != 0").withColumn("hash", F.when(c("path") % 7 == 0, "old").otherwise(c("hash")))
    return incremental.reuse(pages.where("path % 5 != 0"), cache).groupBy("state").agg(F.count("*").alias("n"))


@query("select count(*) as recorded, cast(sum(case when event_id % 4 <> 0 and value > 50 then 1 else 0 end) as bigint) as changed, cast(sum(case when event_id % 4 = 0 or value is null then 1 else 0 end) as bigint) as missing from events", over_graph=False)
def staleness(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(c("event_id").alias("path"), c("value").alias("modified"))
    return incremental.staleness(e, e.where("path % 4 != 0"), 50)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2", over_graph=False)
def event_windows(spark, sf):
    return incremental.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))


# -- tools ---------------------------------------------------------------------------------


@query("select id, name, node_type, file, rank, count(*) over () as total from (select id, name, node_type, file, case when name = 'order_1' then 0 when starts_with(name, 'order_1') then 1 when name like '%order\\_1%' escape '\\' then 2 else 3 end as rank from nodes where node_type = 'Function' and (name like '%order\\_1%' escape '\\' or lower(description) like '%order\\_1%' escape '\\')) t order by rank, length(name), name, id limit 20")
def find_symbols(spark, sf):
    return tools.find_symbols(graph(spark, sf)[0], "Order_1", ["Func*"])


@query("select file, start_line, id, node_type, name from nodes where node_type not in ('File', 'Folder') and file in (select distinct file from nodes where node_type not in ('File', 'Folder') and regexp_full_match(file, '(?i)parts/.*/p1[^/]*') order by file limit 20)")
def file_outline(spark, sf):
    return tools.file_outline(graph(spark, sf)[0], "parts/**/p1*")


@query("select id, min(ref) as ref from (select id, 0 as ref from nodes where id = 'class:p1' or lower(name) = 'class:p1' union all select * from (select id, 1 from nodes where regexp_full_match(name, '(?i)order_4[0-9]') order by name, id limit 25) t) u group by 1")
def match_ref(spark, sf):
    return tools.expand_refs(graph(spark, sf)[0], ["class:p1", "order_4[0-9]"])


@query("select 'interface:s1' as id")
def resolve_node_ref(spark, sf):
    return spark.createDataFrame([(tools.resolve_one(graph(spark, sf)[0], "interface:s1"),)], "id string")


@query()
def context(spark, sf):
    return tools.context(*graph(spark, sf), "class:p1")


@query(
    "with s as (select * from (values (1, 'function:o1'), (2, (select min(target) from edges where source = 'function:o1' and edge_type = 'References')), (3, 'interface:s1')) v(place, id)), t as (select place, id, lag(id) over (order by place) as previous from s)"
    " select t.place, t.id, t.previous, coalesce((select min(edge_type) from edges e where e.source = t.previous and e.target = t.id), '<' || (select min(edge_type) from edges e where e.target = t.previous and e.source = t.id)) as link from t"
)
def tour_assembly(spark, sf):
    edges = graph(spark, sf)[1]
    second = edges.where("source = 'function:o1' and edge_type = 'References'").agg(F.min("target")).first()[0]
    return tools.tour_links(spark.createDataFrame([(1, "function:o1"), (2, second), (3, "interface:s1")], "place int, id string"), edges)


_GQL = "MATCH (a:Function)-[:Calls]->(b:Function) WHERE a.loc > 50 AND b.has_doc = 0 RETURN a.folder AS folder, count(*) AS n, count(DISTINCT elementKey(b)) AS callees ORDER BY n DESC, folder LIMIT 50"


@query("select a.folder, count(*) as n, count(distinct b.id) as callees from edges e join nodes a on a.id = e.source join nodes b on b.id = e.target where e.edge_type = 'Calls' and a.node_type = 'Function' and b.node_type = 'Function' and a.loc > 50 and b.has_doc = 0 group by 1 order by n desc, 1 limit 50")
def raw_gql(spark, sf):
    return gql.run(_GQL, *graph(spark, sf))


@query()
def classify_file(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.groupBy(classify.classify_file().alias("class")).agg(F.count("*").alias("n"))


# -- name resolution -----------------------------------------------------------------------

_UP = "with recursive up(id, other, level) as (select source, target, 1 from edges where edge_type in ('Extends', 'Implements') union select u.id, e.target, level + 1 from up u join edges e on e.source = u.other and e.edge_type in ('Extends', 'Implements') where level < 8), least_up as (select id, other, min(level) as level from up where id <> other group by 1, 2)"


@query(_UP + ", ranked as (select other as id, id as other, level, row_number() over (partition by other order by level, id) as r from least_up) select id, other, level from ranked where r <= 8")
def implementors(spark, sf):
    return resolve.implementors(graph(spark, sf)[1])


_CALLS = "calls as (select id as call, id as type, 'm' || cast((loc + 2) % 5 as varchar) as name, loc % 3 as argc from nodes where node_type = 'Class'), members as (select id as type, 'm' || cast(loc % 5 as varchar) as name, loc % 3 as argc, id || '.m' as method from nodes where node_type = 'Class')"
_RESOLVED = _UP + f", {_CALLS}, wide as (select call, type as t, name, argc as wanted, 0 as level from calls union all select c.call, u.other, c.name, c.argc, u.level from calls c join least_up u on u.id = c.type), ranked as (select w.call, m.method, row_number() over (partition by w.call order by w.level, m.argc <> w.wanted, m.method) as r from wide w join members m on m.type = w.t and m.name = w.name)"


def _calls(nodes):
    own = nodes.where("node_type = 'Class'")
    calls = own.select(c("id").alias("call"), c("id").alias("type"), F.concat(F.lit("m"), (c("loc") + 2) % 5).alias("name"), (c("loc") % 3).alias("argc"))
    return calls, own.select(c("id").alias("type"), F.concat(F.lit("m"), c("loc") % 5).alias("name"), (c("loc") % 3).alias("argc"), F.concat("id", F.lit(".m")).alias("method"))


@query(_RESOLVED + " select call, method from ranked where r = 1")
def method_resolve(spark, sf):
    nodes, edges = graph(spark, sf)
    return resolve.method_resolve(*_calls(nodes), edges)


@query(_RESOLVED + ", only_name as (select name, min(method) as target from members group by 1 having count(*) = 1), hit as (select c.call, case when r.method is not null then 0 when o.target is not null then 1 else -1 end as strategy from calls c left join (select * from ranked where r = 1) r on r.call = c.call left join only_name o on o.name = c.name) select strategy, count(*) as n from hit group by 1")
def resolution_stats(spark, sf):
    nodes, edges = graph(spark, sf)
    calls, members = _calls(nodes)
    typed = resolve.method_resolve(calls, members, edges).withColumnRenamed("method", "target")
    bare = members.groupBy("name").agg(F.count("*").alias("n"), F.min("method").alias("target")).where("n = 1")
    return resolve.resolution_stats(calls, resolve.cascade(typed, calls.join(bare, "name").select("call", "target")))
