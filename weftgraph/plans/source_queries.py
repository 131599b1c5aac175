"""Registered queries of parsers, graph building, sources and scalar functions, over files that are made from the tables by SQL.

What the files say follows from the keys, so that DuckDB can say from the keys
alone what has to come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import classify, lines, text
from ..operators import facts
from ..operators.resolve import LEVELS
from ..sources import code, tables
from ..session import shared_dir
from ..streaming import incremental
from ..streaming.source_graph import SourceGraph
from . import gql
from .graph_queries import walk_sql
from .projection import graph, oracle

c = F.col
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, over_graph: bool = False):
    def add(run):
        QUERIES[run.__name__] = run
        ORACLE_SQL[run.__name__] = oracle(sql) if over_graph else sql
        return run

    return add


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- Python files: a class for each part, with the part before it of the same brand as its base --------------

#: k: key, p: the base's key, b: folder
_PARTS = "select p_partkey as k, lag(p_partkey) over (partition by p_brand order by p_partkey) as p, 'src/b' || regexp_extract(p_brand, '([0-9]+)', 1) as b from part"
_FILE, _CLASS, _GO, _STOP, _HELP, _LIMIT = ("'file:' || b || '/f' || {k} || '.py'", "'class:' || b || '/f' || {k} || '.py:C' || {k}", "'function:' || b || '/f' || {k} || '.py:C' || {k} || '.go'", "'function:' || b || '/f' || {k} || '.py:C' || {k} || '.stop'", "'function:' || b || '/f' || {k} || '.py:helper' || {k}", "'variable:' || b || '/f' || {k} || '.py:LIMIT_' || {k}")


def python_files(spark, sf):
    """(path, language, content)."""
    _table(spark, sf, "part").createOrReplaceTempView("part")
    rows = spark.sql(_PARTS)
    k, p = c("k").cast("string"), c("p").cast("string")
    head = F.when(c("p").isNotNull(), F.concat(F.lit("from .f"), p, F.lit(" import C"), p, F.lit("\n\n"))).otherwise(F.lit("# the first of its brand\n"))
    base = F.when(c("p").isNotNull(), F.concat(F.lit("(C"), p, F.lit(")"))).otherwise(F.lit(""))
    doc = F.when(c("k") % 4 > 0, F.concat(F.lit('    """About '), k, F.lit('."""\n'))).otherwise(F.lit(""))
    stop = F.when(c("k") % 3 == 0, F.concat(F.lit("    def stop(self):\n        return LIMIT_"), k, F.lit("\n"))).otherwise(F.lit(""))
    content = F.concat(head, F.lit("LIMIT_"), k, F.lit(" = 1\n"), F.lit("class C"), k, base, F.lit(":\n"), doc, F.lit("    def go(self, n):\n        return helper"), k, F.lit("(n)\n"), stop, F.lit("def helper"), k, F.lit("(n):\n    return n\n"))
    return rows.select(F.concat("b", F.lit("/f"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))


_built: dict = {}


def _graph(spark, sf, levels=None):
    key = (spark.sparkContext.applicationId, sf, levels)
    if key not in _built:
        _built[key] = code.build(code.symbols(python_files(spark, sf)), levels=levels)
    return _built[key]


def _edge(a: str, b: str, kind: str, where: str = "true", x: str = "k", y: str = "k") -> str:
    return f"select {a.format(k=x)} as source, {b.format(k=y)} as target, '{kind}' as edge_type from s where {where}"


#: q: the nearest of the nine parts before it whose class has a stop method
_S = f"s as (select *, last_value(case when k % 3 = 0 then k end ignore nulls) over (partition by b order by k rows between 9 preceding and 1 preceding) as q from ({_PARTS}) t)"
#: q: the nearest of all parts before it
_S_ALL = _S.replace("between 9 preceding", "between unbounded preceding")
_CONTAINS = " union all ".join(
    ["select distinct 'folder:src' as source, 'folder:' || b as target, 'Contains' as edge_type from s", "select 'folder:' || b, " + _FILE.format(k="k") + ", 'Contains' from s", *(_edge(_FILE, x, "Contains") for x in (_CLASS, _GO, _HELP, _LIMIT)), _edge(_FILE, _STOP, "Contains", "k % 3 = 0"), _edge(_CLASS, _GO, "Contains"), _edge(_CLASS, _STOP, "Contains", "k % 3 = 0")]
)
_OVERRIDES = " union all ".join([_edge(_GO, _GO, "Overrides", "p is not null", y="p"), _edge(_STOP, _STOP, "Overrides", "k % 3 = 0 and q is not null", y="q")])


@query(f"with {_S} {_CONTAINS}")
def contains_edges(spark, sf):
    return _graph(spark, sf)[1].where("edge_type = 'Contains'")


@query(f"with {_S} {_OVERRIDES}")
def override_edges(spark, sf):
    return _graph(spark, sf, LEVELS)[1].where("edge_type = 'Overrides'")


@query(f"with {_S} {_edge(_FILE, _FILE, 'Imports', 'p is not null', y='p')} union all {_edge(_FILE, _CLASS, 'References', 'p is not null', y='p')}")
def import_resolve(spark, sf):
    return _graph(spark, sf)[1].where("edge_type in ('Imports', 'References')")


@query(" union all ".join([f"with {_S_ALL} {_CONTAINS}", _OVERRIDES, _edge(_CLASS, _CLASS, "Extends", "p is not null", y="p"), _edge(_GO, _HELP, "Calls"), _edge(_STOP, _LIMIT, "Uses", "k % 3 = 0"), _edge(_FILE, _FILE, "Imports", "p is not null", y="p"), _edge(_FILE, _CLASS, "References", "p is not null", y="p")]))
def build_graph(spark, sf):
    return _graph(spark, sf)[1]


def _followed(spark, sf):
    """The graph that has followed the files from other contents: half of them edited, strangers deleted, one batch given twice."""
    key = (spark.sparkContext.applicationId, sf, "followed")
    if key not in _built:
        files = python_files(spark, sf)
        number = F.xxhash64("path")
        before = files.withColumn("content", F.when(number % 2 == 0, F.replace("content", F.lit("def go"), F.lit("def gone"))).when(number % 5 == 0, F.lit("def helper():\n    pass\n")).otherwise(c("content")))
        strangers = files.select(F.concat(F.lit("lost/"), "path").alias("path"), "language", "content")
        store = SourceGraph(spark, f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", levels=LEVELS)
        for name, listing in (("before", before.unionByName(strangers)), ("now", files), ("before", before)):
            store.update(name, listing)
        _built[key] = store.graph()
    return _built[key]


@query(" union all ".join([f"with {_S} {_CONTAINS}", _OVERRIDES, _edge(_CLASS, _CLASS, "Extends", "p is not null", y="p"), _edge(_GO, _HELP, "Calls"), _edge(_STOP, _LIMIT, "Uses", "k % 3 = 0"), _edge(_FILE, _FILE, "Imports", "p is not null", y="p"), _edge(_FILE, _CLASS, "References", "p is not null", y="p")]))
def followed_edges(spark, sf):
    return _followed(spark, sf)[1]


@query(f"with {_S} select 'Class' as node_type, count(*) as n from s union all select 'File', count(*) from s union all select 'Constant', count(*) from s union all select 'Folder', 1 + count(distinct b) from s union all select 'Function', count(*) * 2 + count(*) filter (where k % 3 = 0) from s")
def followed_types(spark, sf):
    return _followed(spark, sf)[0].groupBy("node_type").agg(F.count("*").alias("n"))


@query(f"with {_S} select 'qualified' as strategy, count(*) as n from s group by 1")
def build_resolution(spark, sf):
    return _graph(spark, sf)[2].groupBy("strategy").agg(F.count("*").alias("n"))


#: lines of a class: head, documentation, go, stop
_LOC = "3 + case when k % 4 > 0 then 1 else 0 end + case when k % 3 = 0 then 2 else 0 end"


@query(
    f"with {_S}, nxt as (select p as k, count(*) as n from s where p is not null group by 1) select {_CLASS.format(k='s.k')} as id, 'Class' as node_type, ({_LOC.replace('k %', 's.k %')})::bigint as loc, ({_LOC.replace('k %', 's.k %')})::bigint as code_lines, 0::bigint as comment_lines, case when s.k % 4 > 0 then 1 else 0 end::bigint as has_doc,"
    " (1 + case when s.k % 3 = 0 then 1 else 0 end)::bigint as members, (2 * coalesce(nxt.n, 0))::bigint as in_degree, case when s.p is null then 0 else 1 end::bigint as out_degree, 'python' as language, b as folder, replace(b, '/', '.') || '.f' || s.k || '.C' || s.k as qualified_name from s left join nxt on nxt.k = s.k"
)
def facts_compute(spark, sf):
    return _graph(spark, sf)[0].where("node_type = 'Class'").select("id", "node_type", "loc", "code_lines", "comment_lines", "has_doc", "members", "in_degree", "out_degree", "language", "folder", "qualified_name")


@query(f"with {_S} select 'Class' as node_type, count(*) as n from s union all select 'File', count(*) from s union all select 'Constant', count(*) from s union all select 'Folder', 1 + count(distinct b) from s union all select 'Function', count(*) * 2 + count(*) filter (where k % 3 = 0) from s")
def kind_mapping(spark, sf):
    return _graph(spark, sf)[0].groupBy("node_type").agg(F.count("*").alias("n"))


@query(f"with {_S} select 'python' as language, count(*) as files, (count(*) * 4 + count(*) filter (where k % 3 = 0))::bigint as symbols, sum(7 + case when p is null then 1 else 2 end + case when k % 4 > 0 then 1 else 0 end + case when k % 3 = 0 then 2 else 0 end)::bigint as lines from s group by 1")
def index_run(spark, sf):
    return code.index_totals(code.symbols(python_files(spark, sf)))


# -- comments --------------------------------------------------------------------------------


@query(
    "select 'm' || o_orderkey || '.py' as path, n as line, said as text from (select o_orderkey, unnest([1, 7]) as n, unnest(['explains what order ' || o_orderkey || ' is for', 'the noble word of ' || o_orderkey]) as said from orders) t"
    " union all select min('m' || o_orderkey || '.py'), 2, 'All of these files are free' from orders"
)
def extract_comments(spark, sf):
    """Prose comments: neither directives nor code that is commented out; what every file says counts once."""
    k = c("o_orderkey").cast("string")
    rows = ["# explains what order ", k, " is for\n# All of these files are free\n# pylint: disable order ", k, " all of it\nx = 1  # here x is one\n", "# total = total + item * ", k, ";\n# if total of order > ", k, " {\n# the noble word of ", k, "\n# too short\n"]
    text_ = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in rows))
    files = _table(spark, sf, "orders").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), text_.alias("text"))
    return lines.prose_comments(files)


# -- files of one name in many folders ---------------------------------------------------------

_AT = "'lib/g' || (k % 37) || '/p' || k || '/index.ts'"
_FROM = "'lib/g' || (k % 41) || '/q' || k || '/main.ts'"


@query(
    f"with have as (select {_AT} as target from (select p_partkey as k from part) t), ask as (select {_FROM} as source from (select c_custkey as k from customer) t),"
    " pairs as (select source, target, list_max(list_filter(range(0, least(length(source), length(target)) + 1), lambda n: left(source, n) = left(target, n))) as shared from ask, have)"
    " select 'file:' || source as source, 'file:' || target as target from (select *, row_number() over (partition by source order by shared desc, target) as r from pairs) t where r = 1"
)
def import_nearest(spark, sf):
    """Imports that only the file name finds: the file with the longest common beginning among all files of that name."""
    part, customer = _table(spark, sf, "part"), _table(spark, sf, "customer")
    place = lambda k, n, letter, name: F.concat(F.lit("lib/g"), (k % n).cast("string"), F.lit(f"/{letter}"), k.cast("string"), F.lit(name))
    have = part.select(place(c("p_partkey"), 37, "p", "/index.ts").alias("path"), F.lit("export const held = 1;\n").alias("content"))
    ask = customer.select(place(c("c_custkey"), 41, "q", "/main.ts").alias("path"), F.lit("import { other } from 'elsewhere/index';\n").alias("content"))
    files = have.unionByName(ask).select("path", F.lit("typescript").alias("language"), "content")
    return code.build(code.symbols(files))[1].where("edge_type = 'Imports'").select("source", "target")


@query("select 'file:s/m' || s_suppkey || '.py' as source, 'dep:lib' || s_suppkey as target, 'DependsOn' as edge_type from supplier where s_suppkey % 2 = 0")
def package_edges(spark, sf):
    k = c("s_suppkey").cast("string")
    t = _table(spark, sf, "supplier")
    files = t.select(F.concat(F.lit("s/m"), k, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(F.lit("import lib"), k, F.lit(".sub\nimport os\n")).alias("content"))
    deps = t.where("s_suppkey % 2 = 0").select(F.concat(F.lit("lib"), k).alias("name"), F.lit("1").alias("version"))
    return code.build_graph(code.symbols(files), deps)[1].where("edge_type = 'DependsOn'")


# -- markdown, manifests, spans -------------------------------------------------------------


def markdown_files(spark, sf):
    """(path, text): headings, one of them in a fence, and a link; by customer."""
    k = c("c_custkey").cast("string")
    body = F.concat(F.lit("# Guide "), k, F.lit("\nabout it\n## Set up\nsteps\n```\n# no heading\n```\n### More\nsee [next](../n/"), k, F.lit(".md) or [web](https://x.org)\n"), F.when(c("c_custkey") % 2 == 0, F.lit("# End\nlast")).otherwise(F.lit("## Also\nlast")))
    return _table(spark, sf, "customer").select(F.concat(F.lit("docs/d"), k, F.lit(".md")).alias("path"), body.alias("text"))


@query(
    "with d as (select c_custkey as k, 'docs/d' || c_custkey || '.md' as path from customer) select path, 1 as level, 'Guide ' || k as title, 1 as start_line, case when k % 2 = 0 then 9 else 11 end as end_line from d"
    " union all select path, 2, 'Set up', 3, 9 from d union all select path, 3, 'More', 8, 9 from d union all select path, case when k % 2 = 0 then 1 else 2 end, case when k % 2 = 0 then 'End' else 'Also' end, 10, 11 from d"
)
def scan_markdown(spark, sf):
    return tables.markdown_headings(markdown_files(spark, sf)).select("path", "level", "title", "start_line", "end_line")


@query("with d as (select 'docs/d' || c_custkey || '.md' as path from customer) select path, 'about it' as first, case when true then 1 end as n from d")
def section_prose(spark, sf):
    heads = tables.markdown_headings(markdown_files(spark, sf)).where("start_line = 1")
    return heads.groupBy("path").agg(F.min("prose").alias("first"), F.count("*").cast("int").alias("n"))


@query("select 'docs/d' || c_custkey || '.md' as path, 'n/' || c_custkey || '.md' as target from customer")
def markdown_links(spark, sf):
    return tables.markdown_links(markdown_files(spark, sf))


@query(
    "with d as (select c_custkey as k, 'docs/d' || c_custkey || '.md' as path from customer) select 'heading:' || path || ':Guide ' || k as id, null as parent from d union all select 'heading:' || path || ':Set up', 'heading:' || path || ':Guide ' || k from d"
    " union all select 'heading:' || path || ':More', 'heading:' || path || ':Set up' from d union all select 'heading:' || path || ':' || case when k % 2 = 0 then 'End' else 'Also' end, case when k % 2 = 1 then 'heading:' || path || ':Guide ' || k end from d"
)
def heading_nesting(spark, sf):
    files = markdown_files(spark, sf).select("path", F.lit("markdown").alias("language"), c("text").alias("content"))
    return code.headings(code.with_ids(code.symbols(files))).select("id", "parent")


@query(
    "with m as (select s_suppkey as k, 'm' || s_suppkey || '/package.json' as path from supplier) select path, 'lib' || k as name, '1.' || k as version, false as dev, false as optional from m"
    " union all select path, '@s/dev' || (k % 7), '2', true, false from m where k % 2 = 0 union all select path, 'opt', '3', false, true from m where k % 5 = 0"
)
def scan_package_json(spark, sf):
    k = c("s_suppkey").cast("string")
    dev = F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit(', "devDependencies": {"@s/dev'), (c("s_suppkey") % 7).cast("string"), F.lit('": "2"}'))).otherwise(F.lit(""))
    opt = F.when(c("s_suppkey") % 5 == 0, F.lit(', "optionalDependencies": {"opt": "3"}')).otherwise(F.lit(""))
    m = _table(spark, sf, "supplier").select(F.concat(F.lit("m"), k, F.lit("/package.json")).alias("path"), F.concat(F.lit('{"dependencies": {"lib'), k, F.lit('": "1.'), k, F.lit('"}'), dev, opt, F.lit("}")).alias("text"))
    return tables.package_dependencies(m)


@query("select 'n' || c_custkey as id, case when c_custkey % 5 = 0 then array_to_string(list_transform(range(1, 10), lambda i: 'l' || i), chr(10)) else array_to_string(list_transform(range(1 + c_custkey % 4, least(2 + c_custkey % 11, 9) + 1), lambda i: 'l' || i), chr(10)) end as code from customer")
def capture_source(spark, sf):
    k = c("c_custkey")
    t = _table(spark, sf, "customer")
    nodes = t.select(F.concat(F.lit("n"), k.cast("string")).alias("id"), F.concat(F.lit("f"), (k % 10).cast("string")).alias("file"), F.when(k % 5 != 0, 1 + k % 4).alias("start_line"), F.when(k % 5 != 0, 2 + k % 11).alias("end_line"))
    files = t.select(F.concat(F.lit("f"), (k % 10).cast("string")).alias("path")).distinct().withColumn("text", F.lit("\n".join(f"l{i}" for i in range(1, 10))))
    return tables.capture_source(nodes, files)


@query("select c_custkey as k, case when c_custkey % 2 = 0 then 3 else 4 end as code, 2 as comments, case when c_custkey % 2 = 0 then 2 else 1 end as blank, 1 as inner_comments from customer")
def count_range(spark, sf):
    body = F.concat(F.lit("# one\nx = '# no'\n"), F.when(c("c_custkey") % 2 == 0, F.lit("\n")).otherwise(F.lit("y = 2\n")), F.lit('z = 3  # tail\n  # two\n\n"""doc"""'))
    d = _table(spark, sf, "customer").select(c("c_custkey").alias("k"), body.alias("text"), F.lit("python").alias("language")).withColumn("kinds", lines.line_kinds("text", "language"))
    n = lambda kind, a, b: lines.count_kind(c("kinds"), kind, F.lit(a), F.lit(b))
    return d.select("k", n(lines.CODE, 1, 7).alias("code"), n(lines.COMMENT, 1, 7).alias("comments"), n(lines.BLANK, 1, 7).alias("blank"), n(lines.COMMENT, 2, 5).alias("inner_comments"))


# -- names, paths, classes ------------------------------------------------------------------


@query("select o_orderkey as k, ['get', 'order' || o_orderkey, 'by', 'http', 'code'] as words, 'get order' || o_orderkey || ' by http code' as plain, ['xml', 'data' || o_orderkey] as short from orders")
def split_names(spark, sf):
    k = c("o_orderkey").cast("string")
    name, short = F.concat(F.lit("getOrder"), k, F.lit("_byHTTPCode")), F.concat(F.lit("XMLData"), k)
    return _table(spark, sf, "orders").select(c("o_orderkey").alias("k"), text.split_identifier(name).alias("words"), text.humanize_identifier(name).alias("plain"), text.split_identifier(short).alias("short"))


@query("select o_orderkey as k, t as token, count(*) as n from (select o_orderkey, unnest(['getorder' || o_orderkey, 'get', 'order' || o_orderkey, 'ok', 'order' || o_orderkey]) as t from orders) x group by 1, 2")
def tokenize_names(spark, sf):
    k = c("o_orderkey").cast("string")
    said = F.concat(F.lit("getOrder"), k, F.lit(" is-a OK order"), k, F.lit(" x"))
    d = _table(spark, sf, "orders").select(c("o_orderkey").alias("k"), F.explode(text.tokenize(F.replace(said, F.lit("is-a "), F.lit("")))).alias("token"))
    return d.groupBy("k", "token").agg(F.count("*").alias("n"))


@query("select o_orderkey as k, 'a/b/x' || o_orderkey || '.md' as path, 'docs/img/y' || o_orderkey || '.png' as link, 'z' || o_orderkey as root, 'a/b' as folder from orders")
def normalize_paths(spark, sf):
    k = c("o_orderkey").cast("string")
    p = F.concat(F.lit("a/./q/../b//x"), k, F.lit(".md?raw=1#top"))
    return _table(spark, sf, "orders").select(
        c("o_orderkey").alias("k"), text.normalize_path(p).alias("path"), text.resolve_relative(F.lit("docs/guide/a.md"), F.concat(F.lit("../img/y"), k, F.lit(".png"))).alias("link"), text.normalize_path(F.concat(F.lit("../../z"), k)).alias("root"), text.folder_of(text.normalize_path(p)).alias("folder")
    )


#: path by key mod 12 and its class
_PATHS = {"src/components/a{k}.ts": "component", "src/pages/b{k}.tsx": "page", "src/useThing{k}.ts": "hook", "src/order{k}Service.ts": "service", "docs/c{k}.md": "documentation", "src/d{k}.test.ts": "test", "src/test/java/E{k}.java": "test", "img/f{k}.png": "asset", "conf/g{k}.yaml": "config", "src/types/h{k}.ts": "type", "src/utils/i{k}.py": "util", "src/j{k}.rs": None}
_quoted = lambda x: "null" if x is None else f"'{x}'"


@query("select o_orderkey as k, case o_orderkey % 12 " + " ".join(f"when {n} then {_quoted(v)}" for n, v in enumerate(_PATHS.values())) + " end as class from orders")
def classify_files(spark, sf):
    path = F.lit(None)
    for n, p in enumerate(_PATHS):
        path = F.when(c("o_orderkey") % 12 == n, F.replace(F.lit(p), F.lit("{k}"), c("o_orderkey").cast("string"))).otherwise(path)
    return _table(spark, sf, "orders").select(c("o_orderkey").alias("k"), path.alias("path")).select("k", classify.classify_file().alias("class"))


_FOLDERS = (("a/tests", "python", "tests"), ("lib/docs", "python", "documentation"), ("x/hooks", "typescript", "hooks"), ("y/plain", "python", "source"), ("z/text", "markdown", "documentation"), ("w/other", "rust", "mixed"), ("q/utils", "java", "utils"), ("examples/r", "java", "source"))


@query("select c_custkey as k, case c_custkey % 8 " + " ".join(f"when {n} then '{v}'" for n, (*_, v) in enumerate(_FOLDERS)) + " end as class from customer")
def classify_folder(spark, sf):
    pick = lambda place: F.element_at(F.array(*(F.lit(x[place]) for x in _FOLDERS)), (c("c_custkey") % 8 + 1).cast("int"))
    d = _table(spark, sf, "customer").select(c("c_custkey").alias("k"), pick(0).alias("folder"), F.lit(2).alias("files"), F.create_map(pick(1), F.lit(2)).alias("languages"))
    return d.select("k", classify.classify_folder().alias("class"))


@query(
    "select 's' || o_orderkey as id, case o_orderkey % 4 when 0 then 'mq.listener' when 1 then 'http.endpoint' when 2 then 'db.access' else 'cli.command' end as kind, case when o_orderkey % 4 = 2 then 'outbound' else 'inbound' end as direction, case o_orderkey % 4 when 0 then 'kafka' when 1 then 'http' when 2 then 'jdbc' else 'cli' end as protocol,"
    " case o_orderkey % 4 when 0 then 't' || o_orderkey when 1 then 'GET /o' || o_orderkey end as detail, case o_orderkey % 4 when 0 then 'kafka.KafkaListener' when 1 then 'http.route' when 2 then 'spring.JdbcTemplate' else 'java.main' end as source from orders"
)
def boundary_rules(spark, sf):
    k, at = c("o_orderkey").cast("string"), c("o_orderkey") % 4
    mark = "array<struct<name:string,args:string>>"
    s = _table(spark, sf, "orders").select(
        F.concat(F.lit("s"), k).alias("id"), F.lit("java").alias("language"), F.lit("function").alias("kind"), F.when(at == 3, "main").otherwise("run").alias("name"), F.lit("O").alias("owner"), F.when(at == 1, F.concat(F.lit("GET /o"), k)).alias("route"),
        F.when(at == 0, F.array(F.struct(F.lit("KafkaListener").alias("name"), F.concat(F.lit('topics = "t'), k, F.lit('"')).alias("args")))).otherwise(F.array().cast(mark)).alias("annotations"), F.array().cast("array<string>").alias("supertypes"),
        F.when(at == 2, F.array(F.struct(F.lit("query").alias("name"), F.lit("JdbcTemplate").alias("owner"), F.lit(None).cast("string").alias("arg")))).otherwise(F.array().cast("array<struct<name:string,owner:string,arg:string>>")).alias("calls"),
    )
    return classify.boundaries(s)


@query("select 'b' || s_suppkey as id, 1::bigint as boundary_in, case when s_suppkey % 2 = 0 then 1 else 0 end::bigint as boundary_out, case when s_suppkey % 2 = 0 then 'http.endpoint,db.access' else 'http.endpoint' end as boundary_kinds, case when s_suppkey % 2 = 0 then 'http,jdbc' else 'http' end as boundary_protocols, 'GET /' || s_suppkey || ',PUT /' || s_suppkey as boundary_detail from supplier")
def boundary_facts(spark, sf):
    k = c("s_suppkey").cast("string")
    tag = lambda place, kind, way, protocol, detail: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(way).alias("direction"), F.lit(protocol).alias("protocol"), detail.alias("detail"))
    tags = F.array(tag(3, "http.endpoint", "inbound", "http", F.concat(F.lit("PUT /"), k)), tag(1, "http.endpoint", "inbound", "http", F.concat(F.lit("GET /"), k)), tag(7, "db.access", "outbound", "jdbc", F.lit(None).cast("string")))
    t = _table(spark, sf, "supplier").select(F.concat(F.lit("b"), k).alias("id"), F.explode(F.filter(tags, lambda x: (x["place"] < 7) | (c("s_suppkey") % 2 == 0))).alias("t"))
    return facts.boundary_facts(t.select("id", "t.*"))


# -- query text, texts of nodes, upserts --------------------------------------------------------

_ANCHOR = "select id from nodes where file = (select file from nodes where id = 'class:p1')"


@query(f"with {walk_sql(_ANCHOR, 2, ('Calls', 'References'))} select w.id, count(*) as paths from walk w group by 1", over_graph=True)
def gql_varlen(spark, sf):
    nodes, edges = graph(spark, sf)
    return gql.run("MATCH (d)-[:Calls|References*1..2]->(t) WHERE t.file = $f RETURN elementKey(d) AS id, count(*) AS paths", nodes, edges, f=nodes.where("id = 'class:p1'").first().file)


@query(f"with {walk_sql(_ANCHOR, 3, ('Calls', 'References'))} select count(distinct id) as n from walk", over_graph=True)
def gql_distinct_ends(spark, sf):
    nodes, edges = graph(spark, sf)
    return gql.run("MATCH (d)-[:Calls|References*1..3]->(t) WHERE t.file = $f RETURN count(DISTINCT elementKey(d)) AS n", nodes, edges, f=nodes.where("id = 'class:p1'").first().file)


@query("select case when loc >= 100 then 'long' when loc >= 10 then 'middle' else 'short' end as size, count(*) as n, min(loc) as least, count(distinct language) as languages from nodes where node_type = 'Function' and contains(name, '1') and not starts_with(file, 'E') and not ends_with(file, '9') and members is null group by 1", over_graph=True)
def gql_case(spark, sf):
    text_ = "MATCH (f:Function) WHERE f.name CONTAINS '1' AND NOT (f.file STARTS WITH 'E') AND NOT (f.file ENDS WITH '9') AND f.members IS NULL RETURN CASE WHEN f.loc >= 100 THEN 'long' WHEN f.loc >= 10 THEN 'middle' ELSE 'short' END AS size, count(*) AS n, min(f.loc) AS least, count(DISTINCT f.language) AS languages"
    return gql.run(text_, *graph(spark, sf))


@query("select n.id from nodes n where n.node_type = 'Class' and not exists (select 1 from edges e join nodes f on f.id = e.source where e.target = n.id and e.edge_type = 'References' and f.is_test = 1)", over_graph=True)
def gql_not_exists(spark, sf):
    return gql.run("MATCH (n:Class) WHERE NOT EXISTS { MATCH (f)-[:References]->(n) WHERE f.is_test = 1 RETURN f } RETURN elementKey(n) AS id", *graph(spark, sf))


@query("select n.id, count(i.id) as n from nodes n left join edges e on e.source = n.id and e.edge_type = 'Implements' left join nodes i on i.id = e.target where n.node_type = 'Class' group by 1", over_graph=True)
def gql_optional(spark, sf):
    return gql.run("MATCH (n:Class) OPTIONAL MATCH (n)-[:Implements]->(i) RETURN elementKey(n) AS id, count(i.id) AS n", *graph(spark, sf))


@query("with r as (select e.target as id, string_agg(distinct n.name, ', ' order by n.name) as related from edges e join nodes n on n.id = e.source where e.edge_type = 'Implements' group by 1) select i.id, 'Interface: ' || i.name || ' (' || lower(replace(i.name, '#', ' ')) || ')' || case when i.description is null then '' else '. ' || i.description end || case when r.related is null then '' else '. Related: ' || r.related end as node_text from nodes i left join r on r.id = i.id where i.node_type = 'Interface'", over_graph=True)
def node_text_full(spark, sf):
    nodes, edges = graph(spark, sf)
    users = edges.where("edge_type = 'Implements'").join(nodes.select(c("id").alias("source"), "name"), "source").groupBy(c("target").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("related"))
    n = nodes.where("node_type = 'Interface'").select("id", "node_type", "name", "description").join(users, "id", "left")
    return n.select("id", text.node_text("node_type", "name", "description", F.lit(None).cast("string"), "related").alias("node_text"))


@query("select source || '|' || edge_type || '|' || target as id from edges union select target || '|DependsOn|' || source from edges where edge_type = 'Implements'", over_graph=True)
def upsert_new_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    new = edges.where("edge_type = 'Implements'").select(c("target").alias("source"), c("source").alias("target"), F.lit("DependsOn").alias("edge_type"))
    return incremental.upsert_edges(edges, new, nodes).select("id")
