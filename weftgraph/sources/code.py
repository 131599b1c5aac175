"""Source trees: listing, parsing into symbols and building the graph.

Files are read with the binary source, parsed where they lie (``mapInPandas``,
one file at a time, by the front ends in ``languages``) and resolved by joins: a
call by its qualified name, else by the type of its receiver (own methods, then
inherited ones, and the implementations that it may run), else, without a
receiver, by a name that means one thing only.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, globs
from ..functions.text import dependency_root, folder_of, is_test, looks_like_constant, normalize_path
from ..operators import facts, resolve
from ..schema import NODES
from ..session import cut, sent
from . import languages, tables

c = F.col

#: fixed values: folders and files that are never source, and folders that a build makes beside its descriptor
NEVER = r"(^|/)(node_modules|\.git|dist)/|\.(min|bundle)\.(js|mjs|css)$|(^|/)\.[^/]+(/|$)"
BUILD_FOLDERS = {"target": ("pom.xml", "build.sbt", "Cargo.toml"), "build": ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"), "out": ("build.gradle", "build.gradle.kts", "pom.xml")}
#: fixed values: spellings of an imported file
FILE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".md", ".mdx", ".markdown", ".py", ".java", ".rs", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs", "/README.md")

_CALL = "struct<name:string,owner:string,arg:string,qualified:string,owner_type:string,argc:int,ctor:boolean>"
SYMBOLS = (
    "path string, language string, pos int, kind string, name string, owner string, qualified string, owner_qualified string, start_line int, end_line int, docstring string, extends array<string>, implements array<string>,"
    f" calls array<{_CALL}>, uses array<string>, value_refs array<string>, imports array<struct<path:string,name:string,alias:string>>, exports array<string>, annotations array<struct<name:string,args:string>>, route string,"
    " params int, nesting int, comment_lines int, code_lines int, doc_lines int, level int"
)
_COLUMNS = re.findall(r"(?:^|, )(\w+) (?=string|int|array)", re.sub(r"<.*?>(?=,| )", "", re.sub(r"<[^<>]*>", "", SYMBOLS)))


# -- files ---------------------------------------------------------------------------------


def ignore_rules(text: str) -> list[tuple[int, bool, str]]:
    """(place, keeps, regular expression for a path below the file's folder) of each line of an ignore file."""
    out = []
    for k, line in enumerate(text.split("\n")):
        line = line.rstrip("\r").strip()
        if not line or line.startswith("#"):
            continue
        keeps, line = line.startswith("!"), line.removeprefix("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        body = globs.to_regex(line, path=True).removeprefix("(?is)^")[:-1]
        out.append((k, keeps, ("^" if anchored else "^(?:.*/)?") + body + ("/.+$" if folder else "(?:/.*)?$")))
    return out


def _ancestors(path):
    """Every folder above a path, the root as the empty string."""
    parts = F.split(folder_of(path), "/")
    return F.concat(F.array(F.lit("")), F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda x: x != ""))


def _passed_over(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of the files whose names begin with ``_``, and of ignore files, both of which Spark's readers pass over.

    Every folder is listed where a task runs, by Arrow's file systems; folders that hold no other file are found from the ones above them.
    """
    seen = re.compile(r"^(?!_|\.).").match

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(re.sub("^file:/*", "/", root.rstrip("/")))
        for batch in batches:
            rows = []
            for folder in batch["folder"]:
                at = f"{top}/{folder}".rstrip("/")
                found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
                for child in [x for x in found if x.type == fs.FileType.Directory and seen(x.base_name)]:
                    below = store.get_file_info(fs.FileSelector(child.path, recursive=True))
                    if not any(x.type == fs.FileType.File and seen(x.base_name) for x in below):
                        found += below
                rows += [(x.path[len(top) + 1 :], store.open_input_file(x.path).read()) for x in found if x.type == fs.FileType.File and (x.base_name.startswith("_") or x.base_name == ".gitignore")]
            yield pd.DataFrame(rows, columns=["path", "content"])

    folders = files.select(F.explode(_ancestors("path")).alias("folder")).distinct()
    return folders.mapInPandas(run, "path string, content binary").dropDuplicates(["path"])


def scan_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, language, content) of the parsed kinds of files below ``root``.

    Left out: hidden files, what ignore files name (the last rule that fits decides, nearer folders later),
    build output beside its descriptor, packed artifacts, and the globs of ``ignore``.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    files = raw.select(F.regexp_replace("path", rf"^(file:/*)?/?{base.lstrip('/')}/", "").alias("path"), "content")
    files = files.unionByName(_passed_over(files, root))
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in languages.languages().items() for x in kv))
    found = files.where(~c("path").rlike(NEVER)).withColumn("language", F.try_element_at(table, ending)).where("language is not null")
    for glob in ignore or []:
        found = found.where(~globs.matches(c("path"), glob, path=True))
    above = found.select("path", F.explode(_ancestors("path")).alias("folder"))

    # what a build makes beside its descriptor
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    made = F.create_map(*(F.lit(x) for kv in {d: [f for f, ds in BUILD_FOLDERS.items() if d in ds] for ds in BUILD_FOLDERS.values() for d in ds}.items() for x in (kv[0], ",".join(kv[1]))))
    built = files.select(folder_of("path").alias("at"), F.explode(F.split(F.try_element_at(made, name), ",")).alias("f")).select(F.ltrim(F.concat("at", F.lit("/"), "f"), F.lit("/")).alias("folder")).distinct()
    gone = above.join(built, "folder", "left_semi").select("path")

    # what ignore files name
    def rules(batches):
        for batch in batches:
            rows = [(at, *r) for at, content in zip(batch["at"], batch["content"]) for r in ignore_rules(bytes(content).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["folder", "place", "keeps", "rule"]).astype({"place": int, "keeps": bool})

    named = files.where(name == ".gitignore").select(folder_of("path").alias("at"), "content").mapInPandas(rules, "folder string, place int, keeps boolean, rule string")
    # few rules, sent to the tasks: the root is above every file
    fits = above.join(sent(cut(named)), "folder").where(F.expr("case when folder = '' then path else substring(path, length(folder) + 2) end rlike rule"))
    last = fits.groupBy("path").agg(F.max_by("keeps", F.struct(F.length("folder"), "place")).alias("keeps"))
    gone = gone.unionByName(last.where("not keeps").select("path"))
    return found.join(gone.distinct(), "path", "left_anti").select("path", "language", "content")


def symbols(files: DataFrame) -> DataFrame:
    """The symbols of (path, language, content), in the order of the file; the file itself is the first. Markdown headings are symbols, too."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, language, content in zip(batch["path"], batch["language"], batch["content"]):
                text = bytes(content).decode("utf-8", "replace") if not isinstance(content, str) else content
                for pos, s in enumerate(languages.parse(text, language, path)):
                    calls = [dict(zip(("name", "owner", "arg", "qualified", "owner_type", "argc", "ctor"), k)) for k in s["calls"]]
                    imports = [dict(zip(("path", "name", "alias"), k)) for k in s["imports"]]
                    marks = [{"name": a, "args": b} for a, b in s["marks"]]
                    rows.append((path, language, pos, s["kind"], s["name"], s["owner"], s["qualified"], s["owner_qualified"], s["start"], s["end"], s["doc"], list(s["extends"]), list(s["implements"]), calls, list(s["uses"]), list(s["value_refs"]), imports, list(s["exports"]), marks, s["route"], s["params"], s["nesting"], s["comment_lines"], s["code_lines"], s["doc_lines"], None))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"level": "Int32"})

    # dealt anew, by a given number: parsing is dear, and Spark puts small shuffled parts together, down to one
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.sparkSession.sparkContext.defaultParallelism)
    found = files.select("path", "language", "content").repartition(tasks, "path").mapInPandas(run, SYMBOLS)
    prose = files.where("language = 'markdown'").select("path", F.decode(F.col("content").cast("binary"), "UTF-8").alias("text"))
    heads = tables.markdown_headings(prose)
    links = tables.markdown_links(prose).groupBy("path").agg(F.collect_list(F.struct(c("target").alias("path"), F.lit("").alias("name"), F.lit(None).cast("string").alias("alias"))).alias("links"))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema}
    given = {"path": "path", "language": F.lit("markdown"), "pos": c("start_line").cast("int"), "kind": F.lit("heading"), "name": c("title"), "start_line": c("start_line").cast("int"), "end_line": c("end_line").cast("int"), "docstring": c("prose"), "level": c("level").cast("int")}
    heads = heads.select(*((c(given[k]) if isinstance(given[k], str) else given[k]).alias(k) if k in given else v for k, v in none.items()))
    joined = found.join(links, "path", "left").withColumn("imports", F.when((c("kind") == "file") & (c("language") == "markdown"), F.coalesce("links", "imports")).otherwise(c("imports"))).drop("links")
    return joined.select(*found.columns).unionByName(heads)


def index_totals(syms: DataFrame) -> DataFrame:
    """(language, files, symbols, lines) of an index run."""
    own = c("kind") == "file"
    return syms.groupBy("language").agg(F.sum(own.cast("long")).alias("files"), F.sum((~own).cast("long")).alias("symbols"), F.sum(F.when(own, c("end_line")).otherwise(0)).cast("long").alias("lines"))


def with_ids(syms: DataFrame) -> DataFrame:
    """``id`` by kind, file and name; repeats get #2, #3 in the order of the file. Ids don't hold line numbers."""
    name = F.when(c("owner").isNotNull(), F.concat("owner", F.lit("."), "name")).otherwise(c("name"))
    n = F.row_number().over(Window.partitionBy("path", "kind", name).orderBy("pos"))
    plain = F.concat("kind", F.lit(":"), "path", F.lit(":"), name)
    return syms.withColumn("id", F.when(c("kind") == "file", F.concat(F.lit("file:"), "path")).when(n > 1, F.concat(plain, F.lit("#"), n)).otherwise(plain))


def node_type():
    t = F.when(c("kind") == "file", F.when(c("classification") == "config", "Config").otherwise("File")).when(c("kind") == "heading", "Concept")
    t = t.when(c("kind") == "class", "Class").when(c("kind").isin("interface", "type"), "Interface").when(c("kind") == "constant", "Constant")
    return t.when((c("kind") == "variable") & looks_like_constant("name"), "Constant").when(c("kind") == "variable", "Variable").otherwise("Function")


# -- resolution ----------------------------------------------------------------------------


def shown_names(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, only) of the names that one symbol has, and (path, name, here), the first symbol of each name in a file."""
    named = s.where("kind not in ('file', 'heading')")
    shown = named.where("owner is not null").select("id", "path", "pos", F.concat("owner", F.lit("."), "name").alias("name")).unionByName(named.select("id", "path", "pos", "name"))
    only = shown.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only")).where("n = 1").select("name", "only")
    return cut(only), cut(shown.groupBy("path", "name").agg(F.min_by("id", "pos").alias("here")))


def bare_names(wanted: DataFrame, names: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, target): the only symbol of that name, else the first one in the own file; a dotted name is tried whole, then by its last part. wanted: (key, path, name); names: ``shown_names``."""
    only, here = names
    tail = F.regexp_extract("name", r"([^.:]*)$", 1)
    tried = wanted.select("key", "path", F.posexplode(F.array_distinct(F.array(c("name"), F.when(tail != "", tail)))).alias("rank", "name")).where("name is not null")
    found = tried.join(only, "name", "left").join(here, ["path", "name"], "left").select("key", F.coalesce("only", "here").alias("target"), "rank").where("target is not null")
    return found.groupBy("key").agg(F.min_by("target", "rank").alias("target"))


def _typed(calls: DataFrame, members: DataFrame, above: DataFrame, levels: int | None) -> DataFrame:
    """(key, target) of calls (key, type, name, argc) by the types of their receivers. above: the closure of the hierarchy; levels: None to go on above it."""
    found = resolve.methods(calls.withColumnRenamed("key", "call"), members.select("type", "name", "argc", c("id").alias("method")), above, whole=levels is None)
    return found.select(c("call").alias("key"), c("method").alias("target"))


def settle(rows: DataFrame, column: str, types: DataFrame) -> DataFrame:
    """``rows`` (each with its own key) with one of the types ``a|b|c`` in ``column``: the first that is declared, else the first."""
    several = rows.where(c(column).contains("|")).select("key", F.posexplode(F.split(column, r"\|")).alias("rank", "qualified")).join(types.select("qualified"), "qualified")
    found = several.groupBy("key").agg(F.min_by("qualified", "rank").alias("_type"))
    return rows.join(found, "key", "left").withColumn(column, F.coalesce("_type", F.substring_index(column, "|", 1))).drop("_type")


def build_graph(syms: DataFrame, dependencies: DataFrame | None = None, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed symbols, with all facts. A name that could mean several things makes no edge.

    dependencies: (name, version, ...) of the manifests. levels: how far a type's methods are looked for above and below it; None: all the way.
    """
    nodes, edges, _ = build(syms, dependencies, levels)
    return nodes, edges


def build(syms: DataFrame, dependencies: DataFrame | None = None, levels: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``build_graph`` and (key, source, name, target, strategy) of the calls; strategy: qualified, typed, dispatch, name, or null."""
    nodes, edges, resolved, s = link(syms, dependencies, levels)
    return with_facts(nodes, edges, s), edges, resolved


def link(syms: DataFrame, dependencies: DataFrame | None = None, levels: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``build`` gives, the nodes without facts of edges and boundaries, and the symbols with ids."""
    # what depends on the path alone is found once a file; the ids' windows need no further shuffle
    of_file = F.max(F.when(c("kind") == "file", classify.classify_file("path"))).over(Window.partitionBy("path"))
    s = cut(with_ids(syms.withColumn("classification", of_file)).withColumn("node_type", node_type()))
    files = s.where("kind = 'file'").select("path", c("id").alias("file_id"))
    edge = lambda df, kind, a="source", b="target": df.where(c(a) != c(b)).select(c(a).alias("source"), c(b).alias("target"), F.lit(kind).alias("edge_type"))
    types = s.where("kind in ('class', 'interface', 'type') and qualified is not null").groupBy("qualified").agg(F.min_by("id", F.struct("path", "pos")).alias("type_id"))
    by_name = cut(s.where("qualified is not null").groupBy("qualified").agg(F.min_by(F.struct("id", "node_type", "path"), F.struct("path", "pos")).alias("at")).select("qualified", c("at.id").alias("target"), c("at.node_type").alias("target_type"), c("at.path").alias("target_path")))
    members = cut(s.where("owner_qualified is not null").select(c("owner_qualified").alias("type"), "name", c("params").alias("argc"), "id"))

    # what contains what
    parts = [edge(s.where("kind not in ('file', 'heading')").join(files, "path"), "Contains", "file_id", "id")]
    parts.append(edge(s.where("owner_qualified is not null").select("id", "owner_qualified").join(types.withColumnRenamed("qualified", "owner_qualified"), "owner_qualified"), "Contains", "type_id", "id"))
    parts.append(edge(headings(s).join(files, "path").select(F.coalesce("parent", "file_id").alias("source"), c("id").alias("target")), "Contains"))
    folder_nodes, folder_edges = folder_graph(s)
    parts.append(folder_edges)

    # hierarchy
    supers = s.where("kind in ('class', 'interface', 'type')").select("id", "path", "qualified", F.explode(F.concat(F.transform("extends", lambda x: F.struct(x.alias("name"), F.lit("Extends").alias("kind"))), F.transform("implements", lambda x: F.struct(x.alias("name"), F.lit("Implements").alias("kind"))))).alias("up"))
    supers = supers.select("id", "path", "qualified", c("up.name").alias("name"), c("up.kind").alias("kind")).distinct().withColumn("key", F.concat_ws("\t", "id", "kind", "name"))
    supers = cut(settle(supers, "name", types))
    named = bare_names(supers.select("key", "path", "name"), shown_names(s.where("kind in ('class', 'interface', 'type')")))
    names = shown_names(s)
    known = cut(supers.join(types.withColumnRenamed("qualified", "q"), c("name") == c("q"), "left").join(named, "key", "left").select("id", "qualified", "kind", F.coalesce("type_id", "target").alias("target")).where("target is not null"))
    for kind in ("Extends", "Implements"):
        parts.append(edge(known.where(c("kind") == kind), kind, "id"))
    q_of = types.select(c("type_id").alias("target"), c("qualified").alias("up"))
    hierarchy = cut(known.join(q_of, "target").where("qualified is not null and qualified != up").select(c("qualified").alias("source"), c("up").alias("target"), c("kind").alias("edge_type")).distinct())
    above = resolve.closure(hierarchy, levels=levels or resolve.LEVELS)

    # a method that an inherited one of its name gives way to
    own = s.where("owner_qualified is not null and kind = 'function'").select("id", "name", c("params").alias("argc"), c("owner_qualified").alias("source"))
    asked = own.join(hierarchy.select("source", c("target").alias("type")), "source").select(F.concat_ws("\t", "id", "type").alias("key"), "type", "name", "argc")
    parts.append(edge(_typed(asked, members, above, levels).select(F.substring_index("key", "\t", 1).alias("source"), "target"), "Overrides"))

    # constants that are read, functions that are passed on
    used = s.select(c("id").alias("source"), F.explode("uses").alias("qualified")).join(by_name.where("target_type in ('Constant', 'Config')"), "qualified")
    passed = s.select(c("id").alias("source"), F.explode("value_refs").alias("qualified")).join(by_name.where("target_type = 'Function'"), "qualified")
    parts += [edge(used, "Uses"), edge(passed, "References")]

    # calls
    sites = s.select(c("id").alias("source"), "path", F.posexplode("calls").alias("n", "k")).select("source", "path", F.concat_ws("\t", "source", "n").alias("key"), "k.*")
    sites = cut(settle(sites, "owner_type", types))
    resolved = cut(calls(sites, s, names, by_name, types, members, hierarchy, above, levels))
    parts.append(resolved.where("target is not null and source != target").select("source", "target", F.when(c("ctor") | (c("target_type") == "Class"), "Instantiates").otherwise("Calls").alias("edge_type")))

    # routes, imports, exports, dependencies
    routes = s.where("route is not null").select("id", "path", "route", F.concat(F.lit("route:"), "route").alias("route_id"))
    parts += [edge(routes.join(files, "path"), "Contains", "file_id", "route_id"), edge(routes, "References", "route_id", "id")]
    parts.append(imports(s, names, by_name, members, dependencies))
    exported = s.where("kind = 'file'").select("path", c("id").alias("source"), F.explode("exports").alias("name")).withColumn("key", F.concat_ws("\t", "source", "name"))
    parts.append(edge(exported.join(bare_names(exported.select("key", "path", "name"), names), "key"), "Exports"))

    edges = parts[0]
    for more in parts[1:]:
        edges = edges.unionByName(more)
    edges = cut(edges.distinct())
    nodes = symbol_nodes(s)
    extra = [folder_nodes, routes.groupBy("route_id").agg(F.min("route").alias("name"), F.min("path").alias("file")).select(c("route_id").alias("id"), "name", F.lit("Route").alias("node_type"), "file")]
    if dependencies is not None:
        deps = dependencies.groupBy("name").agg(F.min("version").alias("version"))
        extra.append(deps.select(F.concat(F.lit("dep:"), "name").alias("id"), "name", F.lit("Dependency").alias("node_type"), F.concat(F.lit("version "), "version").alias("description")))
    for more in extra:
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    return nodes, edges, resolved, s


def calls(sites: DataFrame, s: DataFrame, names: tuple[DataFrame, DataFrame], by_name: DataFrame, types: DataFrame, members: DataFrame, hierarchy: DataFrame, above: DataFrame, levels: int | None = None) -> DataFrame:
    """(key, source, name, ctor, target, target_type, strategy), a row for each target; a call that may run several implementations has several."""
    exact = sites.where("qualified is not null").join(by_name, "qualified").select("key", "target")
    asked = sites.where("owner_type is not null").select("key", c("owner_type").alias("type"), "name", "argc")
    typed = _typed(asked, members, above, levels)
    made = sites.where("ctor and owner_type is not null").join(types.withColumnRenamed("qualified", "owner_type"), "owner_type").select("key", c("type_id").alias("target"))
    called = sites.where("owner_type is not null and not ctor").select(c("owner_type").alias("id"))
    below = resolve.closure(hierarchy, down=True, levels=levels, only=called).select(c("id").alias("owner_type"), c("other").alias("type"))
    fan = sites.where("owner_type is not null and not ctor").join(below, "owner_type").select(F.concat_ws("\t", "key", "type").alias("key"), "type", "name", "argc")
    reached = _typed(fan, members, above, levels).select(F.substring_index("key", "\t", 2).alias("key"), "target").distinct()
    sure = cut(resolve.cascade(*(x.select(c("key").alias("call"), "target") for x in (exact, typed, made))).select(c("call").alias("key"), "target", F.when(c("strategy") == 0, "qualified").otherwise("typed").alias("strategy")))
    found = sure.unionByName(reached.join(sure.select("key", "target"), ["key", "target"], "left_anti").withColumn("strategy", F.lit("dispatch")))
    left = sites.where("owner is null").join(found.select("key").distinct(), "key", "left_anti")
    found = found.unionByName(bare_names(left.select("key", "path", "name"), names).withColumn("strategy", F.lit("name")))
    kind = s.select(c("id").alias("target"), c("node_type").alias("target_type"))
    return sites.select("key", "source", "name", "ctor").join(found, "key", "left").join(kind, "target", "left").select("key", "source", "name", "ctor", "target", "target_type", "strategy")


def headings(s: DataFrame) -> DataFrame:
    """(id, path, parent) of headings: the last earlier heading of a higher level in the file, null for none."""
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    heads = s.where("kind = 'heading'").select("id", "path", "pos", "level")
    # the last earlier heading of each level above; the latest of these
    last = [F.max(F.when(c("level") == k, F.struct("pos", "id"))).over(before) for k in range(1, 7)]
    best = F.greatest(*(F.when(c("level") > k + 1, x) for k, x in enumerate(last)))
    return heads.withColumn("best", best).select("id", "path", c("best.id").alias("parent"))


def folder_graph(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder nodes and their Contains edges: a folder its folders, a folder the files right in it."""
    files = s.where("kind = 'file'").select("path", "language", c("id").alias("file_id"))
    f = cut(tables.folders(files))
    own = F.concat(F.lit("folder:"), c("folder"))
    nodes = f.select(own.alias("id"), F.regexp_extract("folder", r"([^/]*)$", 1).alias("name"), F.lit("Folder").alias("node_type"), classify.classify_folder().alias("classification"))
    inner = f.where("parent != ''").select(F.concat(F.lit("folder:"), "parent").alias("source"), own.alias("target"))
    direct = files.withColumn("folder", folder_of("path")).where("folder != ''").select(own.alias("source"), c("file_id").alias("target"))
    return nodes, inner.unionByName(direct).withColumn("edge_type", F.lit("Contains"))


def nearest_paths(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """(key, target): of the files of a name the one whose path has the longest common beginning with the asking path, the least path of several.

    wanted: (key, path, file); named: (target_path, target, file). Files of one name may be many, and so may those that ask for it, so
    they are not paired: every beginning of a path is filed with the least path that has it, and asking paths look up theirs.
    """
    begun = lambda path: F.explode(F.transform(F.sequence(F.lit(0), F.length(path)), lambda k: F.struct(k.alias("k"), F.xxhash64("file", F.left(path, k)).alias("h")))).alias("x")
    least = F.min(F.struct("target_path", "target", "file")).alias("t")
    asked = named.join(sent(cut(wanted.select("file").distinct())), "file", "left_semi")
    filed = asked.select("target_path", "target", "file", begun(c("target_path"))).groupBy("x.h").agg(least)
    found = wanted.select("key", "path", "file", begun(c("path"))).select("key", "path", "file", "x.k", "x.h").join(filed, "h")
    found = found.where((c("file") == c("t.file")) & (F.left("path", c("k")) == F.left(c("t.target_path"), c("k"))))
    return found.groupBy("key").agg(F.min(F.struct((-c("k")).alias("k"), "t.target_path", "t.target")).alias("best")).select("key", c("best.target").alias("target"))


def imports(s: DataFrame, names: tuple[DataFrame, DataFrame], by_name: DataFrame, members: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Imports, References and DependsOn edges of files.

    An import is tried as a qualified name (one name, all of a package, a member of a type), else as a path from the
    importing folder, from the root, by its file name with the longest common beginning, and then as a package.
    """
    spec = s.where("kind = 'file'").select(c("id").alias("source"), "path", "language", F.posexplode("imports").alias("n", "i")).select("source", "path", "language", F.concat_ws("\t", "source", "n").alias("key"), c("i.path").alias("spec"), c("i.name").alias("name"))
    spec = cut(spec)
    script = c("language").isin("typescript", "javascript")
    joined = normalize_path(F.concat(folder_of("path"), F.lit("/"), "spec"))
    stem = F.regexp_replace(F.regexp_replace(F.when(script & c("spec").startswith("."), joined).otherwise(c("spec")), r"\.(tsx?|jsx?)$", ""), "/index$", "")
    full = F.concat(stem, F.when(c("language") == "rust", "::").otherwise("."), "name")
    one = spec.where("name not in ('*', '')").withColumn("qualified", full).join(by_name, "qualified").select("key", "source", "target", "target_path")
    packaged = s.where("language = 'java' and kind in ('class', 'interface') and owner is null").select("id", "path", F.expr("left(qualified, greatest(length(qualified) - length(name) - 1, 0))").alias("spec"))
    every = spec.where("name = '*'").join(packaged.select("spec", c("id").alias("target"), c("path").alias("target_path")), "spec").select("key", "source", "target", "target_path")
    static = spec.join(members.select(c("type").alias("spec"), "name", c("id").alias("target")), ["spec", "name"]).join(s.select(c("id").alias("target"), c("path").alias("target_path")), "target").select("key", "source", "target", "target_path")
    exact = cut(one.unionByName(every).unionByName(static).distinct())
    files = s.where("kind = 'file'").select(c("path").alias("target_path"), c("id").alias("file_id"))
    out = exact.select("source", "target", F.lit("References").alias("edge_type")).unionByName(exact.join(files, "target_path").select("source", c("file_id").alias("target"), F.lit("Imports").alias("edge_type")))

    # as a path; a name in a package may be a file, too
    left = spec.join(exact.select("key").distinct(), "key", "left_anti").where("spec != ''")
    slashed = F.when(c("language") == "rust", F.regexp_replace(F.regexp_replace("spec", "^crate", "src"), "::", "/")).when(c("language").isin("python", "java"), F.regexp_replace("spec", r"\.", "/")).otherwise(F.regexp_replace("spec", r"[?#].*$", ""))
    bases = [normalize_path(F.concat(folder_of("path"), F.lit("/"), "slashed")), normalize_path("slashed")]
    bases = [F.concat(b, F.lit("/"), "name") for b in bases] + bases
    tries = F.array(*(F.struct(F.lit(k).alias("rank"), F.concat(b, F.lit(e)).alias("to")) for k, (b, e) in enumerate((b, e) for b in bases for e in FILE_ENDINGS)))
    want = left.withColumn("slashed", slashed).select("key", F.explode(tries).alias("t")).select("key", "t.rank", "t.to")
    have = files.select(c("target_path").alias("to"), c("file_id").alias("target"))
    near = want.join(have, "to").groupBy("key").agg(F.min_by("target", "rank").alias("target"))
    # by the file name
    base_name = F.regexp_extract("spec", r"([^/]*)$", 1)
    loose = left.where("language in ('markdown', 'typescript', 'javascript')").join(near, "key", "left_anti").select("key", "path", F.explode(F.array_distinct(F.array(base_name, F.regexp_replace(base_name, r"\.[^.]*$", "")))).alias("file")).where("file != ''")
    last = F.regexp_extract("target_path", r"([^/]*)$", 1)
    named = files.select("target_path", c("file_id").alias("target"), F.explode(F.array_distinct(F.array(last, F.regexp_replace(last, r"\.[^.]*$", "")))).alias("file"))
    alike = nearest_paths(loose, named)
    found = cut(near.unionByName(alike))
    out = out.unionByName(left.join(found, "key").select("source", "target", F.lit("Imports").alias("edge_type")))
    rest = left.join(found, "key", "left_anti")
    if dependencies is not None:
        deps = dependencies.select(c("name").alias("dep")).distinct()
        root = F.regexp_extract(dependency_root("spec"), r"^(@[^/]+/[^/]+|[^/.:]+)", 1)
        out = out.unionByName(rest.withColumn("dep", root).join(deps, "dep").select("source", F.concat(F.lit("dep:"), "dep").alias("target"), F.lit("DependsOn").alias("edge_type")))
    asked = rest.where("name not in ('*', '')").select("key", "source", "path", "name")
    out = out.unionByName(asked.join(bare_names(asked.select("key", "path", "name"), names), "key").select("source", "target", F.lit("References").alias("edge_type")))
    return out.where("source != target").distinct()


# -- facts ---------------------------------------------------------------------------------


def symbol_nodes(s: DataFrame) -> DataFrame:
    """The nodes of files and symbols, with the facts that the parsers found."""
    own, code = c("kind") == "file", ~c("kind").isin("file", "heading")
    long = lambda x, when=None: (F.when(when, c(x)) if when is not None else c(x)).cast("long")
    return s.select(
        "id", F.when(own, c("path")).otherwise(c("name")).alias("name"), "node_type", c("path").alias("file"), long("start_line", ~own).alias("start_line"), long("end_line", ~own).alias("end_line"), c("docstring").alias("description"),
        F.when(own, c("end_line")).otherwise(c("end_line") - c("start_line") + 1).cast("long").alias("loc"), long("code_lines", ~(c("kind") == "heading")).alias("code_lines"), long("comment_lines", ~(c("kind") == "heading")).alias("comment_lines"), long("doc_lines", code).alias("doc_lines"),
        long("params", c("kind") == "function").alias("params"), long("nesting", c("kind") == "function").alias("max_nesting"), F.when(F.trim(F.coalesce("docstring", F.lit(""))) != "", 1).otherwise(0).cast("long").alias("has_doc"),
        F.when(code, ((c("comment_lines") > 0) | (c("doc_lines") > 0)).cast("long")).alias("has_comments"), is_test("path", "node_type", F.transform("annotations", lambda a: a["name"]), "classification").cast("long").alias("is_test"), "language", "classification", folder_of("path").alias("folder"),
        c("qualified").alias("qualified_name"), "route", F.nullif(F.array_join(F.transform("annotations", lambda a: a["name"]), ","), F.lit("")).alias("annotations"),
    )


def boundary_tags(s: DataFrame) -> DataFrame:
    """(id, place, kind, direction, protocol, detail) of the symbols' boundaries."""
    code = s.where("kind in ('function', 'class', 'interface')")
    calls_ = F.transform("calls", lambda k: F.struct(k["name"].alias("name"), F.when(k["owner_type"].isNotNull(), F.regexp_extract(k["owner_type"], r"([^.:/#|]*)$", 1)).otherwise(k["owner"]).alias("owner"), k["arg"].alias("arg")))
    rows = code.select("id", F.regexp_replace("language", "^javascript$", "typescript").alias("language"), "kind", "name", c("owner_qualified").alias("owner"), "route", "annotations", F.transform(F.concat(F.coalesce("extends", F.array()), F.coalesce("implements", F.array())), lambda t: F.substring_index(t, "|", 1)).alias("supertypes"), calls_.alias("calls"))
    owners = code.where("kind != 'function' and qualified is not null").select(c("qualified").alias("owner"), "annotations").dropDuplicates(["owner"])
    order = F.create_map(*(F.lit(x) for k, r in enumerate(classify.BOUNDARY_RULES) for x in (r[1], k)))
    return classify.boundaries(rows, owners).withColumn("place", F.try_element_at(order, c("source"))).drop("source")


def with_facts(nodes: DataFrame, edges: DataFrame, s: DataFrame) -> DataFrame:
    """The nodes with degrees, members and boundaries, in the columns of ``NODES``."""
    return with_boundaries(nodes.join(facts.degree_facts(nodes, edges), "id", "left"), s)


def with_boundaries(nodes: DataFrame, s: DataFrame) -> DataFrame:
    """The nodes in the columns of ``NODES``, with boundaries; null where they lack a column, 0 if that is a number of edges."""
    nodes = nodes.select("*", *(F.lit(0).alias(x) for x in ("in_degree", "out_degree") if x not in nodes.columns))
    found = facts.boundary_facts(boundary_tags(s))
    out = nodes.join(found.withColumn("boundary", F.lit(1)), "id", "left").fillna(0, ["in_degree", "out_degree", "boundary", "boundary_in", "boundary_out"])
    return out.select(*((c(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES))
