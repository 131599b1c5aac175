"""The named statistical queries, as DataFrames over ``nodes`` and ``edges``.

A preset is a record: its category, its parameters with defaults (the type of
the default is the type of the parameter; ``REQUIRED`` has none) and a function
(nodes, edges, **parameters) -> DataFrame. Lists stop at ``CAP`` rows and end
their sort with the id, so that a cut never depends on the order of ties.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reach import distinct_reach, path_counts
from ..schema import COUPLING_EDGES, IMPACT_EDGES, SYMBOL_TYPES

CAP = 200
REQUIRED = object()


@dataclass(frozen=True)
class Preset:
    name: str
    category: str
    about: str
    run: Callable[..., DataFrame]
    params: dict[str, object] = field(default_factory=dict)
    reads: tuple[str, ...] = ()  # properties, for coverage


PRESETS: dict[str, Preset] = {}


def preset(category: str, about: str, reads: str = "", **params):
    def add(run):
        PRESETS[run.__name__] = Preset(run.__name__, category, about, run, params, tuple(reads.split()))
        return run

    return add


c = F.col


def _symbols(n: DataFrame) -> DataFrame:
    return n.where(c("node_type").isin(*SYMBOL_TYPES))


def _functions(n: DataFrame) -> DataFrame:
    return n.where(c("node_type") == "Function")


def _types(n: DataFrame) -> DataFrame:
    return n.where(c("node_type").isin("Class", "Interface"))


def _code(n: DataFrame) -> DataFrame:
    return n.where(~c("node_type").isin("File", "Folder"))


def _top(df: DataFrame, *keys: Column, last: str = "id") -> DataFrame:
    return df.orderBy(*keys, c(last)).limit(CAP)


def _down(name: str) -> Column:
    return c(name).desc_nulls_last()


count = lambda name: F.count("*").alias(name)
USED, USES, NESTING = "in_degree as depended_on_by", "out_degree as depends_on", "max_nesting as nesting"


# -- what is there -------------------------------------------------------------------------


@preset("census", "nodes of each type")
def repo_census(n, e):
    return n.groupBy(c("node_type").alias("kind")).agg(count("symbols")).orderBy(_down("symbols"), "kind")


@preset("census", "files with the most symbols", "file")
def biggest_files(n, e):
    return _top(_code(n).where(c("file") != "").groupBy("file").agg(count("symbols")), _down("symbols"), last="file")


@preset("census", "symbols and code lines of each language", "language code_lines")
def language_breakdown(n, e):
    return _code(n).where("language is not null").groupBy("language").agg(count("symbols"), F.sum("code_lines").alias("code_lines")).orderBy(_down("symbols"), "language")


@preset("census", "nodes of each classification", "classification")
def file_kinds(n, e):
    return n.where("classification is not null and node_type != 'Folder'").groupBy(c("classification").alias("kind")).agg(count("symbols")).orderBy(_down("symbols"), "kind")


@preset("census", "documented symbols that much else uses", "has_doc in_degree loc")
def where_to_start(n, e):
    return _top(_symbols(n).where("has_doc = 1").selectExpr("id", USED, "loc"), _down("depended_on_by"))


# -- size ----------------------------------------------------------------------------------


@preset("size", "functions over so many lines", "loc is_test max_nesting", min_loc=50)
def long_functions(n, e, min_loc):
    return _top(_functions(n).where((c("loc") > min_loc) & (c("is_test") == 0)).selectExpr("id", "loc", NESTING), _down("loc"))


@preset("size", "folders with several long functions", "loc is_test folder", min_loc=50)
def long_functions_by_folder(n, e, min_loc):
    found = _functions(n).where((c("loc") > min_loc) & (c("is_test") == 0)).groupBy("folder").agg(count("functions"), F.avg("loc").alias("avg_loc"))
    return _top(found.where("functions >= 2"), _down("functions"), last="folder")


@preset("size", "functions by size class", "loc")
def size_histogram(n, e):
    # fixed values: the labels and borders of the size classes
    bucket = F.when(c("loc") > 200, "e. 200+").when(c("loc") > 100, "d. 101-200").when(c("loc") > 50, "c. 51-100").when(c("loc") > 20, "b. 21-50").otherwise("a. 0-20")
    return _functions(n).groupBy(bucket.alias("bucket")).agg(count("functions")).orderBy("bucket")


@preset("size", "largest classes and interfaces", "loc out_degree")
def god_classes(n, e):
    return _top(_types(n).selectExpr("id", "loc", USES), _down("loc"))


@preset("size", "functions over so many code lines", "code_lines is_test loc max_nesting", min_loc=50)
def long_functions_by_code(n, e, min_loc):
    return _top(_functions(n).where((c("code_lines") > min_loc) & (c("is_test") == 0)).selectExpr("id", "code_lines", "loc as span", NESTING), _down("code_lines"))


@preset("size", "classes and interfaces by members", "members loc")
def classes_by_members(n, e):
    return _top(_types(n).where("members is not null").select("id", "members", "loc"), _down("members"))


@preset("size", "functions with many parameters", "params", min_params=5)
def param_bloat(n, e, min_params):
    return _top(_functions(n).where(c("params") > min_params).select("id", "params", "loc"), _down("params"))


@preset("size", "deeply nested functions", "max_nesting", min_depth=4)
def deep_nesting(n, e, min_depth):
    return _top(_functions(n).where(c("max_nesting") >= min_depth).selectExpr("id", NESTING, "loc"), _down("nesting"))


# -- comments and documentation ------------------------------------------------------------


@preset("documentation", "commented and documented symbols by type", "has_comments has_doc")
def comment_coverage(n, e):
    return _symbols(n).groupBy(c("node_type").alias("kind")).agg(count("total"), F.sum("has_comments").alias("commented"), F.sum("has_doc").alias("with_doc_comment")).orderBy(_down("total"), "kind")


@preset("documentation", "lines of code, comment and documentation by folder", "code_lines comment_lines doc_lines is_test folder")
def comment_density(n, e):
    found = _functions(n).where("is_test = 0").groupBy("folder").agg(*(F.sum(x).alias(x) for x in ("code_lines", "comment_lines", "doc_lines")))
    return _top(found.where("code_lines > 50"), _down("code_lines"), last="folder")


@preset("documentation", "symbols with one line of documentation", "doc_lines is_test code_lines in_degree")
def token_docs(n, e):
    return _top(_symbols(n).where("doc_lines = 1 and is_test = 0").selectExpr("id", "code_lines", USED), _down("code_lines"))


@preset("documentation", "long nested functions without a comment", "has_comments is_test code_lines max_nesting")
def undercommented_complexity(n, e):
    return _top(_functions(n).where("has_comments = 0 and is_test = 0 and code_lines > 40 and max_nesting >= 3").selectExpr("id", "code_lines", NESTING), _down("code_lines"))


@preset("documentation", "documented symbols by type", "has_doc")
def doc_coverage(n, e):
    return _symbols(n).groupBy(c("node_type").alias("kind")).agg(count("total"), F.sum("has_doc").alias("documented")).orderBy(_down("total"), "kind")


@preset("documentation", "documented symbols by folder, least first", "has_doc is_test folder")
def doc_coverage_by_folder(n, e):
    found = _symbols(n).where("is_test = 0").groupBy("folder").agg(count("total"), F.sum("has_doc").alias("documented")).where("total >= 5")
    return _top(found, c("documented"), _down("total"), last="folder")


@preset("documentation", "undocumented symbols that much else uses", "has_doc is_test in_degree")
def undocumented_hotspots(n, e):
    return _top(_symbols(n).where("has_doc = 0 and is_test = 0").selectExpr("id", USED, "loc"), _down("depended_on_by"))


# -- dead code and coupling ----------------------------------------------------------------


@preset("dead code", "symbols that nothing uses", "in_degree is_test loc")
def dead_code(n, e):
    return _top(_symbols(n).where("in_degree = 0 and is_test = 0").select("id", "loc"), _down("loc"))


@preset("dead code", "files that nothing uses", "in_degree")
def orphan_files(n, e):
    return _top(n.where("node_type = 'File' and in_degree = 0").select("id"))


@preset("dead code", "function names that recur")
def duplicate_names(n, e):
    return _top(_functions(n).groupBy("name").agg(count("definitions")).where("definitions > 3"), _down("definitions"), last="name")


@preset("architecture", "symbols by users", "in_degree")
def dependency_fanin(n, e):
    return _top(_symbols(n).selectExpr("id", USED, "loc"), _down("depended_on_by"))


@preset("architecture", "symbols that use much else", "out_degree", min_fanout=20)
def fanout_offenders(n, e, min_fanout):
    return _top(_code(n).where(c("out_degree") > min_fanout).selectExpr("id", USES, "loc"), _down("depends_on"))


def _ends(n: DataFrame, e: DataFrame, types: tuple[str, ...], column: str) -> DataFrame:
    a = n.select(c("id").alias("source"), c(column).alias("a"))
    b = n.select(c("id").alias("target"), c(column).alias("b"))
    return e.where(c("edge_type").isin(*types)).join(a, "source").join(b, "target")


@preset("architecture", "dependencies between folders", "folder")
def coupling_matrix(n, e):
    found = _ends(n, e, COUPLING_EDGES, "folder").where("a != b").groupBy(c("a").alias("from_folder"), c("b").alias("to_folder")).agg(count("edges"))
    return _top(found, _down("edges"), c("from_folder"), last="to_folder")


@preset("architecture", "dependencies from one part of the tree on another, by file", "folder file", from_prefix=REQUIRED, to_prefix=REQUIRED)
def layering_violations(n, e, from_prefix, to_prefix):
    a = n.where(c("folder").startswith(from_prefix)).select(c("id").alias("source"), c("file").alias("from_file"))
    b = n.where(c("folder").startswith(to_prefix)).select(c("id").alias("target"), c("file").alias("to_file"))
    found = e.where(c("edge_type").isin("Calls", "References", "Imports")).join(a, "source").join(b, "target").groupBy("from_file", "to_file").agg(count("edges"))
    return _top(found, _down("edges"), c("from_file"), last="to_file")


# -- boundaries ----------------------------------------------------------------------------


@preset("architecture", "boundary symbols by kind", "boundary boundary_kinds boundary_protocols boundary_in boundary_out")
def boundary_census(n, e):
    found = n.where("boundary = 1").groupBy(c("boundary_kinds").alias("kinds"), c("boundary_protocols").alias("protocols"))
    return _top(found.agg(F.sum("boundary_in").alias("inbound"), F.sum("boundary_out").alias("outbound"), count("symbols")), _down("symbols"), c("kinds"), last="protocols")


@preset("architecture", "every boundary symbol", "boundary boundary_kinds boundary_detail file")
def boundaries(n, e):
    return _top(n.where("boundary = 1").select("id", c("boundary_kinds").alias("kinds"), c("boundary_detail").alias("surface"), "file"), c("kinds").asc_nulls_last(), c("file").asc_nulls_last())


# -- tests and change impact ---------------------------------------------------------------


@preset("tests", "tests among the functions of each folder", "is_test folder")
def test_ratio(n, e):
    return _top(_functions(n).groupBy("folder").agg(count("functions"), F.sum("is_test").alias("tests")).where("functions >= 5"), _down("functions"), last="folder")


@preset("tests", "used functions that no test reaches in two steps", "is_test in_degree")
def untested_symbols(n, e):
    reached = distinct_reach(e, n.where("is_test = 1").select("id"), 2, ("Calls", "References")).select("id")
    found = _functions(n).where("is_test = 0 and in_degree > 0").join(reached, "id", "left_anti")
    return _top(found.selectExpr("id", USED, "loc"), _down("depended_on_by"))


def _in_files(n: DataFrame, files) -> DataFrame:
    return n.where(c("file").isin(*files)).select("id")


def _dependents(n, e, files, hops=3) -> DataFrame:
    """Nodes outside ``files`` that depend on them, each once."""
    ids = distinct_reach(e, _in_files(n, files), hops, IMPACT_EDGES, "in").select("id")
    return n.join(ids, "id", "left_semi").where(~c("file").isin(*files))


@preset("tests", "tests to run again for a file", "file is_test", target=REQUIRED)
def retest_scope(n, e, target):
    ids = distinct_reach(e, _in_files(n, [target]), 3, IMPACT_EDGES, "in").select("id")
    return _top(n.join(ids, "id", "left_semi").where("is_test = 1").groupBy(c("file").alias("test_file")).agg(count("test_symbols")), _down("test_symbols"), last="test_file")


@preset("tests", "tests that reach a symbol, with their paths", "is_test file", symbol=REQUIRED)
def test_for(n, e, symbol):
    paths = path_counts(e, n.where(c("id") == symbol).select("id"), 2, IMPACT_EDGES, "in")
    return _top(n.where("is_test = 1").join(paths, "id").select(c("id").alias("test"), "file", "paths"), _down("paths"), last="test")


@preset("tests", "tests to run again for changed files", "file is_test", files=[])
def diff_retest_scope(n, e, files):
    return _top(_dependents(n, e, files).where("is_test = 1").groupBy(c("file").alias("test_file")).agg(count("test_symbols")), _down("test_symbols"), last="test_file")


def _impact(n, e, files) -> DataFrame:
    paths = path_counts(e, _in_files(n, files), 3, IMPACT_EDGES, "in")
    found = n.join(paths, "id").where(~c("file").isin(*files)).groupBy("file")
    return _top(found.agg(F.count("*").alias("dependents"), F.sum(c("is_test") * c("paths")).alias("test_paths")), _down("dependents"), last="file")


@preset("risk", "files that depend on a file", "file is_test", target=REQUIRED)
def impact(n, e, target):
    return _impact(n, e, [target])


@preset("risk", "files that depend on changed files", "file is_test", files=[])
def diff_impact(n, e, files):
    return _impact(n, e, files)


@preset("risk", "how much depends on a file", "file", target=REQUIRED)
def impact_summary(n, e, target):
    return _dependents(n, e, [target]).agg(F.count("*").alias("dependents"), F.count_distinct("file").alias("files_affected"))


@preset("risk", "inbound boundaries that a file reaches", "file boundary_in boundary_kinds boundary_detail", target=REQUIRED)
def boundary_impact(n, e, target):
    paths = path_counts(e, _in_files(n, [target]), 3, IMPACT_EDGES, "in")
    found = n.where((c("boundary_in") == 1) & (c("file") != target)).join(paths, "id")
    return _top(found.select(c("id").alias("surface"), c("boundary_kinds").alias("kinds"), c("boundary_detail").alias("exposed_as"), "paths"), _down("paths"), last="surface")


@preset("risk", "large undocumented symbols that much else uses", "in_degree loc has_doc")
def risky_symbols(n, e):
    return _top(_symbols(n).where("in_degree > 5 and loc > 80 and has_doc = 0").selectExpr("id", USED, "loc"), _down("depended_on_by"))
