"""Registered queries against DuckDB on the smallest tables, where these are there."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ["repo_census", "long_functions", "coupling_matrix", "test_for", "k_hop_bfs", "find_usages", "graph_schema", "percentiles", "vector_search", "bm25_score", "rag_messages", "fnv1a_32", "incremental_plan", "raw_gql", "degree_facts", "size_histogram", "boundary_impact", "build_graph", "facts_compute", "override_edges", "package_edges", "heading_nesting", "scan_package_json", "capture_source", "classify_files", "boundary_rules", "gql_varlen", "gql_case", "node_text_full", "upsert_new_edges", "tokenize_names", "bm25_after_changes", "df_after_changes", "vector_index_all_cells", "delta_nodes", "delta_edges", "import_nearest", "extract_comments", "rag_context"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(str([plain(v) for v in r]) for r in found.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_the_subpackage_may_be_left_out(tmp_path):
    """A copy without the two folders and the pipeline offers the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/weftgraph", tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and 'pipeline' not in q and not [x for x in q if x.startswith('op') and x[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, check=True, env=env)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
