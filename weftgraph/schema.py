"""Vocabulary and schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

#: fixed values: the names of node types, edge types and facts
NODE_TYPES = ("File", "Folder", "Function", "Class", "Interface", "Concept", "Dependency", "Config", "Constant", "Variable", "Route", "Unknown")
EDGE_TYPES = ("DependsOn", "Calls", "Extends", "Implements", "References", "Contains", "Imports", "Exports", "Requires", "Uses", "Overrides", "Instantiates", "Unknown")

#: fixed values: edges over which a change spreads (Contains never), couples and uses
IMPACT_EDGES = ("Calls", "References", "Imports", "Extends", "Implements", "Overrides")
COUPLING_EDGES = ("Calls", "References", "Imports", "Extends", "Implements")
USAGE_EDGES = ("Calls", "References", "Imports", "Extends", "Implements", "Overrides", "Instantiates", "Uses")
SYMBOL_TYPES = ("Function", "Class", "Interface")

INT_FACTS = ("loc", "code_lines", "comment_lines", "doc_lines", "params", "max_nesting", "members", "has_doc", "has_comments", "is_test", "in_degree", "out_degree", "boundary", "boundary_in", "boundary_out")
TEXT_FACTS = ("language", "classification", "folder", "qualified_name", "route", "annotations", "boundary_kinds", "boundary_protocols", "boundary_detail")
BASE_COLUMNS = ("id", "name", "node_type", "file", "start_line", "end_line", "description")
PROPERTIES = BASE_COLUMNS[1:6] + INT_FACTS + TEXT_FACTS

NODES = T.StructType(
    [T.StructField(c, T.LongType() if c.endswith("_line") else T.StringType()) for c in BASE_COLUMNS]
    + [T.StructField(c, T.LongType()) for c in INT_FACTS]
    + [T.StructField(c, T.StringType()) for c in TEXT_FACTS]
)
EDGES = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "edge_type")])

#: fixed values: weight of each edge type in random walks; other types weigh DEFAULT_WEIGHT
EDGE_WEIGHTS = {"Calls": 1.0, "Extends": 0.9, "Implements": 0.9, "Overrides": 0.9, "Instantiates": 0.8, "Imports": 0.7, "Requires": 0.7, "Exports": 0.6, "Uses": 0.6, "References": 0.5, "DependsOn": 0.4, "Contains": 0.3}
DEFAULT_WEIGHT = 0.5
