"""weftgraph: property-graph analytics and retrieval as Spark DataFrames."""

__version__ = "0.1.0"
