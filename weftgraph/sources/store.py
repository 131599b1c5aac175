"""The stored graph: versioned Parquet snapshots with a pointer, and ways out of it."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, FILES = 1, 32


class StoreMismatch(ValueError):
    """The store was written in another format, width or model; it has to be rebuilt."""


@dataclass
class About:
    format: int = FORMAT
    width: int = 0
    model: str = ""
    snapshot: str = ""


class GraphStore:
    """``<path>/about.json`` names the snapshot folder whose ``nodes`` and ``edges`` tables count.

    A snapshot is written whole beside the old one, then the pointer is written beside its old version and
    renamed onto it, so that a job that dies leaves the old snapshot in place and readers never see half of
    one. Where the file system doesn't rename over a file there is an instant without a pointer; ``_read``
    then takes the newest one that is whole.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 0, model: str = ""):
        self.spark, self.path = spark, path.rstrip("/")
        about = self._read()
        if about and (about.format != FORMAT or width and about.width != width or model and about.model != model):
            raise StoreMismatch(f"the store at {path} has format {about.format}, width {about.width} and model {about.model!r}")
        self.about = about or About(width=width, model=model)

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/about.json")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self) -> About | None:
        fs, p = self._fs()
        if not fs.exists(p):
            left = sorted(fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/about-*.json")) or [], key=lambda f: f.getModificationTime())
            if not left:
                return None
            p = left[-1].getPath()
        return About(**json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0]))

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Replace the graph; nodes lie together by type, edges by source, so that filters and joins skip files."""
        name = uuid.uuid4().hex
        spread = F.pmod(F.xxhash64("id"), F.lit(FILES))  # one type may hold most of the nodes
        nodes.repartition(F.col("node_type"), spread).sortWithinPartitions("node_type", "id").write.partitionBy("node_type").parquet(f"{self.path}/{name}/nodes")
        edges.repartitionByRange("source").sortWithinPartitions("source").write.parquet(f"{self.path}/{name}/edges")
        self.about.snapshot = name
        fs, p = self._fs()
        beside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/about-{name}.json")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(asdict(self.about)).encode()))
        out.close()
        if not fs.rename(beside, p):  # on file systems that don't rename over a file
            fs.delete(p, False)
            fs.rename(beside, p)

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.about.snapshot}/nodes")

    def edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.about.snapshot}/edges")

    def fetch(self, ids: list[str]) -> DataFrame:
        """The nodes of these ids, in their order."""
        wanted = self.spark.createDataFrame([(i, k) for k, i in enumerate(dict.fromkeys(ids))], "id string, place int")
        return self.nodes().join(F.broadcast(wanted), "id").orderBy("place").drop("place")  # as many rows as ids were given

    def counts(self) -> tuple[int, int]:
        return self.nodes().count(), self.edges().count()


def write_all(stores: list[GraphStore], nodes: DataFrame, edges: DataFrame) -> None:
    """The same graph to several stores of one vector width, computed once."""
    if len({s.about.width for s in stores}) > 1:
        raise StoreMismatch("the stores have vectors of different width")
    nodes, edges = nodes.persist(), edges.persist()
    try:
        for s in stores:
            s.write(nodes, edges)
    finally:
        nodes.unpersist()
        edges.unpersist()


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One record a line in as many files as there are partitions: {"nodes": [one]} or {"edges": [one]}; ``read_graph_json`` reads them, too."""
    as_one = lambda df, name: df.select(F.to_json(F.struct(F.array(F.struct(*df.columns)).alias(name))).alias("value"))
    as_one(nodes, "nodes").unionByName(as_one(edges, "edges")).write.text(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON document {nodes: [...], edges: [...]}, or of a folder of such documents, one a line."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    whole = spark.read.json(path, multiLine=not folder)
    return whole.select(F.explode("nodes").alias("n")).select("n.*"), whole.select(F.explode("edges").alias("e")).select("e.*")


def retarget(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Paths of a column that begin with one folder, moved under another."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return df.withColumn(column, F.when(F.col(column).startswith(old + "/"), F.concat(F.lit(new), F.substr(column, F.lit(len(old) + 1)))).otherwise(F.col(column)))


def scrub(df: DataFrame, root: str, public: str = ".") -> DataFrame:
    """Every string column without the local folder, for publishing."""
    return df.select(*(F.replace(F.col(c), F.lit(root.rstrip("/")), F.lit(public)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
