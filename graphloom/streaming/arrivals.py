"""Edges that arrive as a stream, with answers kept up to date (for queries whose values only improve)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import labels, shortest_paths
from ..operators.graph import Graph
from ..operators.recovery import shared_dir


class Maintained:
    """The graph so far and a result over it; each batch of edges continues from the result of the batch before.

    All state lies in ``folder`` as Parquet, by number of batch: the edges that each brought, and the result after it.
    A batch reads what earlier ones have finished and writes only its own folders, so it can run again after a failure,
    and a query that starts again, with the same ``folder``, goes on from the last finished batch. Without a folder a new one is made.
    """

    def __init__(self, continued: Callable[[Graph, DataFrame | None, DataFrame], DataFrame], folder: str | None = None):
        self.continued, self.folder = continued, folder

    def _done(self, spark: SparkSession, kind: str) -> list[int]:
        """Batches of which ``kind`` is written whole, in order."""
        to_path = spark._jvm.org.apache.hadoop.fs.Path
        at = to_path(f"{self.folder}/{kind}")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(p.getName().split("-")[1]) for p in found if files.exists(to_path(p, "_SUCCESS")))

    def take(self, edges: DataFrame, batch: int) -> None:
        spark = edges.sparkSession
        self.folder = self.folder or f"{shared_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
        before = [k for k in self._done(spark, "result") if k < batch]
        own = f"{self.folder}/edges/batch-{batch}"
        edges.select("src", "dst", *(["weight"] if "weight" in edges.columns else [F.lit(1.0).alias("weight")])).write.mode("overwrite").parquet(own)
        rows = spark.read.parquet(own)
        known = [f"{self.folder}/edges/batch-{k}" for k in self._done(spark, "edges") if k <= batch]
        graph = Graph.from_edges(spark.read.parquet(*known), written=True)
        old = spark.read.parquet(f"{self.folder}/result/batch-{before[-1]}") if before else None
        self.continued(graph, old, rows).write.mode("overwrite").parquet(f"{self.folder}/result/batch-{batch}")

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/result/batch-{self._done(spark, 'result')[-1]}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda rows, batch: self.take(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintained_sssp(source: int, folder: str | None = None) -> Maintained:
    def go(graph: Graph, old: DataFrame | None, edges: DataFrame) -> DataFrame:
        if old is None:
            return shortest_paths.sssp(graph, source)
        start = graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist"))
        reached = old.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"))
        return shortest_paths.sssp_continue(graph, old, reached.union(start))

    return Maintained(go, folder)


def maintained_min_label(folder: str | None = None) -> Maintained:
    def go(graph: Graph, old: DataFrame | None, edges: DataFrame) -> DataFrame:
        if old is None:
            return labels.min_label(graph)
        new = graph.vertices.select("id", F.col("id").alias("label"))
        known = old.union(new.join(old, "id", "left_anti"))
        return labels.min_label_continue(graph, known, known.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "label"))

    return Maintained(go, folder)
