"""Directed labelled graphs as two DataFrames.

``vertices`` has ``id`` and ``attr`` (long), ``edges`` has ``src``, ``dst`` (long) and ``weight`` (double).
Each vertex and each (src, dst) stands once; self-loops are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recovery import cut

LABELS = 100


def label(id_col: str | Column = "id", modulus: int = LABELS) -> Column:
    """A vertex's label: its id modulo ``modulus``, with the sign of the id."""
    return (F.col(id_col) if isinstance(id_col, str) else id_col) % F.lit(modulus).cast("long")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    modulus: int = LABELS

    @staticmethod
    def from_edges(edges: DataFrame, isolated: DataFrame | None = None, modulus: int = LABELS, written: bool = False) -> Graph:
        """Vertices are the ends of edges, and ``isolated`` (``id``). Of repeated edges the least weight stays (1.0 without weights).

        ``written``: edges and vertices are computed once into the shared folder, the vertices from the edges there.
        """
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), weight.alias("weight"))
        rows = rows.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
        rows = cut(rows) if written else rows
        ids = rows.select(F.explode(F.array("src", "dst")).alias("id"))
        if isolated is not None:
            ids = ids.union(isolated.select(F.col("id").cast("long")))
        vertices = ids.distinct().select("id", label("id", modulus).alias("attr"))
        return Graph(cut(vertices) if written else vertices, rows, modulus)

    def cut(self) -> Graph:
        """The same graph, computed once into the shared folder."""
        return Graph(cut(self.vertices), cut(self.edges), self.modulus)

    # accessors
    def out_edges(self, ids: DataFrame) -> DataFrame:
        return self.edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "weight")

    def in_edges(self, ids: DataFrame) -> DataFrame:
        return self.edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "weight")

    def edge(self, src: int, dst: int) -> DataFrame:
        """The edge between two vertices; no row if there is none."""
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst))

    def has(self, vertex: int) -> bool:
        return not self.vertices.where(F.col("id") == vertex).isEmpty()

    def node_count(self) -> int:
        return self.vertices.count()

    # degrees and adjacency
    def out_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))

    def in_degree(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))

    def adjacency(self) -> DataFrame:
        """``id`` and its targets in ascending order with their weights; a hub's list is one row, so prefer ``edges``."""
        pairs = F.array_sort(F.collect_list(F.struct("dst", "weight")))
        return self.edges.groupBy(F.col("src").alias("id")).agg(pairs.alias("a")).select("id", F.col("a.dst").alias("targets"), F.col("a.weight").alias("weights"))

    def without_in_edges(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.col("dst").alias("id")), "id", "left_anti")

    def without_out_edges(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")

    def isolated(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")

    # other graphs
    def symmetrised(self) -> Graph:
        both = self.edges.union(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        return Graph(self.vertices, both.groupBy("src", "dst").agg(F.min("weight").alias("weight")), self.modulus)

    def with_vertices(self, ids: DataFrame) -> Graph:
        """Adds vertices; those that exist stay as they are."""
        new = ids.select(F.col("id").cast("long")).distinct().join(self.vertices, "id", "left_anti")
        return Graph(self.vertices.union(new.select("id", label("id", self.modulus).alias("attr"))), self.edges, self.modulus)

    def with_edges(self, edges: DataFrame) -> Graph:
        """Adds edges, or replaces the weights of those that exist, and adds missing ends."""
        new = Graph.from_edges(edges, modulus=self.modulus)
        rest = self.edges.join(new.edges, ["src", "dst"], "left_anti").select("src", "dst", "weight")
        return Graph(self.with_vertices(new.vertices).vertices, rest.union(new.edges), self.modulus)

    def without_vertices(self, ids: DataFrame) -> Graph:
        """Removes vertices with all edges at them."""
        ids = ids.select(F.col("id").cast("long")).distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.vertices.join(ids, "id", "left_anti"), edges.select("src", "dst", "weight"), self.modulus)

    def only_labels(self, labels: DataFrame) -> Graph:
        """Keeps vertices whose ``attr`` is among ``labels``, and the edges between them."""
        kept = self.vertices.join(labels.select("attr").distinct(), "attr", "left_semi").select("id", "attr")
        ids = kept.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(kept, edges.select("src", "dst", "weight"), self.modulus)
