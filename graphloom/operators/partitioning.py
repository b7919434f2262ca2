"""Edge-cut borders, vertex-cut replicas and the messages between them.

Results of the iterative queries never depend on these; they describe how a graph lies over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph


def edge_part(k: int, src: str = "src", dst: str = "dst") -> Column:
    """Partition of an edge in a vertex-cut."""
    return (F.pmod(F.col(src) * 31 + F.col(dst), F.lit(k).cast("long"))).cast("int")


def vertex_part(k: int, id_col: str = "id") -> Column:
    """Partition of a vertex in an edge-cut."""
    return F.pmod(F.col(id_col), F.lit(k).cast("long")).cast("int")


def placed_edges(graph: Graph, k: int) -> DataFrame:
    return graph.edges.select("src", "dst", "weight", edge_part(k).alias("part"))


def partition_sizes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("part").agg(F.count(F.lit(1)).alias("n_edges"))


# vertex-cut: each edge has one partition, a vertex has a replica wherever an edge of it is
def replicas(placed: DataFrame) -> DataFrame:
    """(part, id, master_part): the master is the replica in the lowest partition."""
    found = placed.select("part", F.explode(F.array("src", "dst")).alias("id")).distinct()
    lowest = found.groupBy("id").agg(F.min("part").alias("master_part"))
    return found.join(lowest, "id").select("part", "id", "master_part")


def masters(placed: DataFrame) -> DataFrame:
    """(part, id, mirror_parts): the master of each vertex and where its mirrors are, ascending."""
    found = replicas(placed).groupBy("id", "master_part").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    return found.select(F.col("master_part").alias("part"), "id", F.filter("parts", lambda p: p != F.col("master_part")).alias("mirror_parts"))


def mirrors(placed: DataFrame) -> DataFrame:
    """(part, id, master_part) of the replicas that are not masters."""
    return replicas(placed).where("part <> master_part")


def with_replicas(known: DataFrame, new: DataFrame) -> DataFrame:
    """``masters`` or ``mirrors`` with rows added; a row of ``new`` takes the place of the one that its part has of the vertex.

    Replicas do not make vertices: a vertex that only a mirror names is not in the graph.
    """
    new = new.select(known.columns)
    return known.join(new.select("part", "id"), ["part", "id"], "left_anti").select(known.columns).union(new)


def without_replicas(known: DataFrame, ids: DataFrame) -> DataFrame:
    """``masters`` or ``mirrors`` without those of ``ids``, as when vertices are removed."""
    return known.join(ids.select("id").distinct(), "id", "left_anti").select(known.columns)


def replication_factor(placed: DataFrame) -> DataFrame:
    """One row: vertices, replicas and replicas to a vertex."""
    return replicas(placed).agg(F.countDistinct("id").alias("n_vertices"), F.count(F.lit(1)).alias("n_replicas")).select("n_vertices", "n_replicas", (F.col("n_replicas") / F.col("n_vertices")).alias("factor"))


def to_master(changed: DataFrame, mirror_rows: DataFrame) -> DataFrame:
    """Messages of changed mirrors (part, id, ...) to their master's partition: (dst_part, id, ...)."""
    values = [c for c in changed.columns if c not in ("part", "id")]
    return changed.join(mirror_rows, ["part", "id"]).select(F.col("master_part").alias("dst_part"), "id", *values)


def to_mirrors(changed: DataFrame, master_rows: DataFrame) -> DataFrame:
    """Messages of changed masters (part, id, ...) to every mirror's partition: (dst_part, id, ...)."""
    values = [c for c in changed.columns if c not in ("part", "id")]
    return changed.join(master_rows, ["part", "id"]).select(F.explode("mirror_parts").alias("dst_part"), "id", *values)


def message_sizes(messages: DataFrame) -> DataFrame:
    return messages.groupBy("dst_part").agg(F.count(F.lit(1)).alias("n_messages"))


# edge-cut: each vertex has one partition, an edge between two partitions is on the border
def with_owners(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with the partitions of both ends, looked up in ``parts`` (node, part)."""
    a = parts.select(F.col("node").alias("src"), F.col("part").alias("src_part"))
    b = parts.select(F.col("node").alias("dst"), F.col("part").alias("dst_part"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "weight", "src_part", "dst_part")


def owned_by_id(graph: Graph, k: int) -> DataFrame:
    return graph.edges.select("src", "dst", "weight", vertex_part(k, "src").alias("src_part"), vertex_part(k, "dst").alias("dst_part"))


def inner_edges(owned: DataFrame) -> DataFrame:
    return owned.where("src_part = dst_part").select(F.col("src_part").alias("part"), "src", "dst", "weight")


def border_out(owned: DataFrame) -> DataFrame:
    """F.O of each partition: targets elsewhere of its edges (part, outer, own, weight, other_part)."""
    return owned.where("src_part <> dst_part").select(F.col("src_part").alias("part"), F.col("dst").alias("outer"), F.col("src").alias("own"), "weight", F.col("dst_part").alias("other_part"))


def border_in(owned: DataFrame) -> DataFrame:
    """F.I of each partition: own vertices that edges from elsewhere reach (part, own, outer, weight, other_part)."""
    return owned.where("src_part <> dst_part").select(F.col("dst_part").alias("part"), F.col("dst").alias("own"), F.col("src").alias("outer"), "weight", F.col("src_part").alias("other_part"))
