"""PageRank by accumulated changes, unnormalised.

Every vertex starts at rank 1. A vertex in the frontier adds the change that it received to its sum, takes
the rank damping * sum + 1 - damping, and passes the difference on, divided by its out-degree, if that is
over the threshold; smaller differences are dropped. Vertices without in-edges keep rank 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .recovery import ByKey, cut
from .supersteps import Metrics, settle

DAMPING, THRESHOLD = 0.85, 0.01


def shares(graph: Graph) -> DataFrame:
    """Edges with the out-degree of their source."""
    return graph.edges.select("src", "dst").join(graph.out_degree().select(F.col("id").alias("src"), F.col("out_degree").alias("degree")), "src")


def initial(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """The state before the first round: ``id``, ``pr``, ``acc`` and ``diff`` (null where nothing came in)."""
    edges = edges if edges is not None else shares(graph)
    received = edges.groupBy(F.col("dst").alias("id")).agg(F.sum(F.lit(1.0) / F.col("degree")).alias("diff"))
    return graph.vertices.select("id").join(received, "id", "left").select("id", F.lit(1.0).alias("pr"), F.lit(0.0).alias("acc"), "diff")


def round_of(state: DataFrame, edges: ByKey, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """One round over the whole state; ``error`` is how far a rank moved (null outside the frontier)."""
    took = state.select("id", "pr", F.when(F.col("diff").isNotNull(), F.col("acc") + F.col("diff")).otherwise(F.col("acc")).alias("acc"), "diff")
    rank = F.when(F.col("diff").isNotNull(), F.lit(damping) * F.col("acc") + F.lit(1.0) - F.lit(damping)).otherwise(F.col("pr"))
    took = took.select("id", "acc", rank.alias("pr"), F.when(F.col("diff").isNotNull(), rank - F.col("pr")).alias("move"))
    pushed = edges.join(took.where(F.abs("move") > threshold).select(F.col("id").alias("src"), "move"))
    none = F.lit(None).cast("double")
    both = took.select("id", "pr", "acc", F.abs("move").alias("error"), none.alias("diff")).union(pushed.select(F.col("dst").alias("id"), none, none, none, (F.col("move") / F.col("degree"))))
    return both.groupBy("id").agg(F.max("pr").alias("pr"), F.max("acc").alias("acc"), F.max("error").alias("error"), F.sum("diff").alias("diff"))


def pagerank(graph: Graph, damping: float = DAMPING, threshold: float = THRESHOLD, metrics: Metrics | None = None, errors: list[float] | None = None) -> DataFrame:
    """``id`` and ``pr`` when the frontier is empty. ``errors`` gets the largest move of each round."""
    edges = cut(shares(graph))
    laid = ByKey(edges, "src")
    start = initial(graph, edges).select("id", "pr", "acc", F.lit(None).cast("double").alias("error"), "diff", F.col("diff").isNotNull().alias("changed"))
    moves: list[float | None] = []

    def step(state: DataFrame) -> DataFrame:
        return round_of(state, laid, damping, threshold).withColumn("changed", F.col("diff").isNotNull())

    out = settle(start, step, metrics, also=F.max("error"), values=moves).select("id", "pr")
    laid.release()
    if errors is not None:
        errors += [m or 0.0 for m in moves[1:]]
    return out


def pagerank_rounds(graph: Graph, rounds: int, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """The state after a fixed number of rounds: ``id``, ``pr``, ``acc``, ``error`` and ``diff``."""
    edges = cut(shares(graph))
    laid = ByKey(edges, "src")
    state = initial(graph, edges).select("id", "pr", "acc", F.lit(None).cast("double").alias("error"), "diff")
    for _ in range(rounds):
        state = cut(round_of(state, laid, damping, threshold))
    laid.release()
    return state
