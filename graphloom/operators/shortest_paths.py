"""Single-source shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .recovery import ByKey, cut
from .supersteps import Metrics, relax, settle, sweep


def _rounds(graph: Graph, state: DataFrame, metrics: Metrics | None, most: int | None = None) -> DataFrame:
    edges = ByKey(graph.edges.select("src", "dst", "weight"), "src")

    def step(state: DataFrame) -> DataFrame:
        frontier = state.where("changed").select(F.col("id").alias("src"), "dist")
        found = edges.join(frontier).select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"))
        return relax(state, found if metrics is None else metrics.counting(found), "dist")

    if most is None:
        state = settle(state, step, metrics)
    else:
        for _ in range(most):
            state = step(state)
        state = cut(state)
    edges.release()
    return state


def sssp(graph: Graph, source: int, metrics: Metrics | None = None) -> DataFrame:
    """``id`` and ``dist`` of every vertex that ``source`` reaches, itself at 0.0; weights may not be negative.

    A source that is not in the graph reaches nothing.
    """
    start = graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("changed"))
    return _rounds(graph, start, metrics).select("id", "dist")


def sssp_rounds(graph: Graph, source: int, rounds: int) -> DataFrame:
    """Distances over at most ``rounds`` edges."""
    start = graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("changed"))
    return _rounds(graph, start, None, rounds).select("id", "dist")


def sssp_continue(graph: Graph, state: DataFrame, messages: DataFrame, metrics: Metrics | None = None) -> DataFrame:
    """Take improving ``messages`` (``id``, ``dist``) into a finished ``state`` and go on to the new fixpoint."""
    return _rounds(graph, relax(state, messages, "dist"), metrics).select("id", "dist")


def hops_along(paths: DataFrame, source: int) -> DataFrame:
    """``sssp`` over weights of 1.0 in a graph that is given as ``paths`` (``path``, ``at`` rising by one, ``id``; see ``sweep``)."""
    rows = paths.select("path", "at", "id", F.col("at").cast("double").alias("far"), F.when(F.col("id") == source, F.lit(0.0)).alias("dist"))
    return sweep(rows, "dist").where("dist IS NOT NULL").select("id", "dist").distinct()
