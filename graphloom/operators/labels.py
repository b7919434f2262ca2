"""Least-label propagation and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .recovery import ByKey, cut
from .supersteps import Metrics, relax, settle, sweep


def min_label(graph: Graph, metrics: Metrics | None = None) -> DataFrame:
    """``id`` and ``label``: the least id that reaches the vertex along edges, itself included."""
    start = graph.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("changed"))
    return _spread(graph.edges.select("src", "dst"), start, metrics)


def min_label_continue(graph: Graph, state: DataFrame, messages: DataFrame, metrics: Metrics | None = None) -> DataFrame:
    """Take smaller labels (``id``, ``label``) into a finished ``state`` and go on to the new fixpoint."""
    return _spread(graph.edges.select("src", "dst"), relax(state, messages, "label"), metrics)


def min_label_along(paths: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``min_label`` of a graph that is given as ``paths`` (``path``, ``at``, ``id``; see ``sweep``), whatever their lengths.

    Goes on from a finished ``state`` (``id``, ``label``) of fewer paths if there is one.
    """
    rows = paths.select("path", "at", "id", F.lit(0).cast("long").alias("far"))
    if state is not None:
        rows = rows.join(state.select("id", "label"), "id", "left")
    known = F.col("id") if state is None else F.coalesce("label", "id")
    return sweep(rows.withColumn("label", known), "label").select("id", "label").distinct()


def _spread(edges: DataFrame, start: DataFrame, metrics: Metrics | None) -> DataFrame:
    laid = ByKey(edges, "src")

    def step(state: DataFrame) -> DataFrame:
        frontier = state.where("changed").select(F.col("id").alias("src"), "label")
        return relax(state, laid.join(frontier).select(F.col("dst").alias("id"), "label"), "label")

    out = settle(start, step, metrics).select("id", "label")
    laid.release()
    return out


def connected_components(graph: Graph, metrics: Metrics | None = None) -> DataFrame:
    """``id`` and ``label``: the least id of the component when edges are taken in both directions.

    Each round takes the least label among the neighbours that have changed and then that label's own label, so the
    rounds grow with the logarithm of the longest path, not with the path. Labels are looked up once each, however many vertices have them.
    """
    edges = graph.edges.select("src", "dst")
    laid = ByKey(cut(edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()), "src")
    start = graph.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("changed"))

    def step(state: DataFrame) -> DataFrame:
        near = laid.join(state.where("changed").select(F.col("id").alias("src"), "label")).select(F.col("dst").alias("id"), "label")
        new = state.select("id", F.col("label").alias("old"), "label").union(near.select("id", F.lit(None).cast("long").alias("old"), "label"))
        new = cut(new.groupBy("id").agg(F.min("old").alias("old"), F.min("label").alias("label")))
        used = new.select("label").distinct()
        tops = state.where("label < id").select(F.col("id").alias("label"), F.col("label").alias("top")).join(used, "label")
        least = F.least("label", F.coalesce("top", "label"))
        return new.join(tops, "label", "left").select("id", least.alias("label"), (least < F.col("old")).alias("changed"))

    out = settle(start, step, metrics).select("id", "label")
    laid.release()
    return out
