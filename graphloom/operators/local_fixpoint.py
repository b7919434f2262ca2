"""Subgraph-centric shortest paths: each partition runs to its own fixpoint before values are exchanged.

Worth it where paths are long and partitions follow them: rounds then count crossings of partitions, not
edges. A partition's edges must fit a task, so too few partitions are refused. The answer is that of ``sssp``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .partitioning import placed_edges
from .recovery import cut
from .supersteps import Metrics, relax, settle


#: Edges that one task holds, about 100 bytes each with their Arrow and pandas copies.
MOST_EDGES = 4_000_000
#: Edges to a partition that ``enough_parts`` aims at.
EDGES = 1_000_000


def enough_parts(graph: Graph, least: int) -> int:
    """So many partitions that each has about ``EDGES`` edges, but not fewer than ``least``."""
    return max(least, -(-graph.edges.count() // EDGES))


def _settle_part(key: tuple, edges: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """Dijkstra's search inside one partition from all values known there; what improved."""
    order = np.argsort(edges["src"].to_numpy(), kind="stable")
    src, dst, weight = (edges[c].to_numpy()[order] for c in ("src", "dst", "weight"))
    best = dict(zip(values["id"].tolist(), values["dist"].tolist(), strict=True))
    known = dict(best)
    queue = [(d, v) for v, d, c in zip(values["id"].tolist(), values["dist"].tolist(), values["changed"].tolist(), strict=True) if c]
    heapq.heapify(queue)
    while queue:
        d, v = heapq.heappop(queue)
        if d > best[v]:
            continue
        first, last = np.searchsorted(src, [v, v + 1])
        for t, w in zip(dst[first:last].tolist(), weight[first:last].tolist(), strict=True):
            if d + w < best.get(t, float("inf")):
                best[t] = d + w
                heapq.heappush(queue, (d + w, t))
    new = [(v, d) for v, d in best.items() if d < known.get(v, float("inf"))]
    return pd.DataFrame(new, columns=["id", "dist"])


def sssp_by_parts(graph: Graph, source: int, k: int, metrics: Metrics | None = None) -> DataFrame:
    """``id`` and ``dist`` as ``sssp`` gives them, over ``k`` partitions of the edges."""
    placed = cut(placed_edges(graph, k))
    largest = placed.groupBy("part").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if largest > MOST_EDGES:
        raise ValueError(f"a partition has {largest} edges, more than {MOST_EDGES}: take more than {k} partitions")
    where = cut(placed.select(F.col("part").alias("at"), F.explode(F.array("src", "dst")).alias("id")).distinct())
    start = graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("changed"))

    def step(state: DataFrame) -> DataFrame:
        there = cut(state.join(where, "id"))
        live = there.where("changed").select(F.col("at").alias("live")).distinct()
        values = there.join(live, F.col("at") == F.col("live")).select("at", "id", "dist", "changed")
        found = placed.join(live, F.col("part") == F.col("live"), "left_semi").groupBy("part").cogroup(values.groupBy("at")).applyInPandas(_settle_part, "id long, dist double")
        return relax(state, found, "dist")

    return settle(start, step, metrics).select("id", "dist")
