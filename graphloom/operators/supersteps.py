"""The loop behind the iterative queries: expand the frontier, combine by key, keep what changed.

A round is one join of the frontier with the edges and one grouped aggregate over the state and the
candidates together, so the state is shuffled once and candidates are combined before they travel. The
new state carries a flag for what changed and is cut into the shared folder; the counts that end the loop and
give the metrics are observed by the same job.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .recovery import cut


@dataclass
class Metrics:
    """A row for each round: state rows, changed rows, edges that these relax in the next round, seconds."""

    rows: list[tuple[int, int, int, int | None, float]] = field(default_factory=list)
    relaxing: Observation | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "superstep int, n_state long, n_changed long, n_relaxed long, seconds double")

    def counting(self, candidates: DataFrame) -> DataFrame:
        """``candidates``, a row for each edge that a round relaxes, counted as they are used."""
        self.relaxing = Observation()
        return candidates.observe(self.relaxing, F.count(F.lit(1)).alias("n"))

    def add(self, n: int, changed: int, seconds: float) -> None:
        if self.relaxing is not None and self.rows:  # what the round before set out to relax
            self.rows[-1] = (*self.rows[-1][:3], self.relaxing.get["n"], self.rows[-1][4])
        self.relaxing = None
        self.rows.append((len(self.rows), n, changed, 0 if not changed else None, seconds))

    def teps(self) -> float:
        """Relaxed edges by seconds of all rounds, over the rounds that are counted."""
        return sum(r[3] or 0 for r in self.rows) / max(sum(r[4] for r in self.rows), 1e-9)

    @property
    def supersteps(self) -> int:
        return len(self.rows)


def settle(state: DataFrame, step: Callable[[DataFrame], DataFrame], metrics: Metrics | None = None, most: int = 100_000, also: Column | None = None, values: list | None = None) -> DataFrame:
    """Run ``step`` on the state (which has a boolean ``changed``) until nothing changes; the state as it is then.

    ``step`` gets the whole state and returns the next one. ``values`` gets the aggregate ``also`` of each state.
    """
    metrics = metrics if metrics is not None else Metrics()
    for _ in range(most):
        began, seen = time.time(), Observation()
        extra = [] if also is None else [also.alias("also")]
        state = cut(state.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.col("changed").cast("long")).alias("changed"), *extra))
        found = seen.get
        metrics.add(found["n"], found["changed"] or 0, time.time() - began)
        if values is not None:
            values.append(found["also"])
        if not found["changed"]:
            return state
        state = step(state)
    raise RuntimeError(f"no fixpoint in {most} rounds")


def relax(state: DataFrame, candidates: DataFrame, value: str) -> DataFrame:
    """The least of old and candidate values by ``id``; ``changed`` where a candidate is less or the id is new.

    ``state`` and ``candidates`` have ``id`` and ``value``.
    """
    old = state.select("id", F.col(value).alias("old"), F.lit(None).cast(state.schema[value].dataType).alias("new"))
    new = candidates.select("id", F.lit(None).cast(state.schema[value].dataType).alias("old"), F.col(value).alias("new"))
    both = old.union(new).groupBy("id").agg(F.min("old").alias("old"), F.min("new").alias("new"))
    return both.select("id", F.least("old", "new").alias(value), (F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))).alias("changed"))


def sweep(rows: DataFrame, value: str) -> DataFrame:
    """The least ``value`` that travels along paths, as ``rows`` (``path``, ``at``, ``far``, ``id``, ``value``) when nothing changes any more.

    The graph is given as paths: each row is linked to the next one of its ``path`` by ``at``, which says the order, and
    a value grows on the way by the difference of ``far``. An id may stand in several paths. A round takes every path from end to end, so rounds
    count the changes from path to path and not the links. One task has a path, sorted.
    """
    along, same = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("id")

    def step(state: DataFrame) -> DataFrame:
        near = state.withColumn("near", F.min(F.col(value) - F.col("far")).over(along) + F.col("far"))
        near = near.withColumn("near", F.min("near").over(same))
        return near.select("path", "at", "far", "id", F.col("near").alias(value), (F.col("near").isNotNull() & (F.col(value).isNull() | (F.col("near") < F.col(value)))).alias("changed"))

    return settle(rows.select("path", "at", "far", "id", value, F.lit(True).alias("changed")), step).drop("changed")


def level_metrics(graph, dist: DataFrame) -> DataFrame:
    """What ``Metrics`` has of shortest paths over weights of 1.0, from the finished ``dist``: a round changes what lies at its distance."""
    found = dist.join(graph.out_degree(), "id", "left").groupBy(F.col("dist").cast("int").alias("superstep"))
    found = found.agg(F.count(F.lit(1)).alias("n_changed"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("n_relaxed"))
    return found.select("superstep", "n_changed", F.sum("n_changed").over(Window.orderBy("superstep")).alias("n_state"), "n_relaxed")
