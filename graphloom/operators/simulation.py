"""Graph simulation: the largest relation between pattern and data vertices in which equal labels hold and
every pattern edge u -> t is answered by a data edge v -> w with w related to t.

A data vertex holds its pattern vertices as bits (``WORD`` to a long column), so a round is one join with
the edges and one bitwise-or aggregate by source, and the test of all successors is bit arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .recovery import ByKey, cut
from .supersteps import Metrics, settle

WORD = 62
#: Pattern vertices up to which the pattern is held as expressions.
MOST = 512


@dataclass(frozen=True)
class Pattern:
    """Labels of pattern vertices and their targets; a few rows."""

    labels: dict[int, int]
    targets: dict[int, tuple[int, ...]]

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame) -> Pattern:
        """From ``vertices`` (u, attr) and ``edges`` (u, t); more than ``MOST`` vertices are refused."""
        rows = vertices.select("u", "attr").distinct().limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"a pattern has at most {MOST} vertices")
        known = {r["u"]: r["attr"] for r in rows}
        out: dict[int, list[int]] = {u: [] for u in known}
        found = edges.select("u", "t").distinct().limit(MOST * MOST + 1).collect()
        if len(found) > MOST * MOST:
            raise ValueError(f"a pattern has at most {MOST * MOST} edges")
        for r in found:
            out.setdefault(r["u"], []).append(r["t"])
        return Pattern(known, {u: tuple(sorted(t)) for u, t in out.items()})

    @property
    def order(self) -> list[int]:
        return sorted(self.labels)

    def place(self, u: int) -> tuple[int, int]:
        return divmod(self.order.index(u), WORD)

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        v = spark.createDataFrame(sorted(self.labels.items()), "u long, attr long")
        e = spark.createDataFrame([(u, t) for u in sorted(self.targets) for t in self.targets[u]], "u long, t long")
        return v, e


def words(pattern: Pattern) -> list[str]:
    return [f"m{k}" for k in range(-(-len(pattern.labels) // WORD))]


def candidates(graph: Graph, pattern: Pattern) -> DataFrame:
    """(u, v) with equal labels."""
    held = _start(graph, pattern)
    return _pairs(held, pattern)


def _start(graph: Graph, pattern: Pattern) -> DataFrame:
    by_label: dict[int, list[int]] = {}
    for u, a in pattern.labels.items():
        by_label.setdefault(a, []).append(u)
    held = graph.vertices.where(F.col("attr").isin(*by_label)) if by_label else graph.vertices.limit(0)
    out: list[Column] = [F.col("id")]
    for k, name in enumerate(words(pattern)):
        value = F.lit(0).cast("long")
        for a, us in sorted(by_label.items()):
            bits = sum(1 << b for w, b in map(pattern.place, us) if w == k)
            value = F.when(F.col("attr") == a, F.lit(bits).cast("long")).otherwise(value)
        out.append(value.alias(name))
    return held.select(*out)


def _pairs(held: DataFrame, pattern: Pattern) -> DataFrame:
    """The relation as rows (u, v)."""
    places = [(u, *pattern.place(u)) for u in pattern.order]
    us = F.array_compact(F.array(*[F.when(F.col(f"m{w}").bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit(u).cast("long")) for u, w, b in places])) if places else F.array().cast("array<long>")
    return held.select(F.explode(us).alias("u"), F.col("id").alias("v"))


def successor_counts(graph: Graph, pattern: Pattern) -> DataFrame:
    """(v, u, cnt): how many targets of v are candidates for u."""
    pairs = candidates(graph, pattern)
    return graph.edges.join(pairs, F.col("dst") == F.col("v")).groupBy(F.col("src").alias("id"), "u").agg(F.count(F.lit(1)).alias("cnt")).select(F.col("id").alias("v"), "u", "cnt")


def _kept(state: DataFrame, edges: ByKey, pattern: Pattern) -> DataFrame:
    names = words(pattern)
    seen = edges.join(state.select(F.col("id").alias("dst"), *names)).groupBy(F.col("src").alias("id")).agg(*[F.bit_or(n).alias(f"h{n}") for n in names])
    both = state.select("id", *names).join(seen, "id", "left")
    out: list[Column] = [F.col("id")]
    for k, name in enumerate(names):
        fits = F.lit(0).cast("long")
        for u in pattern.order:
            w, b = pattern.place(u)
            if w != k:
                continue
            needs: dict[int, int] = {}
            known = all(t in pattern.labels for t in pattern.targets.get(u, ()))
            for t in pattern.targets.get(u, ()):
                if t in pattern.labels:
                    tw, tb = pattern.place(t)
                    needs[tw] = needs.get(tw, 0) | 1 << tb
            ok = F.lit(known)
            for tw, bits in needs.items():
                ok = ok & (F.coalesce(F.col(f"hm{tw}"), F.lit(0).cast("long")).bitwiseAND(F.lit(bits).cast("long")) == bits)
            fits = fits.bitwiseOR(F.when(ok, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
        out.append(F.col(name).bitwiseAND(fits).alias(name))
    moved = F.lit(False)
    for name in names:
        moved = moved | (F.col(name) != F.col(f"new_{name}"))
    new = both.select("*", *[c.alias(f"new_{n}") for c, n in zip(out[1:], names, strict=True)])
    return new.select("id", *[F.col(f"new_{n}").alias(n) for n in names], moved.alias("changed"))


def refined(graph: Graph, pattern: Pattern, rounds: int = 1) -> DataFrame:
    """(u, v) after so many rounds of removal."""
    state, edges = _start(graph, pattern), ByKey(graph.edges.select("src", "dst"), "dst")
    for _ in range(rounds):
        state = cut(_kept(state, edges, pattern))
    edges.release()
    return _pairs(state, pattern)


def simulation(graph: Graph, pattern: Pattern, metrics: Metrics | None = None) -> DataFrame:
    """(u, v) of the largest simulation; pattern vertices without a match do not empty the others'."""
    return simulation_continue(graph, pattern, _start(graph, pattern), metrics)


def simulation_continue(graph: Graph, pattern: Pattern, state: DataFrame, metrics: Metrics | None = None) -> DataFrame:
    """Go on from a ``state`` (see ``held``), from which pairs may only be taken away, to the fixpoint."""
    edges = ByKey(graph.edges.select("src", "dst"), "dst")
    out = settle(state.withColumn("changed", F.lit(True)), lambda s: _kept(s, edges, pattern), metrics)
    edges.release()
    return _pairs(out, pattern)


def held(pairs: DataFrame, pattern: Pattern) -> DataFrame:
    """A state from rows (u, v), as ``_pairs`` gives them."""
    out: list[Column] = []
    for k, name in enumerate(words(pattern)):
        bit = F.lit(0).cast("long")
        for u in pattern.order:
            w, b = pattern.place(u)
            if w == k:
                bit = F.when(F.col("u") == u, F.lit(1 << b).cast("long")).otherwise(bit)
        out.append(F.bit_or(bit).alias(name))
    return pairs.groupBy(F.col("v").alias("id")).agg(*out)


def count_changes(graph: Graph, before: DataFrame, after: DataFrame) -> DataFrame:
    """(v, u, change): by how much the number of targets of v that hold u moves between two relations (u, v).

    Each pair that went counts -1 and each that came +1 at every source of an edge into it; changes are added up
    and those that cancel are left out.
    """
    went = before.select("u", "v").subtract(after.select("u", "v")).withColumn("sign", F.lit(-1))
    came = after.select("u", "v").subtract(before.select("u", "v")).withColumn("sign", F.lit(1))
    moved = graph.edges.join(went.union(came), F.col("dst") == F.col("v")).groupBy(F.col("src").alias("s"), "u").agg(F.sum("sign").alias("change"))
    return moved.where("change <> 0").select(F.col("s").alias("v"), "u", "change")
