"""Graphs derived from the tables: parts are vertices, consecutive parts of an order are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_links(lineitem: DataFrame) -> DataFrame:
    """(src, dst), once each, without self-loops; ties inside an order are broken by further columns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = lineitem.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return rows.where("dst IS NOT NULL AND src <> dst").distinct()


def order_links(orders: DataFrame, by: tuple[str, ...] = ("o_custkey", "o_orderdate")) -> DataFrame:
    """(src, dst), once each: an order and the next one with the same customer, and the next one of the same day."""
    following = lambda c: F.lead("o_orderkey").over(Window.partitionBy(c).orderBy("o_orderdate", "o_orderkey"))
    rows = orders.select(F.col("o_orderkey").alias("src"), F.array(*[following(c) for c in by]).alias("next"))
    return rows.select("src", F.explode("next").alias("dst")).where("dst IS NOT NULL").distinct()


def order_paths(orders: DataFrame, by: tuple[str, ...] = ("o_custkey", "o_orderdate")) -> DataFrame:
    """(path, at, id): the same links as paths, one for each customer and each day; orders that are alone are in none. A null key ends a path."""
    out = None
    for c in by:
        order = Window.partitionBy(c).orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
        named = F.concat_ws(" ", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.sum(F.col("o_orderkey").isNull().cast("int")).over(order))
        rows = orders.select(named.alias("path"), F.count(F.lit(1)).over(order).alias("at"), F.col("o_orderkey").cast("long").alias("id")).where("id IS NOT NULL")
        out = rows if out is None else out.union(rows)
    return out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path"))).where("n > 1").drop("n")


def part_graph(spark: SparkSession, sf_dir: str, weighted: bool = False, modulus: int = 100) -> Graph:
    links = part_links(table(spark, sf_dir, "lineitem"))
    if weighted:
        links = links.withColumn("weight", (F.lit(1) + (F.col("src") * 7 + F.col("dst") * 13) % 10).cast("double"))
    return Graph.from_edges(links, modulus=modulus, written=True)
