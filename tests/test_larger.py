"""Queries on tables where paths are longer, groups fuller or partitions larger than in the given ones."""

import datetime

import duckdb
import pytest
from oracle import compare

from graphloom.operators import labels, local_fixpoint, shortest_paths, supersteps
from graphloom.operators.graph import Graph
from graphloom.plans import catalogue

DAY = datetime.date(2020, 1, 1)


def agrees(spark, folder, name, **tables) -> str:
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], folder)


def linked(spark, links):
    """lineitem with an order for each link."""
    rows = [(k, n, p, 0, DAY, 1.0) for k, pair in enumerate(links) for n, p in enumerate(pair)]
    return spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double")


def ordered(spark, rows):
    return spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date")


def test_simulation_that_needs_more_rounds_than_its_sql_takes(spark, tmp_path):
    """A line of gadgets, each of a vertex for each label of the pattern; they go from the end, one in three rounds."""
    at = lambda k, x: x + 8 * (3 * k + 2 * (1 - x) % 3)  # noqa: E731  # label x, and 1 modulo 3: no link is among those that go
    links = [(at(k, a), at(k, b)) for k in range(7) for a, b in ((0, 1), (0, 2), (1, 3), (1, 7), (2, 3), (2, 6), (3, 7), (6, 3), (7, 3))]
    links += [(at(k, 3), at(k + 1, 0)) for k in range(6)]
    assert agrees(spark, str(tmp_path), "sim_incremental", lineitem=linked(spark, links)) == ""


def test_no_order_is_isolated(spark, tmp_path):
    orders = ordered(spark, [(k, k % 3, DAY + datetime.timedelta(k % 4)) for k in range(20)])
    assert agrees(spark, str(tmp_path), "isolated_scan", orders=orders) == ""


def test_parts_are_as_many_as_edges_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(local_fixpoint, "EDGES", 1, raising=False)
    monkeypatch.setattr(local_fixpoint, "MOST_EDGES", 8)
    assert agrees(spark, str(tmp_path), "sssp_by_parts", lineitem=linked(spark, [(k, k + 1) for k in range(12)])) == ""


@pytest.mark.parametrize("name", ["min_label_directed", "min_label_incremental", "superstep_metrics"])
def test_long_days_take_few_rounds(spark, tmp_path, monkeypatch, name):
    """One day of 230 orders is a path of 229 links, more than the SQL of the metrics follows; some customers and days cross it."""
    cuts, plain = [], supersteps.cut

    def counted(df):
        cuts.append(1)
        assert len(cuts) <= 30, "a round for each link"
        return plain(df)

    monkeypatch.setattr(supersteps, "cut", counted)
    rows = [(k, 1000 + k, DAY) for k in range(230)] + [(300 + k, 1000 + 9 * k, DAY + datetime.timedelta(1 + k % 2)) for k in range(6)] + [(400, None, None), (401, 5, DAY - datetime.timedelta(1))]
    assert agrees(spark, str(tmp_path), name, orders=ordered(spark, rows)) == ""


def test_paths_that_meet_and_cross(spark):
    """Labels and hops along paths are those of the same links as a graph; an id may stand twice in a path."""
    walks = [(1, 2, 3, 1, 4), (5, 3, 6), (7, 5), (8, 2, 9, 9)]
    paths = spark.createDataFrame([(str(p), k + 1, v) for p, walk in enumerate(walks) for k, v in enumerate(walk)], "path string, at long, id long")
    graph = Graph.from_edges(spark.createDataFrame([x for walk in walks for x in zip(walk, walk[1:])], "src long, dst long"))  # noqa: B905
    values = lambda df: sorted(tuple(r) for r in df.collect())
    assert values(labels.min_label_along(paths)) == values(labels.min_label(graph))
    assert values(shortest_paths.hops_along(paths, 7)) == values(shortest_paths.sssp(graph, 7))
