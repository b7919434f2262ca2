"""Golden answers on a tiny graph with a cycle, a self-loop, sources and two weak components; properties; loaders."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import sets
from graphloom.functions.formats import exponent
from graphloom.operators import labels, local_fixpoint, pagerank, partitioning, shortest_paths, simulation
from graphloom.operators.graph import Graph
from graphloom.operators.supersteps import Metrics
from graphloom.sources import text, writers
from graphloom.streaming import arrivals

EDGES = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 5), (6, 7), (7, 6), (8, 7), (9, 5)]


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.from_edges(spark.createDataFrame(EDGES, "src long, dst long")).cut()


@pytest.fixture(scope="module")
def thirds(graph):
    return Graph(graph.vertices.select("id", (F.col("id") % 3).alias("attr")), graph.edges, 3)


def test_sssp(graph):
    assert rows(shortest_paths.sssp(graph, 1), "id", "dist") == [(1, 0.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 3.0)]
    assert rows(shortest_paths.sssp(graph, 100), "id") == []
    assert rows(shortest_paths.sssp_rounds(graph, 1, 1), "id", "dist") == [(1, 0.0), (2, 1.0), (3, 1.0)]


@pytest.mark.parametrize("k", [1, 3])
def test_sssp_does_not_depend_on_partitions(spark, graph, k):
    assert rows(local_fixpoint.sssp_by_parts(graph, 1, k), "id", "dist") == rows(shortest_paths.sssp(graph, 1), "id", "dist")


def test_labels(graph):
    assert rows(labels.min_label(graph), "id", "label") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6), (8, 8), (9, 9)]
    assert rows(labels.connected_components(graph), "id", "label") == [(k, 1) for k in (1, 2, 3, 4, 5)] + [(6, 6), (7, 6), (8, 6), (9, 1)]


def test_long_path_takes_few_rounds(spark):
    path = Graph.from_edges(spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    metrics = Metrics()
    assert {r["label"] for r in labels.connected_components(path, metrics).collect()} == {0}
    assert metrics.supersteps < 25


def test_pagerank(graph):
    got = {r["id"]: round(r["pr"], 6) for r in pagerank.pagerank(graph).collect()}
    assert got == {1: 0.469626, 2: 0.353369, 3: 0.353369, 4: 0.752062, 5: 8.743456, 6: 3.576105, 7: 4.03969, 8: 1.0, 9: 1.0}


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        (({1: 1, 2: 2}, {1: (2,), 2: ()}), [(1, 1), (1, 4), (2, 2), (2, 5), (2, 8)]),
        (({1: 0, 2: 1}, {1: (2,), 2: (1,)}), [(1, 6), (2, 7)]),
        (({1: 1, 2: 2}, {1: (2,), 2: (1,)}), []),
    ],
)
def test_simulation(thirds, pattern, expected):
    assert rows(simulation.simulation(thirds, simulation.Pattern(*pattern)), "u", "v") == expected


def test_simulation_with_more_pattern_vertices_than_bits(spark, thirds):
    chain = simulation.Pattern({k: k % 3 for k in range(70)}, {k: (k + 1,) if k < 69 else () for k in range(70)})
    out, near = {r[:2] for r in rows(thirds.edges, "src", "dst")}, {}
    relation = {(u, v) for u in range(70) for v in range(1, 10) if u % 3 == v % 3}
    while True:
        kept = {(u, v) for u, v in relation if u == 69 or any((u + 1, w) in relation for a, w in out if a == v)}
        if kept == relation:
            break
        relation = kept
    assert not near and rows(simulation.simulation(thirds, chain), "u", "v") == sorted(relation)


def test_random_graphs_agree_with_plain_python(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    graph = Graph.from_edges(spark.createDataFrame([(a, b, float(1 + (a + b) % 4)) for a, b in edges], "src long, dst long, weight double")).cut()
    dist = {edges[0][0]: 0.0}
    for _ in range(50):
        for a, b in edges:
            if a in dist:
                dist[b] = min(dist.get(b, 1e9), dist[a] + 1 + (a + b) % 4)
    assert dict(rows(shortest_paths.sssp(graph, edges[0][0]), "id", "dist")) == dist
    label = {v: v for e in edges for v in e}
    for _ in range(50):
        for a, b in edges:
            label[b] = min(label[b], label[a])
    assert dict(rows(labels.min_label(graph), "id", "label")) == label


def test_mutation(graph, spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(graph.without_vertices(ids(4)).edges, "src", "dst") == [e for e in sorted(EDGES) if 4 not in e]
    assert graph.with_vertices(ids(1, 50)).node_count() == 10
    grown = graph.with_edges(spark.createDataFrame([(1, 2, 7.0), (20, 21, 2.0)], "src long, dst long, weight double"))
    assert rows(grown.edge(1, 2), "weight") == [(7.0,)] and rows(grown.edge(20, 21), "weight") == [(2.0,)] and grown.edges.count() == 12
    assert rows(graph.without_in_edges(), "id") == [(8,), (9,)] and graph.has(9) and not graph.has(10)
    assert rows(graph.in_edges(ids(7)), "src") == [(6,), (8,)] and rows(graph.out_edges(ids(4)), "dst") == [(1,), (5,)]


def test_replicas_and_borders(graph):
    placed = partitioning.placed_edges(graph, 3)
    ends = {(p, v) for s, d, p in rows(placed, "src", "dst", "part") for v in (s, d)}
    assert {(r["part"], r["id"]) for r in partitioning.replicas(placed).collect()} == ends
    assert partitioning.masters(placed).count() == 9 and partitioning.mirrors(placed).count() == len(ends) - 9
    owned = partitioning.owned_by_id(graph, 3)
    assert partitioning.inner_edges(owned).count() + partitioning.border_out(owned).count() == len(EDGES)
    assert partitioning.border_in(owned).count() == partitioning.border_out(owned).count()


def test_readers(spark, tmp_path):
    (tmp_path / "G.0").write_text("1 2\n1 2 9\n3 3 4")  # a repeat, a self-loop, more columns, no end of line
    (tmp_path / "G.1").write_text("5 6\n")
    edges = text.edge_list(spark, f"{tmp_path}/G.*")
    assert rows(edges, "src", "dst", "weight", "part") == [(1, 2, 1.0, 0), (1, 2, 1.0, 0), (3, 3, 1.0, 0), (5, 6, 1.0, 1)]
    assert rows(Graph.from_edges(edges).edges, "src", "dst") == [(1, 2), (3, 3), (5, 6)]
    (tmp_path / "bad.0").write_text("1 x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.edge_list(spark, f"{tmp_path}/bad.0").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.edge_list(spark, f"{tmp_path}/missing")
    (tmp_path / "Master.0").write_text("1 1 2\n7\n")
    assert rows(text.masters(spark, f"{tmp_path}/Master.0"), "id", "mirror_parts", "part") == [(1, [1, 2], 0), (7, [], 0)]
    (tmp_path / "Mirror.2").write_text("4 1\n")
    assert rows(text.mirrors(spark, f"{tmp_path}/Mirror.2"), "id", "master_part", "part") == [(4, 1, 2)]
    (tmp_path / "Degree.0").write_text("4 11\n")
    assert rows(text.degrees(spark, f"{tmp_path}/Degree.0"), "id", "out_degree") == [(4, 11)]
    (tmp_path / "Isolateds.0").write_text("8\n")
    assert rows(text.isolated(spark, f"{tmp_path}/Isolateds.0"), "id") == [(8,)]
    (tmp_path / "pattern").write_text("1 0 2 2 3\n2 1 0\n")
    v, e = text.pattern(spark, f"{tmp_path}/pattern")
    assert rows(v, "u", "attr") == [(1, 0), (2, 1)] and rows(e, "u", "t") == [(1, 2), (1, 3)]
    (tmp_path / "config").write_text("0,a:1\n1,b:2")
    assert rows(text.cluster(spark, f"{tmp_path}/config"), "idx", "endpoint", "coordinator") == [(0, "a:1", True), (1, "b:2", False)]
    (tmp_path / "x.gr").write_text("c no\np sp 2 1\na 1 2 5\n")
    assert rows(text.dimacs(spark, f"{tmp_path}/x.gr"), "src", "dst", "weight") == [(1, 2, 5)]


def test_metis(spark, tmp_path, graph):
    writers.write_metis(graph.edges, f"{tmp_path}/metis")
    lines = [x.rstrip("\n") for p in sorted((tmp_path / "metis").glob("part-*")) for x in p.read_text().splitlines(keepends=True)]
    assert lines[0] == "9 5 001" and lines[1] == "2 1 3 1" and lines[4] == "1 1 5 1" and len(lines) == 10
    (tmp_path / "one").write_text("\n".join(lines))
    assert rows(text.metis_graph(text.numbered(spark, f"{tmp_path}/one")), "src", "dst") == sorted(EDGES)
    (tmp_path / "one.part.2").write_text("0\n1\n1\n0\n")
    parts = text.metis_partition(text.numbered(spark, f"{tmp_path}/one.part.2"))
    assert rows(text.checked_partition(parts, 4), "node", "part") == [(1, 0), (2, 1), (3, 1), (4, 0)]
    with pytest.raises(ValueError, match="4 lines for 5"):
        text.checked_partition(parts, 5)


def test_writers(spark, tmp_path, graph):
    writers.write_tsv(shortest_paths.sssp(graph, 1), f"{tmp_path}/tsv")
    assert sorted(x for p in (tmp_path / "tsv").glob("part-*") for x in p.read_text().splitlines())[3] == "4\t2E+00"
    found = spark.createDataFrame([(0.25,), (12.0,), (1 / 3,), (0.0,)], "x double").select(exponent(F.col("x")).alias("x"))
    assert [r["x"] for r in found.collect()][:2] == ["2.5E-01", "1.2E+01"] and [float(r["x"]) for r in found.collect()] == [0.25, 12.0, 1 / 3, 0.0]
    owned = partitioning.owned_by_id(graph, 2)
    writers.write_json(writers.subgraph_rows(owned), f"{tmp_path}/json")
    assert (tmp_path / "json" / "part=0").is_dir()
    lines = ["2020/01/01 10:00:00 start PEval", "2020/01/01 10:00:09 worker 1 duration time of partial evaluation: 2.5", "other", "2020/01/01 10:00:10 start IncEval", "2020/01/01 10:00:30 This worker 1 dosen't update in the round 3", "2020/01/01 10:01:00 start IncEval", "2020/01/01 10:01:01 This worker 1 dosen't update in the round 4", "2020/01/01 10:01:01 This worker 2 dosen't update in the round 4"]
    (tmp_path / "log").write_text("\n".join(lines))
    times = text.timing_rows(text.log_timings(text.run_log(spark, f"{tmp_path}/log")))
    assert rows(times, "workerId", "times") == [(1, [6.5, 2.5, 20.0, 1.0]), (2, [1.0])]
    writers.write_timings(times, f"{tmp_path}/csv")
    found = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert found[0] == "workerId,PEval initial Time,PEval iteration time,inc eval time" and sorted(found[1:]) == ["1,6.5,2.5,20.0,1.0", "2,1.0"]


def test_log_markers_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(text, "BLOCK", 3)
    lines = [(0, "d 00:00:05 start PEval")] + [(k, f"d 00:00:{k + 10:02d} worker {k % 2} duration time of partial evaluation: 1") for k in range(1, 8)] + [(8, "d 00:01:00 start IncEval"), (13, "d 00:01:07 This worker 0 dosen't update in the round 1")]
    found = rows(text.log_timings(spark.createDataFrame(lines, "n long, line string")), "n", "k", "seconds")
    assert found == sorted([(k, 0, k + 4.0) for k in range(1, 8)] + [(k, 1, 1.0) for k in range(1, 8)] + [(13, 0, 7.0)])


def test_layout_with_hubs(spark, monkeypatch):
    """A key of more rows than a partition's share is met by broadcast; the join is the same."""
    from graphloom.operators import recovery

    monkeypatch.setattr(recovery, "HUB", 50)
    edges = spark.createDataFrame([(1, k) for k in range(400)] + [(k, k + 1) for k in range(2, 60)], "src long, dst long")
    laid, other = recovery.ByKey(recovery.cut(edges), "src"), spark.createDataFrame([(1, "a"), (7, "b"), (99, "c")], "src long, x string")
    assert [r["src"] for r in laid.hubs.collect()] == [1]
    assert rows(laid.join(other), "src", "dst", "x") == rows(edges.join(other, "src"), "src", "dst", "x")
    laid.release()


def test_rounds_do_not_move_edges(spark, graph):
    """With broadcasts off, a round's plan deals out the frontier and the state and not the edges."""
    from graphloom.operators import recovery

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = recovery.ByKey(graph.edges, "src")
        plan = laid.join(spark.range(3).withColumnRenamed("id", "src"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    outside = plan.split("InMemoryTableScan")[0]
    assert "InMemoryTableScan" in plan and outside.count("Exchange") <= 1 and outside.count("Sort [") <= 1
    laid.release()


def test_relaxed_edges_are_counted(graph):
    metrics = Metrics()
    shortest_paths.sssp(graph, 1, metrics)
    assert [r[1:4] for r in metrics.rows] == [(1, 1, 2), (3, 2, 2), (4, 1, 2), (5, 1, 1), (5, 0, 0)] and metrics.teps() > 0


def test_simulation_continues_after_removal(spark, thirds):
    pattern = simulation.Pattern({1: 1, 2: 2}, {1: (2,), 2: ()})
    before = simulation.simulation(thirds, pattern)
    fewer = Graph(thirds.vertices, thirds.edges.where("not (src = 4 and dst = 5)"), 3)
    assert rows(simulation.simulation_continue(fewer, pattern, simulation.held(before, pattern)), "u", "v") == rows(simulation.simulation(fewer, pattern), "u", "v")
    changes = simulation.count_changes(thirds, spark.createDataFrame([(1, 2), (1, 4), (2, 5)], "u long, v long"), spark.createDataFrame([(1, 4), (1, 3)], "u long, v long"))
    counts = lambda pairs: {(s, u): sum((u, d) in pairs for a, d in EDGES if a == s) for s, _ in EDGES for u in (1, 2)}
    old, new = counts({(1, 2), (1, 4), (2, 5)}), counts({(1, 4), (1, 3)})
    assert rows(changes, "v", "u", "change") == sorted((s, u, new[s, u] - old[s, u]) for s, u in old if new[s, u] != old[s, u])


def test_sets(spark):
    a = spark.createDataFrame([([1, 2, 3], [3, 4], [])], "a array<long>, b array<long>, c array<long>")
    a_, b_, c_ = F.col("a"), F.col("b"), F.col("c")
    got = a.select(sets.merged(a_, b_), sets.added(a_, F.lit(9).cast("long")), sets.removed(a_, F.lit(2).cast("long")), sets.meets(a_, b_), sets.top(c_), sets.size(a_), sets.has(a_, F.lit(2))).first()
    assert list(got) == [[1, 2, 3, 4], [1, 2, 3, 9], [1, 3], True, -1, 3, True]


def test_arrivals(spark, tmp_path):
    for keep in (arrivals.maintained_sssp(1), arrivals.maintained_min_label()):
        for k, part in enumerate((EDGES[:4], EDGES[4:8], EDGES[8:])):
            keep.take(spark.createDataFrame(part, "src long, dst long"), k)
        whole = Graph.from_edges(spark.createDataFrame(EDGES, "src long, dst long"))
        expected = shortest_paths.sssp(whole, 1) if "dist" in keep.result(spark).columns else labels.min_label(whole)
        assert rows(keep.result(spark), *expected.columns) == rows(expected, *expected.columns)
    spark.createDataFrame(EDGES, "src long, dst long").repartition(2).write.parquet(f"{tmp_path}/in")
    keep = arrivals.maintained_sssp(1)
    keep.start(spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination()
    assert rows(keep.result(spark), "id", "dist") == [(1, 0.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 3.0)]


def test_arrivals_go_on_after_a_restart(spark, tmp_path):
    """A batch that runs twice, and a new object on the same folder, change nothing."""
    parts = [spark.createDataFrame(x, "src long, dst long") for x in (EDGES[:4], EDGES[4:8], EDGES[8:])]
    first = arrivals.maintained_sssp(1, f"{tmp_path}/state")
    first.take(parts[0], 0)
    first.take(parts[1], 1)
    first.take(parts[1], 1)
    again = arrivals.maintained_sssp(1, f"{tmp_path}/state")
    again.take(parts[1], 1)
    again.take(parts[2], 2)
    assert rows(again.result(spark), "id", "dist") == rows(first.result(spark), "id", "dist") == [(1, 0.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 3.0)]


def test_partitions_that_fit_no_task_are_refused(graph, monkeypatch):
    monkeypatch.setattr(local_fixpoint, "MOST_EDGES", 3)
    with pytest.raises(ValueError, match="take more than 1"):
        local_fixpoint.sssp_by_parts(graph, 1, 1)


def test_empty_graph(spark):
    empty = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert rows(shortest_paths.sssp(empty, 1), "id") == [] and rows(labels.connected_components(empty), "id") == [] and rows(pagerank.pagerank(empty), "id") == []
