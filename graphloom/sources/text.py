"""Readers of the text formats that graphs come in. Malformed ids raise when the rows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _part(column: str | Column = "_path") -> Column:
    """The partition number at the end of a file's name (``G.3`` is 3); null if there is none."""
    found = F.regexp_extract(column, r"\.(\d+)$", 1)
    return F.when(found != "", found).cast("int")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """The space-separated fields of every line that has any, and the partition of its file."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.input_file_name().alias("_path"))
    return lines.where("line <> ''").select(F.split("line", r"\s+").alias("f"), _part().alias("part"))


def _id(k: int) -> Column:
    return F.element_at("f", k).cast("long")


def edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """``src dst [more]`` lines: (src, dst, weight, part); weight is 1.0, or the third field if ``weighted``."""
    weight = F.element_at("f", 3).cast("double") if weighted else F.lit(1.0)
    return _fields(spark, path).select(_id(1).alias("src"), _id(2).alias("dst"), weight.alias("weight"), "part")


def masters(spark: SparkSession, path: str) -> DataFrame:
    """``id p1 p2 ...`` lines: (id, mirror_parts, part)."""
    return _fields(spark, path).select(_id(1).alias("id"), F.slice("f", F.lit(2), F.size("f")).cast("array<int>").alias("mirror_parts"), "part")


def mirrors(spark: SparkSession, path: str) -> DataFrame:
    """``id masterPart`` lines: (id, master_part, part)."""
    return _fields(spark, path).select(_id(1).alias("id"), F.element_at("f", 2).cast("int").alias("master_part"), "part")


def isolated(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_id(1).alias("id"), "part")


def degrees(spark: SparkSession, path: str) -> DataFrame:
    """``id outDegree`` lines."""
    return _fields(spark, path).select(_id(1).alias("id"), F.element_at("f", 2).cast("int").alias("out_degree"), "part")


def pattern(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``u attr k t1 ... tk`` lines: vertices (u, attr) and edges (u, t)."""
    return parse_pattern(spark.read.text(path).where(F.trim("value") != ""))


def parse_pattern(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = lines.select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long")).alias("f"))
    vertices = rows.select(_id(1).alias("u"), _id(2).alias("attr"))
    edges = rows.select(_id(1).alias("u"), F.explode(F.slice("f", F.lit(4), F.element_at("f", 3).cast("int"))).alias("t"))
    return vertices, edges


def cluster(spark: SparkSession, path: str) -> DataFrame:
    """``index,host:port`` lines: (idx, endpoint, coordinator); index 0 coordinates."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), ",").alias("f"))
    return rows.select(F.element_at("f", 1).cast("int").alias("idx"), F.element_at("f", 2).alias("endpoint"), (F.element_at("f", 1).cast("int") == 0).alias("coordinator"))


def dimacs(spark: SparkSession, path: str) -> DataFrame:
    return parse_dimacs(spark.read.text(path))


def parse_dimacs(lines: DataFrame) -> DataFrame:
    """Arc lines ``a src dst w``: (src, dst, weight int), and the line's number ``n`` if it is known; all other lines are skipped."""
    number = ["n"] if "n" in lines.columns else []
    rows = lines.where(F.col("value").startswith("a ")).select(F.split(F.trim("value"), r"\s+").alias("f"), *number)
    return rows.select(_id(2).alias("src"), _id(3).alias("dst"), F.element_at("f", 4).cast("int").alias("weight"), *number)


def adjacency(edges: DataFrame) -> DataFrame:
    """``id`` and its targets and weights in the order of ``n``, the number of the line that has the edge."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "dst", "weight")))
    return edges.groupBy(F.col("src").alias("id")).agg(ordered.alias("a")).select("id", F.col("a.dst").alias("targets"), F.col("a.weight").alias("weights"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one file and their numbers from 0, in the file's order.

    Line numbers need the order of the file's pieces, so lines are numbered inside each piece and shifted
    by the lengths of the pieces before it; only those lengths come to the driver.
    """
    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = {r["p"]: r["count"] for r in lines.groupBy("p").count().collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if not starts:
        return lines.select(F.lit(0).cast("long").alias("n"), "value")
    shift = F.create_map(*[x for p, s in starts.items() for x in (F.lit(p), F.lit(s).cast("long"))])
    return lines.select((shift[F.col("p")] + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"), "value")


def metis_graph(lines: DataFrame) -> DataFrame:
    """Line 0 is a header; line j lists ``n w n w ...`` of node j: (src, dst, weight int). Takes ``numbered`` lines."""
    rows = lines.where("n > 0").select(F.col("n").alias("src"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("f"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("f") / 2).cast("int") - 1, F.lit(0))), lambda k: F.struct(F.element_at("f", 2 * k + 1).cast("long").alias("dst"), F.element_at("f", 2 * k + 2).cast("int").alias("weight")))
    return rows.where(F.size("f") >= 2).select("src", F.explode(pairs).alias("x")).select("src", "x.dst", "x.weight")


def metis_partition(lines: DataFrame) -> DataFrame:
    """Line j (from 1) has the partition of node j: (node, part). Takes ``numbered`` lines."""
    return lines.where(F.trim("value") != "").select((F.col("n") + 1).alias("node"), F.trim("value").cast("int").alias("part"))


def checked_partition(parts: DataFrame, n_nodes: int) -> DataFrame:
    """The partition, if it has a line for each node; else an error."""
    if (found := parts.count()) != n_nodes:
        raise ValueError(f"{found} lines for {n_nodes} nodes")
    return parts


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a run log; lines start with a date and a clock."""
    return numbered(spark, path).select("n", F.col("value").alias("line"))


#: Line numbers that one task takes when markers are carried forward.
BLOCK = 65_536


def log_timings(lines: DataFrame) -> DataFrame:
    """(worker, n, k, seconds): the times that a run log tells, by number of line and place in it. Takes ``n`` and ``line``.

    A line "duration time of partial evaluation:" gives what the worker needed before it began to iterate (from the
    last "start PEval") and its seconds of iteration; "dosen't update in the round" gives the seconds from the last
    "start IncEval". Times without a start before them are null. Starts are carried forward inside blocks of lines and
    from the last of earlier blocks, so no task has the whole log.
    """
    f, line = F.split("line", " "), F.col("line")
    at = seconds_of(F.get(f, F.lit(1)))
    done, idle = line.contains("duration time of partial evaluation:"), line.contains("dosen't update in the round")
    rows = lines.select("n", F.floor(F.col("n") / BLOCK).alias("block"), at.alias("at"), f.alias("f"), done.alias("done"), idle.alias("idle"), F.when(line.contains("start PEval"), at).alias("p"), F.when(line.contains("start IncEval"), at).alias("i"))
    rows = rows.where("done or idle or p is not null or i is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n")))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(last("p").alias("lp"), last("i").alias("li"))
    blocks = blocks.select("block", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("lp", "li")])
    inside = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, "block").select("n", "at", "f", "done", "idle", *[F.coalesce(F.last(c, ignorenulls=True).over(inside), f"l{c}").alias(c) for c in ("p", "i")])
    own = F.element_at("f", 10).cast("double")
    times = F.when(F.col("done"), F.array(F.col("at") - F.col("p") - own, own)).otherwise(F.array((F.col("at") - F.col("i")).cast("double")))
    worker = F.when(F.col("done"), F.element_at("f", 4)).otherwise(F.element_at("f", 5)).cast("int")
    return rows.where("done or idle").select(worker.alias("worker"), "n", F.posexplode(times).alias("k", "seconds"))


def seconds_of(clock: str | Column) -> Column:
    """``HH:MM:SS`` as seconds; null if it is not that."""
    f = F.split(clock, ":")
    return F.when(F.size(f) == 3, f[0].try_cast("int") * 3600 + f[1].try_cast("int") * 60 + f[2].try_cast("int"))


def timing_rows(timings: DataFrame) -> DataFrame:
    """A row for each worker with its times in the order of the log: (workerId, times)."""
    return timings.groupBy(F.col("worker").alias("workerId")).agg(F.array_sort(F.collect_list(F.struct("n", "k", "seconds"))).alias("t")).select("workerId", F.col("t.seconds").alias("times"))
