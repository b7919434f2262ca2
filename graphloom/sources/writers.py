"""Writers of results and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import exponent


def tsv_lines(result: DataFrame) -> DataFrame:
    """One ``value`` column: the columns of a result with tabs between, doubles in exponent format."""
    text = [exponent(F.col(n)) if t == "double" else F.col(n).cast("string") for n, t in result.dtypes]
    return result.select(F.concat_ws("\t", *text).alias("value"))


def write_tsv(result: DataFrame, path: str) -> None:
    tsv_lines(result).write.mode("overwrite").text(path)


def metis_lines(edges: DataFrame) -> DataFrame:
    """The METIS text of a graph with ids 1 to n: (n, value) with the header as line 0; nodes without edges have empty lines."""
    pairs = F.array_sort(F.collect_list(F.struct("dst", F.col("weight").cast("long").alias("weight"))))
    lists = edges.groupBy("src").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(" ", x["dst"].cast("string"), x["weight"].cast("string"))), " ").alias("value"))
    most = F.when(F.min(F.least("src", "dst")) < 1, F.raise_error(F.lit("METIS ids start at 1")).cast("long")).otherwise(F.max(F.greatest("src", "dst")))
    size = edges.agg(most.alias("nodes"), F.count(F.lit(1)).alias("n_edges"))
    last = size.first()["nodes"]
    nodes = edges.sparkSession.range(1, (last or 0) + 1).withColumnRenamed("id", "src")
    body = nodes.join(lists, "src", "left").select(F.col("src").alias("n"), F.coalesce("value", F.lit("")).alias("value"))
    head = size.select(F.lit(0).cast("long").alias("n"), F.concat_ws(" ", F.coalesce("nodes", F.lit(0)).cast("string"), F.floor(F.col("n_edges") / 2).cast("string"), F.lit("001")).alias("value"))
    return head.union(body)


def write_metis(edges: DataFrame, path: str) -> None:
    metis_lines(edges).repartitionByRange("n").sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def subgraph_rows(owned: DataFrame) -> DataFrame:
    """(part, src, targets): inner edges of each partition, targets as a map from vertex to weight in order of vertices."""
    inner = owned.where("src_part = dst_part").groupBy(F.col("src_part").alias("part"), "src")
    return inner.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "weight")))).alias("targets"))


def border_rows(owned: DataFrame) -> DataFrame:
    """(part, side, vertex, others): F.I and F.O of each partition; others maps vertices to ``weight part``."""
    entry: Column = F.concat_ws(" ", F.col("weight").cast("long").cast("string"), F.col("other").cast("string"))
    cross = owned.where("src_part <> dst_part")
    out = cross.select(F.col("src_part").alias("part"), F.lit("F.O").alias("side"), F.col("dst").alias("vertex"), F.col("src").alias("to"), "weight", F.col("dst_part").alias("other"))
    into = cross.select(F.col("dst_part").alias("part"), F.lit("F.I").alias("side"), F.col("dst").alias("vertex"), F.col("src").alias("to"), "weight", F.col("src_part").alias("other"))
    return out.union(into).groupBy("part", "side", "vertex").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("to"), entry)))).alias("others"))


def write_json(rows: DataFrame, path: str) -> None:
    """A folder for each partition, a JSON object on each line."""
    rows.write.mode("overwrite").partitionBy("part").json(path)


def write_subgraphs(owned: DataFrame, path: str) -> None:
    """The inner edges of each partition as JSON, an object on each line for each source: {"Graph<part>": {source: {target: weight}}}."""
    rows = subgraph_rows(owned)
    rows.select(F.to_json(F.create_map(F.concat(F.lit("Graph"), "part"), F.create_map("src", "targets"))).alias("value")).write.mode("overwrite").text(path)


def write_borders(owned: DataFrame, path: str) -> None:
    """The border of each partition as JSON, an object on each line for each vertex: {"Graph<part>F.I": {vertex: {other: "weight part"}}}, and F.O."""
    rows = border_rows(owned)
    rows.select(F.to_json(F.create_map(F.concat(F.lit("Graph"), "part", "side"), F.create_map("vertex", "others"))).alias("value")).write.mode("overwrite").text(path)


def write_parts(lines: DataFrame, path: str, name: str, order: str | None = None) -> str:
    """``value`` of each ``part`` as one text file ``<name>.<part>`` in the folder ``path``, in the order of column ``order``; returns ``path``.

    A partition's file is written by one task, as the format has one file for each partition. Without lines there is one
    empty file, ``<name>.0``, so that the folder can be read.
    """
    spark, made = lines.sparkSession, f"{path}/making-{name}"
    dealt = lines.repartition("part")
    dealt = dealt.sortWithinPartitions("part", order) if order else dealt.sortWithinPartitions("part")
    dealt.select("part", "value").write.partitionBy("part").text(made)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = to_path(made)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    kinds = [kind for kind in files.listStatus(folder) if kind.isDirectory()]
    for kind in kinds:
        part = kind.getPath().getName().split("=")[1]
        for one in files.listStatus(kind.getPath()):
            files.rename(one.getPath(), to_path(f"{path}/{name}.{part}"))
    if not kinds:
        files.create(to_path(f"{path}/{name}.0")).close()
    files.delete(folder, True)
    return path


def write_timings(rows: DataFrame, path: str) -> None:
    """One CSV file with a header: a line for each worker, in their order, with all its times, as many as it has."""
    head = rows.sparkSession.createDataFrame([(-1, "workerId,PEval initial Time,PEval iteration time,inc eval time")], "at int, value string")
    body = rows.select(F.col("workerId").alias("at"), F.concat_ws(",", F.col("workerId").cast("string"), F.col("times").cast("array<string>")).alias("value"))
    head.union(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
