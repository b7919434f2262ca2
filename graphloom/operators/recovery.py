"""Cut points that survive lost executors, and layouts that rounds reuse."""

from __future__ import annotations

import re
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which it can be a hub, if they are also more than a partition's share of all rows.
HUB = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset, a new local one for a local session, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; what follows starts from there."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class ByKey:
    """Rows that many joins on ``key`` read, dealt out by it once.

    They lie on the executors' disks, so a join moves only its other side; what a lost executor held is dealt out
    again from ``rows``, which should be a cut. Hubs, keys of more than a partition's share of the rows and so fewer
    than there are partitions, stay spread over all tasks and meet their other side by broadcast.
    """

    def __init__(self, rows: DataFrame, key: str):
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        total, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        self.key, self.hubs, least = key, None, max(HUB, total // n)
        if top > least:
            self.hubs = cut(counts.where(F.col("n") > least).select(key))
            self.spread = rows.join(F.broadcast(self.hubs), key, "left_semi")
            rows = rows.join(F.broadcast(self.hubs), key, "left_anti")
        conf, name = rows.sparkSession.conf, "spark.sql.adaptive.enabled"
        was = conf.get(name)
        conf.set(name, "false")  # the layout must be known to the first join, before the rows are there
        try:
            self.rows = rows.repartition(n, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
        finally:
            conf.set(name, was)

    def join(self, other: DataFrame) -> DataFrame:
        """Joined with ``other``, in which each key stands once."""
        out = other.join(self.rows, self.key)
        if self.hubs is None:
            return out
        at_hubs = other.join(F.broadcast(self.hubs), self.key, "left_semi")
        return out.union(self.spread.join(F.broadcast(at_hubs), self.key).select(out.columns))

    def release(self) -> None:
        self.rows.unpersist()
