"""Connected components of links between keyed rows, in few rounds over DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Links up to which components are found on the driver, at a few hundred bytes each there.
FEW = 100_000


def least_nodes(a: list, b: list) -> tuple[list, list]:
    """Nodes of the links from ``a`` to ``b``, and the least node of the component of each."""
    names = sorted({*a, *b})
    number = {x: k for k, x in enumerate(names)}
    x, y = (np.fromiter(map(number.__getitem__, side), np.int64, len(side)) for side in (a, b))
    label = np.arange(len(names))
    while True:
        near = label.copy()
        np.minimum.at(near, x, label[y])
        np.minimum.at(near, y, label[x])
        near = near[near]
        if (near == label).all():
            return names, [names[k] for k in label.tolist()]
        label = near


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of ``links`` (``a``, ``b``; a cut); the label is the least node of its component.

    Links are counted, and up to ``FEW`` settled on the driver. Of more, each round takes the least label among neighbours and then the label's own label, so labels travel
    exponentially fast along chains; the rounds end when no label changes. State is written to the shared folder every round.
    """
    if links.count() <= FEW:
        table = links.select("a", "b").toArrow()
        nodes, least = least_nodes(table["a"].to_pylist(), table["b"].to_pylist())
        kind = table.schema.field("a").type
        return links.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, kind), "label": pa.array(least, kind)}), links.select(F.col("a").alias("node"), F.col("a").alias("label")).schema)
    both = shared.cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = shared.cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("parent"), F.col("label").alias("top"))
        step = step.join(up, F.col("label") == F.col("parent")).select("node", "old", F.least("label", "top").alias("label"))
        new = shared.cut(step)
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
