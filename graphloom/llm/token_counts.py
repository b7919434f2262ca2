"""Token counts from an exact histogram of lengths (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, word_bpe

#: Lengths that one window partition holds in the prefix sums.
WIDTH = 4096


def lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every whole text; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe.library(tokenizer)
        for part in shared.slices(batches, 512):
            counts = [len(x) // 4 for x in codec.encode(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return shared.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length: how many documents have it (partial counts come before the shuffle)."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length n that occurs: documents and tokens at n or more, below n, and kept under a limit of n.

    ``docs_from`` and ``tokens_from`` are suffix sums over lengths from n on, ``truncated_tokens`` is the
    total when every document is cut to n tokens, ``padded_tokens`` when documents are also padded to n,
    and ``quantile`` is the share of documents of n tokens or fewer. Sums run inside blocks of lengths,
    and over the blocks' totals, so that no task holds all lengths.
    """
    block = F.floor(F.col("n_tokens") / WIDTH)
    rows = counts.withColumn("block", block).withColumn("n_sum", F.col("n_tokens") * F.col("n_docs"))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("n_sum").alias("b_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    totals = totals.select("block", F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("later_tokens"), F.sum("b_docs").over(every).alias("all_docs"), F.sum("b_tokens").over(every).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = rows.join(totals, "block").select("n_tokens", "n_docs", (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_from"), (F.sum("n_sum").over(inside) + F.col("later_tokens")).alias("tokens_from"), "all_docs", "all_tokens")
    below = F.col("all_tokens") - F.col("tokens_from")
    return out.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", below.alias("tokens_below"), (below + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"), (F.col("all_docs") * F.col("n_tokens")).alias("padded_tokens"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The histogram of encoded lengths of all whole texts with its suffix sums (see ``suffix_sums``).

    The histogram, a row for each length, is written once, so texts are encoded once. Null and empty texts count
    as documents of no tokens; repeated rows count each; a null id does not matter; an empty table gives no rows;
    other columns are ignored. A very long text is encoded whole by the task that has it.
    """
    return suffix_sums(shared.cut(histogram(lengths(docs, tokenizer, id_col, text_col))))


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Documents, longer documents and tokens kept for any context limits, also lengths that no document has."""
    rows = sums.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit"))
    return rows.groupBy("context_limit").agg(
        F.sum("n_docs").alias("n_docs"), F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("n_cut"), F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("kept_tokens")
    )
