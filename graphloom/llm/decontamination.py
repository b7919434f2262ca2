"""Benchmark decontamination with DataFrame functions only (operator 9).

Words are what lies between characters that are neither letters nor digits, in lower case; a text's set
is that of its five-word shingles, or its whole sequence when it has fewer words. A document contains
an item when at least 0.8 of the item's shingles are among the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SHINGLE = 5
THRESHOLD = 0.8
#: Rows of the sketch table up to which it is broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 200_000
#: Upper sizes of the partitions of items by number of shingles.
SIZES = (1, 2, 5, 10, 15, 20, 25, 30, 40, 50, 60, 80, 100, 130, 170, 220, 300, 400, 550, 750, 1000)
_SEED = 0x5851F42D4C957F2D
#: Buckets of text hashes by which documents without candidates are left out before texts are shuffled; the table of them is broadcast.
BUCKETS = 1 << 20
#: Items that may have a shingle for it to be sketched before others.
COMMON = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _paired(a: Column, b: Column, shift: int, join) -> Column:
    """``join`` of each element of ``a`` and the element of ``b`` that stands ``shift`` further on."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), join)


def with_shingles(rows: DataFrame, text_col: str, out: str, hashed: bool = True) -> DataFrame:
    """All five-word shingles of a text in order, as 64-bit hashes or as text; shorter texts give one shingle.

    Each step joins runs of words that an earlier step joined, so the work is linear in the text.
    """
    join = (lambda x, y: F.xxhash64(x, y)) if hashed else (lambda x, y: F.concat_ws(" ", x, y))
    rows = rows.withColumn("_w", words(F.col(text_col)))
    if hashed:
        rows = rows.withColumn("_w", F.transform("_w", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_two", _paired(F.col("_w"), F.col("_w"), 1, join))
    rows = rows.withColumn("_four", _paired(F.col("_two"), F.col("_two"), 2, join))
    whole = F.when(F.size("_w") > 0, F.array(F.xxhash64("_w") if hashed else F.array_join("_w", " "))).otherwise(F.array().cast(f"array<{'long' if hashed else 'string'}>"))
    return rows.withColumn(out, F.when(F.size("_w") >= SHINGLE, _paired(F.col("_four"), F.col("_w"), SHINGLE - 1, join)).otherwise(whole)).drop("_w", "_two", "_four")


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(``h``, ``item_id``, ``n``): for each item the least of its shingles' min-hash values, as many as its size partition asks.

    An item of n shingles that is contained misses at most floor((1 - t) n) of them, so any
    floor((1 - t) N) + 1 of its shingles, N being the upper size of the item's partition, hold at least
    one that the document has: no contained item is lost. Shingles that more than ``COMMON`` items share stand
    behind all others, so boilerplate of many items brings few candidates.
    """
    sized = items.withColumn("n", F.size("set")).where("n > 0")
    shared_by = sized.select(F.explode("set").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > COMMON).select("h", F.lit(True).alias("common"))
    upper = F.greatest(F.col("n"), F.coalesce(*[F.when(F.col("n") <= s, F.lit(s)) for s in SIZES], F.col("n")))
    keep = F.least(F.col("n"), F.floor(F.round(upper * (1 - threshold), 6)).cast("int") + 1)
    rows = sized.select("item_id", F.xxhash64("item_text").alias("t"), "n", keep.alias("keep"), F.explode("set").alias("h")).join(shared_by, "h", "left")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("common", F.lit(False)).alias("common"), F.xxhash64("h", F.lit(_SEED)).alias("rank"), "h")))
    rows = rows.groupBy("item_id", "t", "n", "keep").agg(ranked.alias("ranked"))
    return rows.select("item_id", "n", F.explode(F.slice("ranked", F.lit(1), F.col("keep"))).alias("x")).select(F.col("x.h").alias("h"), "item_id", "n")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every (document, item) with at least ``threshold`` of the item's shingles in the document.

    Items are partitioned by size and each is reduced to a min-hash sketch (see ``sketches``); the hashes
    of all shingles of every whole document probe the sketches, in a broadcast join when their counted
    rows are few and a shuffled one otherwise; candidates are verified on the shingles themselves.
    Only candidates are shuffled: their ids with the shingles of their items, and once their texts with those few that share a
    bucket with one.

    Returns ``doc_id``, ``item_id``, ``n_shared``, ``n_item`` and ``containment``, once for each pair of
    ids (repeated rows of a document count once; rows with one id and different texts are taken together
    with the larger overlap; a null id is an id like others). Null and empty texts, and texts without
    letters or digits, contain nothing and are in nothing. Empty tables give an empty result; other columns are ignored.
    A very long text is one row whose shingles are arrays, about 150 bytes for each of its words.
    """
    documents = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).where("item_text is not null").dropDuplicates()
    sketch = shared.cut(sketches(with_shingles(bench, "item_text", "set").withColumn("set", F.array_distinct("set"))))
    few_items = sketch.count() <= BROADCAST_ROWS
    keys = sketch.groupBy("h").agg(F.collect_set("item_id").alias("items")) if few_items else sketch.select("h", "item_id")
    # explode would have its input tested for emptiness below the steps above, and so run them again
    probes = with_shingles(documents, "text", "hashes").select("doc_id", F.xxhash64("text").alias("t"), F.explode_outer("hashes").alias("h"))
    found = probes.join(F.broadcast(keys) if few_items else keys, "h")
    found = shared.cut(found.select("doc_id", "t", F.explode("items").alias("item_id") if few_items else F.col("item_id")).distinct())
    sets = with_shingles(bench, "item_text", "want", hashed=False).select("item_id", F.array_distinct("want").alias("want"))
    wanted = found.join(F.broadcast(sets) if few_items else sets, "item_id")
    candidates = wanted.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg(F.collect_list(F.struct("item_id", "want")).alias("items"))
    if found.count() <= BROADCAST_ROWS // 100:  # an item's shingles may be some kilobytes
        candidates = F.broadcast(candidates)
    bucket = lambda t: F.pmod(t, F.lit(BUCKETS))
    asked = shared.cut(found.select(bucket(F.col("t")).alias("b")).distinct())
    likely = documents.join(F.broadcast(asked), bucket(F.xxhash64("text")) == F.col("b"), "left_semi")
    pairs = likely.join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("dt"))).select("doc_id", "text", "items")
    pairs = with_shingles(pairs, "text", "have", hashed=False).select("doc_id", "items", F.array_distinct("have").alias("have"))
    both = F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), F.size(F.array_intersect(x["want"], F.col("have"))).cast("long").alias("n_shared"), F.size(x["want"]).cast("long").alias("n_item")))
    exact = pairs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.item_id", "x.n_shared", "x.n_item")
    exact = exact.where(F.col("n_shared") * 1000 >= F.col("n_item") * round(threshold * 1000))
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_shared", "x.n_item", "x.containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item.

    Rows with a null id stay, and so do null and empty texts; repeated rows go or stay together; empty tables take nothing away; all columns stay.
    """
    return docs.join(contained(docs, items, threshold).select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").select(docs.columns)
