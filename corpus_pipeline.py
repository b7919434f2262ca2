"""A corpus from raw documents to token ids, in stages that each read what the one before wrote.

toxicity        drops documents that the classifier rejects
near_duplicates keeps the document of least id of each group of near copies, linked by 80 percent of five-word shingles
decontamination drops documents that contain a benchmark item
secrets         replaces every secret in the text by a mark
tokens          encodes the text and checks that it decodes; the result of the pipeline

All but the last return the columns of ``documents``, whatever they are and whatever their names. Rows with null ids or
texts pass the filters, and empty texts too; a null text has no tokens. Repeated rows of a kept id all stay to the
end. Empty tables give an empty result; without labels of both kinds nothing is toxic, unless all labels are. Very long
texts are taken whole by every stage, by the task that has them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe_codec, decontamination, jaccard_join, secret_scan, shared, toxicity
from graphloom.llm.queries import table, tokenizer


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(toxicity.sample(docs, table(spark, sf_dir, "labels"))))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe_codec.encode_decode(docs, tokenizer())
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("secrets", without_secrets), ("tokens", tokens)]

#: Training a classifier and merging tokens are not SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet in the shared folder and read again.

    A stage's folder goes when the next stage has been written; the last one stays, as the result is read from it.
    """
    folder = f"{shared.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            shared.remove(spark, f"{folder}/{before}")
        before = name
    return docs
