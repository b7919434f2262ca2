"""Documents in packed batches, and which of their hashed values other documents have too.

Several operators first ask, for every hashed value of every document (anchors, shingles), whether any
other document has it. Values travel as arrays, one row for each batch and bucket of values, and the
answer comes back as one bit for each distinct value of a batch, so hot values cost a few bytes a batch
however many documents have them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import U64

#: Bytes of text in a batch, and of text whose values share a bucket.
BATCH, BUCKET = 2 << 20, 32 << 20

#: (ids, all bytes, offsets) of a batch's documents.
Docs = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Values of a batch and the row of the document of each, in any order.
Values = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Batches of documents with their whole texts compressed, written once: ``batch``, ``ids``, ``ends``, ``text``, ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for part in shared.slices(batches, 1 << 20, BATCH):
            data, at = shared.utf8(part.column(1))
            yield pa.RecordBatch.from_pydict({"batch": [number], "ids": [shared.ids_of(part.column(0)).tobytes()], "ends": [at.tobytes()], "text": [squeeze.compress(data.tobytes())], "size": [len(data)]})
            number += 1

    return shared.cut(shared.id_and_text(docs, id_col, text_col).mapInArrow(run, "batch long, ids binary, ends binary, text binary, size long"))


def opened(ids: bytes, ends: bytes, text: bytes) -> Docs:
    at = np.frombuffer(ends, np.int64)
    data = zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(at[-1])))
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.uint8), at


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and in how many rows each is."""
    order = np.lexsort((rows, values))
    v, r = values[order], rows[order]
    if not len(v):
        return v, np.zeros(0, np.int64)
    new = np.append(True, v[1:] != v[:-1])
    first = np.append(True, new[1:] | (r[1:] != r[:-1]))
    at = np.flatnonzero(new)
    return v[at], np.add.reduceat(first.astype(np.int64), at)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (((values >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def cut_by(ordered: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """The values of a sorted array and where each begins and ends, in steps of the array's length and not of the values' range."""
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at], at.tolist(), [*at[1:].tolist(), len(ordered)] if len(at) else []


def bucket_count(packed: DataFrame) -> int:
    size = packed.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-size // BUCKET))


def shared_flags(packed: DataFrame, values: Values, buckets: int, hot: int = 1 << 62) -> DataFrame:
    """For each batch and bucket, a bit for each of the batch's distinct values in ascending order.

    ``shared``: two documents or more have the value; ``hot``: ``hot`` documents or more. Values must be
    spread evenly over 64 bits. Written once: it is about a bit a value. Only buckets that a batch has values for
    get a row of it, so there are never more rows than values.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                found, docs = distinct(*values(*opened(row["ids"], row["ends"], row["text"])))
                some, begin, end = cut_by(bucket_of(found, buckets))
                counts = np.minimum(docs, 65535).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(some, pa.int32()), "batch": pa.array([row["batch"]] * len(some), pa.int64()),
                    "vals": pa.array([found[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()), "docs": pa.array([counts[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
                })

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(v) // 8 for v in part["vals"]]
        all_values = np.frombuffer(b"".join(part["vals"]), np.uint64)
        docs = np.frombuffer(b"".join(part["docs"]), np.uint16).astype(np.int64)
        order = np.argsort(all_values, kind="stable")
        v = all_values[order]
        at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        total = np.add.reduceat(docs[order], at)
        each = np.empty(len(v), np.int64)
        each[order] = np.repeat(total, np.diff(np.append(at, len(v))))
        ends = np.cumsum(sizes)
        pieces = [each[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        return pd.DataFrame({"batch": part["batch"], "bucket": part["bucket"], "n": sizes, "shared": [np.packbits(x > 1).tobytes() for x in pieces], "hot": [np.packbits(x >= hot).tobytes() for x in pieces], "n_shared": [int((x > 1).sum()) for x in pieces]})

    sent = packed.select("batch", "ids", "ends", "text").mapInArrow(send, "bucket int, batch long, vals binary, docs binary")
    return shared.cut(sent.groupBy("bucket").applyInPandas(meet, "batch long, bucket int, n int, shared binary, hot binary, n_shared long"))


def flags_of(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bits of one batch, for all its distinct values in ascending order."""
    answers = answers.sort_values("bucket")
    bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(answers[name], answers["n"], strict=True)] or [np.zeros(0, np.uint8)]).astype(bool)
    return bits("shared"), bits("hot")
