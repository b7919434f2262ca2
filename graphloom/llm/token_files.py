"""Token ids in bit-packed files (operator 6).

A file holds the documents of one stretch of ids, all integers little-endian unless said otherwise:

    magic "GLTOK1\\0\\0" | bits u32 | ids in a block u32 | documents u64 | ids u64 | blocks u64
    doc_id i64 x documents | ids before each document, and in all, u64 x (documents + 1)
    byte offset of each block, and of the end, u64 x (blocks + 1)
    blocks: ids of ``bits`` bits each, most significant bit first, the last byte filled with zeros

``bits`` is the least number that holds every id of the vocabulary. A block starts at a byte, so any
document is read by unpacking only the blocks that it touches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, word_bpe

MAGIC = b"GLTOK1\0\0"
BLOCK = 4096
#: Ids after which a task starts another file.
FILE_IDS = 8 << 20
_HEAD = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("blocks", "<u8")])


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(each).tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = each
    return np.packbits(wide, axis=1).view(">u4").reshape(n).astype("<u4")


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    parts = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    head = np.zeros((), _HEAD)
    head["magic"], head["bits"], head["block"], head["docs"], head["ids"], head["blocks"] = MAGIC, bits, block, len(doc_ids), len(ids), len(parts)
    before = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    begin = _HEAD.itemsize + 8 * len(doc_ids) + 8 * len(before) + 8 * (len(parts) + 1)
    offsets = (begin + np.concatenate([[0], np.cumsum([len(p) for p in parts])])).astype("<u8")
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), before.tobytes(), offsets.tobytes(), *parts])


class TokenFile:
    """One file: its header is held, and ``read`` and ``document`` fetch only the blocks that they touch.

    From the file's bytes, or by ``at`` from a store, where each fetch is a seek.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.fetch = data if callable(data) else lambda a, b: memoryview(data)[a:b]
        head = np.frombuffer(self.fetch(0, _HEAD.itemsize), _HEAD, 1)[0]
        if head["magic"].ljust(8, b"\0") != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.n_ids = int(head["bits"]), int(head["block"]), int(head["ids"])
        docs, blocks = int(head["docs"]), int(head["blocks"])
        rest = self.fetch(_HEAD.itemsize, _HEAD.itemsize + 8 * (2 * docs + blocks + 2))
        self.doc_ids = np.frombuffer(rest, "<i8", docs)
        self.before = np.frombuffer(rest, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(rest, "<u8", blocks + 1, 16 * docs + 8).astype(np.int64)

    @classmethod
    def at(cls, folder: str, name: str) -> TokenFile:
        store, path = _store(folder)
        file = store.open_input_file(f"{path}/{name}")

        def fetch(a: int, b: int) -> bytes:
            file.seek(a)
            return file.read(b - a)

        return cls(fetch)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end`` of the file."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        cuts = (self.offsets[first : last + 2] - self.offsets[first]).tolist()
        data = self.fetch(int(self.offsets[first]), int(self.offsets[last + 1]))
        parts = [unpack(data[cuts[k - first] : cuts[k - first + 1]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.before[k]), int(self.before[k + 1]))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write under another name and move, so that a lost or repeated task leaves a whole file or none."""
    store, at = _store(folder)
    spare = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(spare) as out:
        out.write(data)
    store.move(spare, f"{at}/{name}")


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    codec = word_bpe.library(tokenizer)
    bits = max(1, (codec.size - 1).bit_length())
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    part, seq, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

    def flush() -> pa.RecordBatch:
        name = f"tokens-{part:06d}-{seq:06d}.bin"
        counts = np.array([len(x) // 4 for x in held], np.int64)
        _put(folder, name, file_bytes(np.concatenate(ids), counts, np.frombuffer(b"".join(held), "<u4"), bits))
        return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(counts)], "n_ids": [int(counts.sum())]})

    for rows in shared.slices(batches, 512):
        new = [x + end for x in codec.encode(rows.column(1).to_pylist())]
        held += new
        ids.append(shared.ids_of(rows.column(0)))
        size += sum(map(len, new)) // 4
        if size >= FILE_IDS:
            yield flush()
            seq, held, ids, size = seq + 1, [], [], 0
    if held:
        yield flush()


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with the tokenizers library and write the ids, in ascending order of documents.

    Rows are dealt by ranges of their id and sorted inside, each task writes the files of its range, and
    names ascend with the ranges. ``folder`` is a path or URI that all executors share. Returns one row
    for each file: ``file``, ``n_docs``, ``n_ids`` and ``start``, the ids in all files before it. Null
    texts are empty; null ids come last, in one range; repeated ids stand next to each other, by text. An empty table
    writes no file; other columns are ignored. A very long text is encoded whole; a file ends after the document that fills it.
    """
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    rows = shared.id_and_text(docs, id_col, text_col)
    dealt = rows.repartitionByRange(shared.partitions(docs.sparkSession), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    files = shared.cut(dealt.mapInArrow(partial(_write, tokenizer=tokenizer, folder=folder, end_id=end_id), "file string, n_docs long, n_ids long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame, folder: str) -> DataFrame:
    """Every document of the files of ``write``: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, start in zip(part["file"], part["start"], strict=True):
                file = TokenFile.at(folder, name)
                for at in range(0, len(file.doc_ids), 1024):
                    docs = range(at, min(at + 1024, len(file.doc_ids)))
                    counts = np.diff(file.before[at : docs.stop + 1])
                    ids = file.read(int(file.before[at]), int(file.before[docs.stop])).tobytes()
                    cuts = 4 * (file.before[at : docs.stop + 1] - file.before[at])
                    doc_ids = pd.array(file.doc_ids[at : docs.stop], dtype="Int64")
                    doc_ids[file.doc_ids[at : docs.stop] == shared.NO_ID] = pd.NA
                    yield pd.DataFrame({"doc_id": doc_ids, "start": start + file.before[at : docs.stop], "n_tokens": counts, "ids": [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    spark = files.sparkSession
    spread = files.repartition(shared.partitions(spark), "file")
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark) -> str:
    return f"{shared.shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"


def digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["TokenFile", "digests", "file_bytes", "new_folder", "pack", "read", "unpack", "write"]
