"""BPE encoding and decoding by speculation and verification (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, word_bpe

#: Documents encoded together, so that new words are tested in large groups.
GROUP = 512


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the text that they decode to.

    Greedy longest match proposes the tokens of each new word, one vectorised lookup tests all pairs of
    neighbours of all new words, and the words with a pair that fails are merged exactly, also in
    vectorised steps (see ``word_bpe.SpeculativeCodec``). There is no shuffle; a task holds one group of
    documents and a bounded table of words.

    ``tokenizer`` is the path of a file in the ``tokenizers`` JSON format that every executor can open;
    nothing is added at either end of a text, nothing is cut or padded.

    Returns ``doc_id``, ``n_tokens``, ``ids`` (binary: little-endian unsigned 32-bit integers) and
    ``decoded``. Null and empty texts have no tokens and decode to an empty text; rows that repeat, and
    rows with a null id, each give a row; other columns of ``docs`` are ignored; an empty table gives an
    empty one. A very long text is encoded whole, and a very long word in it in n log n steps, at about 200 bytes
    for each of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe.speculative(tokenizer)
        for part in shared.slices(batches, GROUP):
            ids = codec.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return shared.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
