"""Secret scans: patterns, and sliding-window entropy for what patterns miss (operator 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

# The base patterns, each with the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a longest run of 32 or more is what [0-9a-f]+ finds
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "entropy")
_NAMES = ("passw", "secret", "token", "api_key", "apikey")

#: Candidate strings for the entropy test: long runs of the characters that keys are written in.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Characters of a candidate that may join it to a base span.
GLUE = "+/_=-"
#: Least entropy in bits per character of a window, by character class: (name, all of its characters, bits).
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+"), 3.0), ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.6), ("base64", re.compile(r"[A-Za-z0-9+/=]+"), 3.8), ("key", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9))
#: Candidates that look random but are not secrets.
ALLOWED = (
    re.compile(r"[A-Za-z]+"),  # words of any length
    re.compile(r"[0-9_+/=-]+"),  # numbers and rules
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"(?:[A-Za-z]+[/_=-]+)+[A-Za-z]*[0-9]{0,4}"),  # paths and names of words
    re.compile(r"(.{1,4})\1{4,}.{0,3}"),  # repeated patterns
)


@lru_cache(maxsize=4)
def _steps(window: int) -> np.ndarray:
    """c * log2(c) for every count in a window."""
    counts = np.arange(window + 1, dtype=float)
    return counts * np.log2(np.maximum(counts, 1))


def best_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits per character, of any window of ``text``; shorter text is one window.

    The counts change by one character leaving and one entering, so each step costs the same whatever the window.
    """
    window = min(window, len(text))
    if not window:
        return 0.0
    table, counts, total = _steps(window), {}, 0.0
    log = float(np.log2(window))
    best = 0.0
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        total += table[n + 1] - table[n]
        counts[c] = n + 1
        if k >= window:
            old = text[k - window]
            n = counts[old]
            total += table[n - 1] - table[n]
            counts[old] = n - 1
        if k >= window - 1:
            best = max(best, log - total / window)
    return best


def suspicious(text: str) -> bool:
    """Whether a candidate has both letters and digits, a window of high entropy for its class, and is not allowed."""
    if any(a.fullmatch(text) for a in ALLOWED) or not (re.search(r"[0-9]", text) and re.search(r"[A-Za-z]", text)):
        return False
    bits = next(least for _, pattern, least in CLASSES if pattern.fullmatch(text))
    return best_entropy(text) >= bits


def _left(start: int, end: int, base: list[tuple[int, int, int]], at: int = 0) -> Iterator[tuple[int, int]]:
    """The stretches of start to end that no base span from number ``at`` on covers; ``base`` is sorted."""
    while at < len(base) and base[at][0] < end and start < end:
        a, b, _ = base[at]
        if start < b:
            if start < a:
                yield start, a
            start = b
        at += 1
    if start < end:
        yield start, end


def _unglued(stretch: str, left: bool, right: bool) -> str:
    """What is judged of a stretch: without the marks that join it to a base span, unless too little is left."""
    out = stretch.lstrip(GLUE) if left else stretch
    out = out.rstrip(GLUE) if right else out
    return out if len(out) >= WINDOW else stretch


def spans(text: str, entropy: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed in ``KINDS``."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if entropy:
        base, at = sorted(out), 0
        for m in CANDIDATE.finditer(text):  # spans that end before a candidate end before all later ones
            while at < len(base) and base[at][1] <= m.start():
                at += 1
            out += [(a, b, 3) for a, b in _left(m.start(), m.end(), base, at) if b - a >= WINDOW and suspicious(_unglued(text[a:b], a > m.start(), b < m.end()))]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def redacted(text: str, found: list[tuple[int, int, str]], mark: str) -> str:
    """``text`` with every stretch that spans cover replaced once."""
    out, at = [], 0
    end = -1
    for a, b, _ in found:
        if a >= end:
            if end >= 0:
                out.append(mark)
            out.append(text[max(at, 0) : a])
            end = at = b
        else:
            end = at = max(end, b)
    return text if end < 0 else "".join([*out, mark, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: ``doc_id`` and ``found``, an array of (start, end, kind).

    The base kinds come from patterns. The method adds kind ``entropy``: strings of 20 or more key
    characters, in what base spans leave of a run of them, of which some window of 20 characters reaches the entropy asked of
    the string's character class, and which the allow-list (words, numbers, UUIDs, paths, repeats) does
    not excuse. There is no shuffle. Null and empty texts have no spans; rows that repeat and rows with
    a null id each give a row; other columns are ignored; an empty table gives an empty one. A very long text is scanned
    whole, in steps of its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for part in shared.slices(batches, 2048):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return shared.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<start: long, end: long, kind: string>>")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; the column of lengths follows.

    Null texts stay null; empty texts, repeated rows and an empty table come out as they are; all other columns stay.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for part in shared.slices(batches, 2048):
            new = [t if not t or not (s := spans(t)) else redacted(t, s, mark) for t in part.column(at).to_pylist()]
            yield part.set_column(at, text_col, pa.array(new, part.column(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in names else out


def digests(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans and the text of all spans."""
    def text(x):
        return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))

    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["kind"] != "entropy"), text), ",")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), F.array_join(F.transform("found", text), ",").alias("spans"))
