"""A counterfactually regularised toxicity classifier (operator 5)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 18
GRAMS = (4, 5)
#: Features whose counts are added up in one task; the place after the last feature counts the rows.
BLOCK = 1 << 12
#: Words held by the tables of word features.
CACHED = 100_000

# Groups of identity terms; a term is swapped for the next of its group.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("men", "women"), ("man", "woman"), ("boys", "girls"), ("he", "she"), ("him", "her"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "chinese", "indian", "mexican"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("old", "young"), ("deaf", "hearing"), ("blind", "sighted"), ("immigrant", "native"), ("immigrants", "natives"),
)


def swaps(groups: Sequence[Sequence[str]]) -> dict[str, str]:
    return {term: group[(k + 1) % len(group)] for group in groups for k, term in enumerate(group)}


def word_features(word: str) -> set[int]:
    """Hashed features of a word: itself, and its character n-grams with marks at both ends."""
    marked = f"^{word}$"
    return {zlib.crc32(x.encode()) % BUCKETS for x in {marked, *(marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1))}}


#: The chosen features of each row, as places among all chosen ones.
Rows = Sequence[np.ndarray]


@dataclass
class Model:
    """Logistic regression over the presence of chosen features."""

    bias: float
    weights: dict[int, float]
    swap: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._words: dict[str, frozenset[int]] = {}

    def features(self, words: set[str]) -> set[int]:
        known, out = self._words, set()
        for w in words:
            if (found := known.get(w)) is None:
                found = frozenset(f for f in word_features(w) if f in self.weights)
                if len(known) < CACHED:
                    known[w] = found
            if found:
                out |= found
        return out

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.features(set(WORD.findall(text.lower())))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _texts(part: pd.DataFrame) -> Iterator[tuple[int, set[str]]]:
    for label, text in zip(part["toxic"], part["text"], strict=True):
        yield int(label), set(WORD.findall(text.lower()))


def _frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All counts of a task that are not zero, in blocks of features; the least count is only for their sums."""
    counts, known, rows = np.zeros((2, BUCKETS + 1), np.int32), {}, np.array([BUCKETS], np.int32)
    for part in parts:
        for label, words in _texts(part):
            found = [rows]
            for w in words:
                if (f := known.get(w)) is None:
                    f = np.array(list(word_features(w)), np.int32)
                    if len(known) < CACHED:
                        known[w] = f
                found.append(f)
            counts[label, np.unique(np.concatenate(found))] += 1
    at = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
    for of in np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1) if len(at) else ():
        yield pd.DataFrame({"block": [int(of[0]) // BLOCK], "at": [of.tobytes()], "counts": [counts[:, of].tobytes()]})


def _added(part: pd.DataFrame) -> pd.DataFrame:
    first = int(part["block"].iloc[0]) * BLOCK
    counts = np.zeros((2, BLOCK), np.int32)
    for at, c in zip(part["at"], part["counts"], strict=True):
        counts[:, np.frombuffer(at, np.int32) - first] += np.frombuffer(c, np.int32).reshape(2, -1)
    at = np.flatnonzero(counts.any(axis=0))
    return pd.DataFrame({"at": [(at + first).astype(np.int32).tobytes()], "counts": [counts[:, at].tobytes()]})


def chosen(positive: np.ndarray, negative: np.ndarray, p: int, n: int, least_z: float, most: int) -> np.ndarray:
    """Features whose presence depends on the label: smoothed log odds ratio over its standard error."""
    a, b, c, d = positive + 0.5, p - positive + 0.5, negative + 0.5, n - negative + 0.5
    z = np.abs(np.log(a / b) - np.log(c / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z[positive + negative < 4] = 0
    order = np.lexsort((np.arange(len(z)), -z))[:most]
    return order[z[order] >= least_z]


def fit_logistic(rows: Rows, labels: np.ndarray, pairs: tuple[Rows, Rows], width: int, l2: float, penalty: float, steps: int = 400, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Weights by Adam: log loss, plus l2 |w|^2 / 2, plus ``penalty`` times the mean squared change of the logit over pairs."""
    at, which = _sparse(rows)
    n_pairs = len(pairs[0])
    (one_at, one_of), (other_at, other_of) = _sparse(pairs[0]), _sparse(pairs[1])
    pair_at, pair_of = np.concatenate([one_at, other_at]), np.concatenate([one_of, other_of])
    sign = np.repeat([1.0, -1.0], [len(one_at), len(other_at)])
    y = labels.astype(float)
    w, bias = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(which, w[at], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(at, error[which], width) + l2 * w
        if n_pairs:
            change = np.bincount(pair_of, sign * w[pair_at], n_pairs)
            g += 2 * penalty / n_pairs * np.bincount(pair_at, sign * change[pair_of], width)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return float(bias), w


def _sparse(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.concatenate([np.zeros(0, np.int32), *rows]), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)


def train(labelled: DataFrame, groups: Sequence[Sequence[str]] = IDENTITIES, penalty: float = 1.0, l2: float = 1e-4, least_z: float = 4.0, most_features: int = 4096) -> Model:
    """Fit on ``labelled`` (``text``, ``toxic`` of 0 or 1), which is small: see ``sample``.

    Two passes count features by label and return each row's chosen features, four bytes each; the fit runs on the driver.
    Counts are whole before any is left out, so the model does not depend on the number of partitions.
    Rows with identity terms also give their features with the terms swapped, and score changes between
    the two are penalised. Without rows of both labels the score is the smoothed share of label 1.
    """
    spark = labelled.sparkSession
    of_row = F.col("doc_id") if "doc_id" in labelled.columns else F.xxhash64("text")
    spread = labelled.select("toxic", "text", of_row.alias("of")).repartition(shared.partitions(spark), F.xxhash64("of"))
    counted = spread.mapInPandas(_frequencies, "block int, at binary, counts binary").groupBy("block").applyInPandas(_added, "at binary, counts binary").collect()
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    for r in counted:  # a row for each block of features
        counts[:, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.int32).reshape(2, -1)
    rows, counts = counts[:, BUCKETS], counts[:, :BUCKETS]
    swap = swaps(groups)
    share = float(np.log((rows[1] + 0.5) / (rows[0] + 0.5)))
    if not rows.all():
        return Model(share, {}, swap)
    features = chosen(counts[1], counts[0], int(rows[1]), int(rows[0]), least_z, most_features)
    probe = Model(0.0, dict.fromkeys(sorted({int(f) for f in features} | {f for t in swap for f in word_features(t) if counts[:, f].sum() >= 4}), 0.0), swap)

    index = {f: k for k, f in enumerate(probe.weights)}

    def chosen_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = lambda words: np.array(sorted(index[f] for f in probe.features(words)), "<i4").tobytes()
        for part in parts:
            out = []
            for label, words in _texts(part):
                terms = words & swap.keys()
                out.append((label, places(words), places((words - terms) | {swap[t] for t in terms}) if terms else None))
            yield pd.DataFrame(out, columns=["label", "found", "swapped"])

    data = sorted(((r["label"], bytes(r["found"]), None if r["swapped"] is None else bytes(r["swapped"])) for r in spread.mapInPandas(chosen_of, "label int, found binary, swapped binary").collect()), key=lambda x: (x[0], x[1], x[2] is None, x[2] or b""))
    rows_at = [np.frombuffer(found, "<i4") for _, found, _ in data]
    pairs = [(rows_at[k], np.frombuffer(swapped, "<i4")) for k, (_, _, swapped) in enumerate(data) if swapped is not None]
    bias, weights = fit_logistic(rows_at, np.array([label for label, _, _ in data]), ([a for a, _ in pairs], [b for _, b in pairs]), len(index), l2, penalty)
    return Model(bias, {f: float(weights[k]) for f, k in index.items()}, swap)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fifth, chosen by hashes of id and text, written once.

    A document with both labels counts as toxic; rows of one id and text count once, rows of one id with different
    texts each. Labels without a document, and those that are not 0 or 1, are left out.
    """
    keys = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    keys = keys.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = shared.id_and_text(docs, id_col, text_col).join(F.broadcast(keys), "doc_id").select("doc_id", "text", "toxic")
    rows = shared.cut(rows.dropDuplicates(["doc_id", "text"]))
    if rows.count() > max_rows:  # ids that repeat with different texts
        rows = shared.cut(rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows))
    return rows


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` in 0 to 1 for every whole text, without a shuffle.

    Null and empty texts get the score of no features; rows that repeat and rows with a null id each
    give a row; an empty table gives an empty one; other columns are never looked at. A very long text is held whole
    with the set of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, 2048):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return shared.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score at or over ``threshold``.

    Rows with a null or empty text stay; repeated rows go or stay together; an empty table gives an empty one; all columns stay.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, 2048):
            yield part.filter(pa.array([not t or model.score(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def verdicts(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Train outside the held-out fifth and score every document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    scored = score(docs, train(sample(docs, labels, max_rows)))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
