"""Exact Jaccard join on word n-grams through a token-group matrix (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packed as packs
from . import shared
from .components import components
from .shared import U64

WORDS, PERCENT = 4, 85
#: Share of the hash space whose shingles are first asked for (as a shift: 1/4), star rounds, members of a
#: group, queries that meet a group at once.
ZONE_SHIFT, STARS, GROUP, QUERIES = 62, 4, 64, 512
#: Ratio between the sizes of neighbouring size classes; a round of pruning that leaves more than this share of the tokens is the last.
CLASS, ENOUGH = 1.02, 0.9
_STEP = U64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_words = _Words()


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each document, ascending inside it, and n + 1 offsets.

    A-Z are lowered; words lie between spaces and the control characters 9 to 13. A document of fewer
    words has its whole sequence as one shingle; one without words has none.
    """
    text = data.tobytes().lower()
    words, sizes = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        found = text[a:b].split()
        words += found
        sizes.append(len(found))
    counts = np.array(sizes, np.int64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    h = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        h = h * _STEP + w[k : len(w) - n + 1 + k]
    inside = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
    h, owner = shared.mixed(h[inside]), doc[: len(h)][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = [xxhash.xxh3_64_intdigest(b"\0".join(words[first[k] : first[k] + counts[k]]), seed=1) for k in short.tolist()]
    h, owner = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(counts) + 1))


def _zone(words: int):
    def zone(ids: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, ends = shingle_sets(data, at, words)
        keep = (h >> U64(ZONE_SHIFT)) == 0
        return shared.mixed(h[keep]), np.repeat(np.arange(len(ids)), np.diff(ends))[keep]

    return zone


def _sets(words: int, percent: int):
    def sets(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """A row for each document of a batch; its set only if enough of its zone is shared for a link to be possible, and once."""
        out = []
        if len(docs):
            row = docs.iloc[0]
            ids, data, at = packs.opened(row["ids"], row["ends"], row["text"])
            h, ends = shingle_sets(data, at, words)
            asked = (h >> U64(ZONE_SHIFT)) == 0
            zone = shared.mixed(h[asked])
            known, _ = packs.flags_of(answers)
            alone = np.zeros(len(h), np.int64)
            if len(zone):
                alone[asked] = ~known[np.searchsorted(np.unique(zone), zone)]
            missing = np.append(0, np.cumsum(alone))
            missing = missing[ends[1:]] - missing[ends[:-1]]
            sent: set[bytes] = set()
            seeds = (np.arange(1, STARS + 1, dtype=np.uint64) * _STEP)[:, None]
            for k, doc in enumerate(ids.tolist()):
                s = h[ends[k] : ends[k + 1]]
                if len(s) and missing[k] <= (100 - percent) * len(s) // 100:
                    node = xxhash.xxh3_128_digest(s.tobytes())
                    mins = None if node in sent else shared.mixed(s[None, :] ^ seeds).min(axis=1).view(np.int64).tolist()
                    out.append((doc, len(s), node, missing[k] / len(s), mins, None if node in sent else s.tobytes()))
                    sent.add(node)
                else:
                    out.append((doc, len(s), None, None, None, None))
        return pd.DataFrame(out, columns=["doc_id", "n_shingles", "node", "alone", "mins", "tokens"])

    return sets


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, 4096):
            x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
            yield part.select([0, 1]).filter(pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)], pa.bool_()))

    return verify


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, hashes as bytes, as an array of longs."""
    for part in shared.slices(batches, 4096):
        raw = part.column(part.num_columns - 1).to_pylist()
        at = np.append(0, np.cumsum([len(x) // 8 for x in raw])).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), np.int64)))
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], keys], [*part.schema.names[:-1], "keys"])


def _open(percent: int):
    def opened(key: tuple, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """Bound the overlap of each query with the group by the group's union; only where it qualifies look at the members.

        A query needs one link to each other component that the group has members of.
        """
        links = []
        if len(queries) and len(members):
            sets = [np.asarray(x, np.int64) for x in members["keys"]]
            sizes, comps, names = members["n"].to_numpy(), members["c"].to_numpy(), members["node"].tolist()
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            union = np.unique(flat)
            for node, c, n, most, raw in zip(queries["node"], queries["c"], queries["n"], queries["most"], queries["keys"], strict=True):
                fits = (comps != c) & (sizes <= most) & (100 * sizes >= percent * n)
                if not fits.any():
                    continue
                q = np.sort(np.asarray(raw, np.int64))
                if (100 + percent) * int(np.isin(q, union, assume_unique=True).sum()) < percent * (n + sizes[fits].min()):
                    continue
                at = np.minimum(np.searchsorted(q, flat), len(q) - 1)
                both = np.bincount(owner[q[at] == flat], minlength=len(sets))
                found = np.flatnonzero(fits & (both > 0) & ((100 + percent) * both >= percent * (n + sizes)))
                for k in found[np.unique(comps[found], return_index=True)[1]].tolist():
                    links.append((node, names[k]))
        return pd.DataFrame(links, columns=["a", "b"])

    return opened


def _class(n: Column) -> Column:
    """Size class: sizes of one class differ by less than the factor ``CLASS``."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.lit(log(CLASS))).cast("int")


def _least(percent: int) -> Column:
    """The smallest set that a set of ``n`` can be linked with."""
    return F.ceil(F.col("n") * percent / 100)


def _rows(state: DataFrame) -> DataFrame:
    return state.select(*[c for c in state.columns if c not in ("keys", "node")], F.explode("keys").alias("key"))


def _still(state: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``state`` with the keys of ``rows`` and the largest partner that they allow, without nodes that can have no partner."""
    kept = rows.groupBy("id").agg(F.collect_list("key").alias("keys"))
    most = F.floor((100 + percent) * F.size("keys") / percent).cast("long") - F.col("n")
    return shared.cut_few(state.drop("keys", "most").join(kept, "id").withColumn("most", most).where(F.col("most") >= _least(percent)))


def pruned(state: DataFrame, percent: int) -> DataFrame:
    """Nodes (``id``, ``c``, ``n``, ``keys``, and more) that can have a link to another component, with the keys that such links can share.

    First a key needs two components. Then it needs, for each node, another component among the sizes that
    the node can be linked with; of n keys a node that keeps s can be linked with sets of up to
    (100 + p) / p * s - n. Who leaves, or loses keys, may take others along, so this is repeated while it pays.
    """
    rows = _rows(state)
    wide = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    state = _still(state, rows.join(wide, "key"), percent)
    size = None
    while True:
        shared.release(state.sparkSession)
        now = state.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
        if not now or (size is not None and now > ENOUGH * size):
            return state
        size, rows = now, _rows(state)
        cells = rows.groupBy("key", _class(F.col("n")).alias("s")).agg(F.min("c").alias("low"), F.max("c").alias("high"))
        cells = cells.groupBy("key").agg(F.collect_list(F.struct("s", "low", "high")).alias("cells"))  # one for each size class
        rows = rows.withColumns({"from": _class(_least(percent)), "to": _class(F.col("most"))}).join(cells, "key")
        usable = F.exists("cells", lambda x: (x["s"] >= F.col("from")) & (x["s"] <= F.col("to")) & ((x["low"] != F.col("c")) | (x["high"] != F.col("c"))))
        state = _still(state, rows.where(usable), percent)


def matrix_links(state: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``): a link, at least, between any two components of ``pruned`` nodes that have one.

    Groups hold nodes of a common min-hash ``m`` and one size class. A node asks groups that hold members of a
    larger component (by nodes, then by hash), so a large group of copies is asked and does not ask.
    """
    sizes = state.groupBy("c").agg(F.count(F.lit(1)).alias("of"))
    spread = state.groupBy("m", _class(F.col("n")).alias("s")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("chunks"))
    state = state.withColumn("s", _class(F.col("n"))).join(spread, ["m", "s"]).join(sizes, "c")
    state = shared.cut_few(state.select("id", "node", "c", "n", "most", F.struct("of", "c").alias("rank"), F.xxhash64("m", "s", F.pmod("id", "chunks")).alias("g"), "keys"))
    rows = _rows(state)
    matrix = shared.cut_few(rows.groupBy("key", "g").agg(F.max("rank").alias("top"), F.min("n").alias("small"), F.max("n").alias("large"), F.max("most").alias("reach")))
    counts = matrix.groupBy("key").agg(F.count(F.lit(1)).alias("n_groups"))
    rarest = F.row_number().over(Window.partitionBy("id").orderBy("n_groups", "key"))
    have = F.count(F.lit(1)).over(Window.partitionBy("id"))
    need = F.ceil(percent * (F.col("n") + _least(percent)) / (100 + percent))
    rare = rows.join(counts, "key").select("id", "n", "most", F.col("rank").alias("own"), "key", rarest.alias("place"), have.alias("have")).where(F.col("place") <= F.col("have") - need + 1)
    fits = (F.col("own") < F.col("top")) & (F.col("small") <= F.col("most")) & (F.col("n") <= F.col("reach")) & (100 * F.col("large") >= percent * F.col("n"))
    asked = shared.cut_few(rare.join(matrix, "key").where(fits).select("id", "g").distinct())
    parts = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    nodes = state.select("id", "node", "c", "n", "most", "keys")
    queries = asked.join(parts, "g").select(F.col("g").alias("qg"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("qp"), "id").join(nodes, "id").drop("id")
    members = state.select("g", "node", "c", "n", "keys").join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return shared.cut_few(queries.groupBy("qg", "qp").cogroup(members.groupBy("g", "part")).applyInPandas(_open(percent), "a binary, b binary"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links of ``percent`` Jaccard similarity or more between sets of shingles of ``words`` words, as components.

    Returns for each row ``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable by links) and
    ``n_copies`` (rows with the very same set, itself included).

    1. A quarter of the hash space decides who can have a link at all: a document of n shingles misses at
       most 15 percent of n of them in a partner (at 85 percent), so one with more unshared hashes there is done.
    2. Equal sets are one node. Nodes with a common min-hash are compared with one of them, the one with the least
       share of unshared hashes and so the nearest to what all were copied from, in four rounds of stars, and verified
       links make components. This is where large groups of copies fall together without their pairs.
    3. What is left can only link different components. ``pruned`` takes away the tokens that cannot be shared
       by such a link, and the nodes that keep too few.
    4. The token-group matrix finds the links of the rest, exactly (``matrix_links``): nodes with a common min-hash
       and similar sizes form groups of about 64, and a cell tells which groups have a token, in which sizes and
       components. Each node asks the groups that hold one of its rarest tokens, as many as it takes for every
       partner to have one. The query's overlap with the union of a group's tokens bounds every member's; groups
       that qualify are opened and the members verified. Groups with many queries meet them in parts.

    Null and empty texts, and texts of white space, have no shingles and form components of their own.
    Repeated rows link; rows with one id and different texts are different nodes; a null id counts as
    the largest, and a component of null ids alone has a null id. An empty table gives an empty one; other columns are
    ignored. A very long text is held whole, about 60 bytes for each of its words, by the task that has its batch.
    """
    spark = docs.sparkSession
    packed = packs.pack(docs, id_col, text_col)
    flags = packs.shared_flags(packed, _zone(words), packs.bucket_count(packed))
    rows = packed.drop("size").groupBy("batch").cogroup(flags.groupBy("batch")).applyInPandas(_sets(words, percent), "doc_id long, n_shingles long, node binary, alone double, mins array<long>, tokens binary")
    rows = shared.cut(rows)
    del packed, flags
    shared.release(spark)
    some = rows.where("node is not null")
    first = lambda name: F.first(name, ignorenulls=True).alias(name)
    nodes = shared.cut(some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n"), F.min("alone").alias("alone"), first("mins"), first("tokens")))
    rows = shared.cut_few(rows.select("doc_id", "n_shingles", "node"))
    del some
    shared.release(spark)

    keyed = nodes.select("node", "doc_id", "n", "alone", F.posexplode("mins").alias("r", "m"))
    centres = keyed.groupBy("r", "m").agg(F.min(F.struct("alone", "doc_id", "node", "n")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1").select("r", "m", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"))
    pairs = keyed.join(centres, ["r", "m"]).where((F.col("node") != F.col("centre")) & (100 * F.least("n", "cn") >= percent * F.greatest("n", "cn"))).select("node", "centre").distinct()
    tokens = nodes.select("node", "tokens")
    stars = pairs.join(tokens, "node").join(tokens.select(F.col("node").alias("centre"), F.col("tokens").alias("other")), "centre").select("node", "centre", "tokens", "other").mapInArrow(_verify(percent), "node binary, centre binary")
    stars = shared.cut_few(stars.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    del keyed, centres, pairs
    shared.release(spark)

    placed = nodes.join(components(stars), "node", "left").select(F.xxhash64("node").alias("id"), "node", "n", F.xxhash64(F.coalesce("label", "node")).alias("c"), F.col("mins")[0].alias("m"), F.floor(F.col("n") * 100 / percent).alias("most"), "tokens")
    state = placed.mapInArrow(_as_array, "id long, node binary, n long, c long, m long, most long, keys array<long>")
    more = matrix_links(pruned(state, percent), percent)

    labels = components(stars.union(more))
    nodes = nodes.select("node", "doc_id", "n_copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = nodes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(least, "label").select("node", "component_id", "n_copies")
    missing = F.lit(int(shared.NO_ID))
    return rows.select("doc_id", "n_shingles", "node").join(named, "node", "left").select(
        F.nullif("doc_id", missing).alias("doc_id"), "n_shingles", F.nullif(F.coalesce("component_id", "doc_id"), missing).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of least id of each component; rows with a null id, or without words, stay.

    Documents go by id: repeated rows of a kept id all stay, and a row goes if its id is in a component with a smaller
    one. An empty table gives an empty one; very long texts are as in ``join``.
    """
    joined = join(docs, words=words, percent=percent)
    gone = joined.where("doc_id is not null and component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
