"""Exact substring dedup over run-compressed Burrows-Wheeler indexes (operator 1).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document of smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as packs
from . import shared
from .shared import NO_ID, U64

LENGTH, GRAM, LONGER = 50, 16, 40
#: Windows in a piece; documents from which an anchor's windows are dealt one by one; bytes of pieces
#: in a bucket; indexes in a bucket; windows hashed at once; repeated texts that are broadcast.
CHUNK, HOT, BUCKET, PARTS, BLOCK, FIRSTS = 60, 20_000, 16 << 20, 16, 1 << 14, 200_000
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def _doublings(size: int) -> list[int]:
    """Steps that make one of something into ``size``, each of as much as there is at most."""
    out, have = [], 1
    while have < size:
        out.append(min(have, size - have))
        have += out[-1]
    return out


def _least_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """For each window of ``LENGTH`` bytes, the least hash of its ``gram``-byte strings."""
    h = data.astype(np.uint64) + U64(1)
    for odd, size in zip(_ODD, _doublings(gram), strict=False):
        h = h[:-size] * odd + h[size:]
        h ^= h >> U64(31)
    h = shared.mixed(h)
    for step in _doublings(LENGTH - gram + 1):
        h = np.minimum(h[:-step], h[step:])
    return h


def runs(data: np.ndarray, at: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows with one anchor: first positions, numbers of windows, anchors, rows of documents.

    A window is ``LENGTH`` bytes of one document and its anchor is the least hash of its ``gram``-byte
    strings, so equal windows have equal anchors wherever they are.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none
    h = np.empty(n, np.uint64)
    for k in range(0, n, BLOCK):  # blocks stay in the cache
        h[k : k + BLOCK] = _least_hashes(data[k : k + BLOCK + LENGTH - 1], gram)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    valid = np.arange(n) + LENGTH <= at[1:][doc]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    return first, np.flatnonzero(last) - first + 1, shared.mixed(h[first] ^ _ODD[0]), doc[first]


def _anchors(ids: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, anchors, docs = runs(data, at)
    return anchors, docs


class Pieces:
    """The pieces of a batch: windows whose anchor other documents have, as short strings, each content once.

    ``first`` and ``windows`` are of occurrences, ``of`` is the number of an occurrence's content;
    ``content``, ``owner`` (least id), ``bucket``, ``part`` of it and ``group`` are of contents. Contents with one anchor are of
    one group. A hot anchor's windows are pieces of their own, dealt and grouped by what they hold, so that no bucket
    gets all of a frequent string's surroundings.
    """

    def __init__(self, docs: packs.Docs, answers: pd.DataFrame, buckets: int):
        ids, data, at = docs
        first, windows, anchors, rows = runs(data, at)
        is_shared, is_hot = packs.flags_of(answers)
        where = np.searchsorted(np.unique(anchors), anchors)
        keep = np.flatnonzero(is_shared[where]) if len(where) else where
        first, windows, anchors, rows, hot = first[keep], windows[keep], anchors[keep], rows[keep], is_hot[where[keep]] if len(keep) else np.zeros(0, bool)
        step = np.where(hot, 1, CHUNK)
        parts = -(-windows // step)
        of_run = np.repeat(np.arange(len(first)), parts)
        k = np.arange(len(of_run)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = first[of_run] + k * step[of_run]
        self.windows = np.minimum(step[of_run], windows[of_run] - k * step[of_run])
        text, seen = data.tobytes(), {}
        self.of = np.fromiter((seen.setdefault(text[a : a + w + LENGTH - 1], len(seen)) for a, w in zip(self.first.tolist(), self.windows.tolist(), strict=True)), np.int64, len(self.first))
        self.content = list(seen)
        self.owner = np.full(len(seen), NO_ID)
        np.minimum.at(self.owner, self.of, ids[rows[of_run]])
        key = np.zeros(len(seen), np.uint64)
        key[self.of] = anchors[of_run]
        by_content = np.zeros(len(seen), bool)
        by_content[self.of] = hot[of_run]
        for c in np.flatnonzero(by_content).tolist():
            key[c] = xxhash.xxh3_64_intdigest(self.content[c])
        fine = packs.bucket_of(key, buckets * PARTS)
        self.bucket, self.part, self.group = fine // PARTS, fine % PARTS, key.astype(np.uint32)
        self.order = np.argsort(fine, kind="stable")


def suffix_ranks(codes: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of marked strings.

    ``codes`` has 0 for marks, ``left`` is the distance to the next mark and ``depth`` the longest string. Equal
    suffixes have equal ranks: the first place of their group. Prefix doubling, starting from as many
    symbols as fit a word and sorting only suffixes whose group is not single yet, each sort being one of
    plain integers that end in the position.
    """
    n = len(codes)
    bits, index = max(1, int(codes.max()).bit_length()), max(1, (n - 1).bit_length())
    first = max(1, min((63 - index) // bits, 50))
    key = np.zeros(n, np.int64)
    padded = np.append(codes, np.zeros(first, np.int64))
    for k in range(first):
        key = (key << bits) | np.where(left > k, padded[k : k + n], 0)
    key = np.sort((key << index) | np.arange(n))
    at, group = key & ((1 << index) - 1), key >> index
    rank, size = np.empty(n, np.int64), first
    new = np.append(True, group[1:] != group[:-1])
    place = np.flatnonzero(new)
    rank[at] = np.repeat(place, np.diff(np.append(place, n)))
    single = new & np.append(new[1:], True)
    live = at[~single]
    while size < depth and len(live):
        inner = left[live] > size
        follow = np.zeros(len(live), np.int64)
        follow[inner] = rank[live[inner] + size] + 1
        old = rank[live]
        if 3 * index + 1 <= 63:
            key = np.sort((((old << (index + 1)) | follow) << index) | live)
            live, pair = key & ((1 << index) - 1), key >> index
            old = pair >> (index + 1)
        else:
            order = np.lexsort((follow, old))
            live, old = live[order], old[order]
            pair = old * (n + 2) + follow[order]
        m = len(live)
        new_old = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        new = np.append(True, pair[1:] != pair[:-1])
        place = np.flatnonzero(new)
        begin = np.repeat(new_old, np.diff(np.append(new_old, m)))
        rank[live] = old + np.repeat(place, np.diff(np.append(place, m))) - begin
        live = live[~(new & np.append(new[1:], True))]
        size *= 2
    return rank


def _stable_order(values: np.ndarray) -> np.ndarray:
    """A stable argsort of small whole numbers, as one sort of plain integers that end in the position."""
    bits = max(1, (len(values) - 1).bit_length()) if len(values) else 1
    if len(values) and int(values.max()).bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    return np.sort((values << bits) | np.arange(len(values))) & ((1 << bits) - 1)


class Strings:
    """Strings in one text, each followed by a mark below all bytes, and the order of its suffixes.

    Suffixes are sorted up to their mark and then by string, so the order among any of the strings is that of all.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        n = int(sizes.sum()) + len(strings)
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        used = np.zeros(256, np.int64)
        used[text] = 1
        codes = np.cumsum(used)[text]  # 1 and up, in the order of bytes
        codes[self.ends] = 0
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), sizes + 1)
        left = self.ends[self.string] - np.arange(n)
        self.codes = codes.astype(np.int16)
        self.bits = max(1, int(codes.max()).bit_length())
        self.width = 63 // self.bits
        self.symbol_of = np.append(self.width, self.width - 1 - np.arange(63) // self.bits)  # by the highest bit, from 1; 0: none
        self.packed = np.zeros(n + 128, np.int64)  # as many symbols from each position as fit a word
        padded = np.append(codes, np.zeros(self.width, np.int64))
        for k in range(self.width):
            self.packed[:n] = (self.packed[:n] << self.bits) | np.where(left > k, padded[k : k + n], 0)
        rank = suffix_ranks(codes, left, int(sizes.max()))
        self.suffixes = np.sort((rank << 32) | np.arange(n)) & 0xFFFFFFFF

    def agreed(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``most``."""
        out, live, k = most, None, 0
        while True:
            x = self.packed[a + k] ^ self.packed[b + k]
            # the highest bit that differs, from the exponent of x without the bits that could carry; then its symbol
            top = ((x & ~(x >> 1)).astype(float).view(np.int64) >> 52) - 1022
            found = np.minimum(self.symbol_of[np.maximum(top, 0)] + k, most)
            if live is None:
                out = found
            else:
                out[live] = found
            k += self.width
            more = np.flatnonzero((x == 0) & (most > k))
            if not len(more):
                return out
            live = more if live is None else live[more]
            a, b, most = a[more], b[more], most[more]


class RunIndex:
    """Run-compressed Burrows-Wheeler transforms of some of the strings, one for each ``node`` of strings.

    Kept are only arrays with an element for each run: its first and last row, its symbol, where its first row jumps to,
    the text positions sampled at both of its ends, and the runs in the order of their symbols; and the first row of each node.
    """

    SYMBOLS = 512

    def __init__(self, text: Strings, chosen: np.ndarray, node: np.ndarray, suffixes: np.ndarray | None = None):
        """``chosen`` (flags) and ``node`` (numbers from 0) are of strings; or of several layers of them, a line each, without a common node.

        ``suffixes``: those of all chosen strings at least, in order; else of all strings.
        """
        self.text, suffixes = text, text.suffixes if suffixes is None else suffixes
        of, rows, nodes = text.string[suffixes], [], []
        for flags, numbers in zip(np.atleast_2d(chosen), np.atleast_2d(node), strict=True):
            some = np.flatnonzero(flags[of])
            found = numbers[of[some]]
            order = _stable_order(found)
            rows.append(suffixes[some[order]])
            nodes.append(found[order])
        rows, nodes = np.concatenate(rows), np.concatenate(nodes)
        n = len(rows)
        key = nodes * self.SYMBOLS + text.codes[rows - 1]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.head, self.tail, self.key = heads, np.append(heads[1:], n) - 1, key[heads]
        jump = np.empty(n, np.int64)
        jump[_stable_order(key)] = np.arange(n)
        self.jump = jump[heads]
        self.head_at, self.tail_at = rows[self.head], rows[self.tail]
        self.by_key = _stable_order(self.key)
        self.key_run = self.key[self.by_key] * len(heads) + self.by_key
        self.nodes, self.origin = np.unique(nodes, return_index=True)
        self.origin_at = rows[self.origin]

    def statistics(self, strings: np.ndarray, node: np.ndarray, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream ``strings`` (numbers) from their ends, each through the index of its ``node``; numbers go on from layer to layer.

        Gives, step by step, positions, the length of the longest match that starts there and a position where it is.
        With ``least``, a string is given up once its match ends before its first ``least`` symbols do: a match that
        starts further left and is that long would go on past this end, and so would its part from here.
        """
        text, runs = self.text, len(self.head)
        nodes, strings = node.ravel()[strings], strings % len(text.ends)
        sizes = text.ends[strings] - text.starts[strings]
        order = np.argsort(-sizes, kind="stable")  # longest first
        nodes, strings, sizes = nodes[order], strings[order], sizes[order]
        ends, base = text.ends[strings], nodes * self.SYMBOLS
        home = np.searchsorted(self.nodes, nodes)
        home_row, home_at = self.origin[home], self.origin_at[home]
        row, at, size = home_row, home_at, np.zeros(len(strings), np.int64)
        begin = text.starts[strings] + least
        for t in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            live = int(np.searchsorted(-sizes, -t, side="right"))
            if t % 4 == 0 and least:
                kept = np.flatnonzero(ends[:live] - t + 1 + size[:live] >= begin[:live])
                if len(kept) < 0.8 * live:
                    live = len(kept)
                    sizes, ends, base, begin, home_row, home_at, row, at, size = (x[kept] for x in (sizes, ends, base, begin, home_row, home_at, row, at, size))
            if not live:
                return
            row, at, size = row[:live].copy(), at[:live].copy(), size[:live].copy()
            here = ends[:live] - t
            key = base[:live] + text.codes[here]
            run = np.searchsorted(self.head, row, side="right") - 1
            miss = np.flatnonzero(self.key[run] != key)
            none = miss[:0]
            if len(miss):
                k = np.searchsorted(self.key_run, key[miss] * runs + run[miss])
                up_run, down_run = self.by_key[np.maximum(k - 1, 0)], self.by_key[np.minimum(k, runs - 1)]
                has_up, has_down = (self.key[up_run] == key[miss]) & (k > 0), (self.key[down_run] == key[miss]) & (k < runs)
                length_up = np.where(has_up, text.agreed(at[miss], self.tail_at[up_run], size[miss]), -1)
                length_down = np.where(has_down, text.agreed(at[miss], self.head_at[down_run], size[miss]), -1)
                take_up = length_up >= length_down
                run[miss] = np.where(take_up, up_run, down_run)
                row[miss] = np.where(take_up, self.tail[up_run], self.head[down_run])
                at[miss] = np.where(take_up, self.tail_at[up_run], self.head_at[down_run])
                size[miss] = np.maximum(length_up, length_down)
                none = miss[~has_up & ~has_down]  # the symbol is nowhere in the node
            row, at, size = self.jump[run] + row - self.head[run], at - 1, size + 1
            row[none], at[none], size[none] = home_row[none], home_at[none], 0
            yield here, size, at


def _can_match(strings: list[bytes], ranks: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Whether a string has an anchor of ``LONGER`` bytes in common with one of another owner in its group: else no window of it is in one."""
    at = np.append(0, np.cumsum([len(s) for s in strings]))
    _, _, anchors, of = runs(np.frombuffer(b"".join(strings), np.uint8), at, LONGER)
    keys = shared.mixed(anchors ^ (groups[of].astype(np.uint64) * _ODD[0]))
    order = np.argsort(keys)
    k, r = keys[order], ranks[of[order]]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    common = np.repeat(np.minimum.reduceat(r, first) < np.maximum.reduceat(r, first), np.diff(np.append(first, len(k))))
    out = np.zeros(len(strings), bool)
    out[of[order[common]]] = True
    return out


def earlier(strings: list[bytes], owners: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
    """For each string and each of its windows, whether a string of a smaller owner in its group has the window.

    The owners of a group are halved again and again; each time the strings of the lower halves are indexed and those
    of the upper halves are streamed through, so every two owners meet in one step, and a match of ``LENGTH`` there is one in a
    string of a smaller owner. Later steps, of fewer strings, are taken together, as layers of one index that is no larger than
    the largest of one step. Strings that share no longer anchor are not indexed at all (see ``_can_match``). Strings of which all windows are found need go no further, since who has them finds the
    same earlier string.
    """
    order = np.lexsort((owners, groups))
    g, o = groups[order], owners[order]
    new_group = np.append(True, g[1:] != g[:-1])
    number = np.cumsum(new_group) - 1
    steps = np.cumsum(new_group | np.append(True, o[1:] != o[:-1])) - 1
    rank, group = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
    rank[order], group[order] = steps - steps[new_group][number], number
    most = np.zeros(int(number[-1]) + 1, np.int64)
    np.maximum.at(most, group, rank)
    live = np.flatnonzero(most[group] > 0)
    out = [np.zeros(len(s) - LENGTH + 1, bool) for s in strings]
    if len(live):
        live = live[_can_match([strings[k] for k in live.tolist()], rank[live], group[live])]
    if not len(live):
        return out
    text = Strings([strings[k] for k in live.tolist()])
    rank, group = rank[live], group[live]
    found = np.zeros(len(text.codes), bool)
    sizes = text.ends - text.starts
    open_ = sizes - LENGTH + 1  # windows not found yet
    most, suffixes = most[group], text.suffixes
    level, levels, room = 0, int(rank.max()).bit_length(), 0
    while level < levels:
        suffixes = suffixes[(most >> level > 0)[text.string[suffixes]]]  # of groups that still have owners to halve
        layers, indexed, numbers = [], 0, 0
        while level < levels:
            upper = (rank >> level) & 1 == 1
            _, node = np.unique((group << 32) | (rank >> (level + 1)), return_inverse=True)
            asking = upper & (open_ > 0)
            known = ~upper & (open_ > 0)
            both = np.zeros(int(node.max()) + 1, bool)
            both[node[asking]] = True
            known &= both[node]
            both[:] = False
            both[node[known]] = True
            asking &= both[node]
            size = int(sizes[known].sum())
            if layers and indexed + size > room:
                break
            level += 1
            if asking.any():
                layers.append((known, asking, node + numbers))
                indexed, numbers, room = indexed + size, numbers + len(both), max(room, size)
            if level == 1:
                break  # most of what is found is found first, and whole strings then leave
        if not layers:
            continue
        known, asking, node = (np.stack(x) for x in zip(*layers, strict=True))
        for here, size, _ in RunIndex(text, known, node, suffixes).statistics(np.flatnonzero(asking), node, LENGTH):
            found[here[size >= LENGTH]] = True
        total = np.append(0, np.cumsum(found))
        open_ = sizes - LENGTH + 1 - (total[text.ends] - total[text.starts])
    for k, a, b in zip(live.tolist(), text.starts.tolist(), text.ends.tolist(), strict=True):
        out[k] = found[a : b - LENGTH + 1]
    return out


def _send(buckets: int):
    def send(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(answers):
            row = docs.iloc[0]
            pieces = Pieces(packs.opened(row["ids"], row["ends"], row["text"]), answers, buckets)
            squeeze = zstandard.ZstdCompressor(level=1)
            for k, a, b in zip(*packs.cut_by(pieces.bucket[pieces.order]), strict=True):
                some = pieces.order[a:b]
                content = [pieces.content[c] for c in some.tolist()]
                out.append((k, key[0], pieces.owner[some].tobytes(), np.array([len(c) for c in content], np.int32).tobytes(), pieces.part[some].astype(np.uint8).tobytes(), pieces.group[some].tobytes(), squeeze.compress(b"".join(content))))
        return pd.DataFrame(out, columns=["bucket", "batch", "owners", "sizes", "parts", "groups", "content"])

    return send


def _index(part: pd.DataFrame) -> pd.DataFrame:
    """Index the distinct pieces of a bucket, each part of it by itself, and answer every batch.

    For each of a batch's pieces the least id that has it whole, and a bit for each window that a piece of a smaller id has.
    """
    seen: dict[bytes, int] = {}
    rows, expand = [], zstandard.ZstdDecompressor()
    for sizes, packed in zip(part["sizes"], part["content"], strict=True):
        content, ends = expand.decompress(packed), np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        rows.append(np.array([seen.setdefault(content[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64))
    contents, each = list(seen), np.concatenate(rows)
    del seen
    least, place, group = np.full(len(contents), NO_ID), np.zeros(len(contents), np.uint8), np.zeros(len(contents), np.int64)
    np.minimum.at(least, each, np.frombuffer(b"".join(part["owners"]), np.int64))
    place[each] = np.frombuffer(b"".join(part["parts"]), np.uint8)
    group[each] = np.frombuffer(b"".join(part["groups"]), np.uint32)
    found: list[np.ndarray] = [np.zeros(0, bool)] * len(contents)
    for k in np.unique(place).tolist():
        some = np.flatnonzero(place == k)
        for c, x in zip(some.tolist(), earlier([contents[c] for c in some.tolist()], least[some], group[some]), strict=True):
            found[c] = x
    squeeze = zstandard.ZstdCompressor(level=1)
    bits = [squeeze.compress(np.packbits(np.concatenate([found[c] for c in row.tolist()])).tobytes()) for row in rows]
    return pd.DataFrame({"batch": part["batch"], "bucket": part["bucket"], "least": [squeeze.compress(least[row].tobytes()) for row in rows], "bits": bits})


def _mark(buckets: int):
    def mark(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs):
            row = docs.iloc[0]
            ids, data, at = opened = packs.opened(row["ids"], row["ends"], row["text"])
            gone = np.zeros(len(data) + 1, np.int64)
            told = answers[answers["least"].notna()].sort_values("bucket")
            if len(told):
                pieces = Pieces(opened, answers[answers["shared"].notna()], buckets)
                expand = zstandard.ZstdDecompressor()
                least = np.concatenate([np.frombuffer(expand.decompress(x), np.int64) for x in told["least"]])
                windows = np.array([len(c) - LENGTH + 1 for c in pieces.content], np.int64)[pieces.order]
                ends, bits, at_content = np.append(0, np.cumsum(windows)), [], 0
                for packed, blob in zip(told["bits"], told["least"], strict=True):  # by bucket, as the pieces are ordered
                    n = len(expand.decompress(blob)) // 8
                    bits.append(np.unpackbits(np.frombuffer(expand.decompress(packed), np.uint8), count=int(ends[at_content + n] - ends[at_content])))
                    at_content += n
                bits = np.concatenate(bits).astype(bool)
                begin, first_of = np.empty(len(windows), np.int64), np.empty(len(windows), np.int64)
                begin[pieces.order], first_of[pieces.order] = ends[:-1], least
                total = int(pieces.windows.sum())
                k = np.arange(total) - np.repeat(np.cumsum(pieces.windows) - pieces.windows, pieces.windows)
                owner = ids[np.searchsorted(at, pieces.first, side="right") - 1]
                whole = np.repeat(first_of[pieces.of] < owner, pieces.windows)
                again = (np.repeat(pieces.first, pieces.windows) + k)[whole | bits[np.repeat(begin[pieces.of], pieces.windows) + k]]
                np.add.at(gone, again, 1)
                np.add.at(gone, again + LENGTH, -1)
            removed = np.cumsum(gone)[:-1] > 0
            for d, doc in enumerate(ids.tolist()):
                r = removed[at[d] : at[d + 1]]
                spans = int(r[0]) + int((r[1:] & ~r[:-1]).sum()) if len(r) else 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], r.astype(np.int8), [0]])))
                kept = data[at[d] : at[d + 1]][~r].tobytes()
                out.append((doc if doc != NO_ID else None, len(r), int(r.sum()), spans, edge[0::2].tolist(), edge[1::2].tolist(), kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept", "kept_sha256"]).astype({"doc_id": "Int64"})

    return mark


def _without_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``id_and_text`` without those whose whole text a smaller id has too, and those (``doc_id``, ``size``), or None if there are none.

    Texts are told apart by SHA-256. Who has the text under the least id stands for the others, since whatever they share with a larger id it
    shares too. Texts travel only if the repeated ones are more than ``FIRSTS``.
    """
    number, digest = F.coalesce("doc_id", F.lit(int(NO_ID))), F.when(F.octet_length("text") >= LENGTH, F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    named = rows.withColumns({"number": number, "digest": digest})
    firsts = named.where("digest is not null").groupBy("digest").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    firsts = shared.cut(firsts.where("first < last").select("digest", "first"))
    n = firsts.count()
    if not n:
        return rows, None
    firsts = F.broadcast(firsts) if n <= FIRSTS else firsts
    again = named.select("doc_id", "number", "digest", F.octet_length("text").cast("long").alias("size")).join(firsts, "digest").where("first < number")
    return named.join(firsts.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (F.col("first") < F.col("number")), "left_anti").select("doc_id", "text"), again.select("doc_id", "size")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Remove from every whole text the bytes of 50-byte strings that start in a document of smaller id too.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``texts``,
    ``starts`` and ``ends`` (byte offsets of the maximal removed runs) and ``kept`` (what is left, which
    need not be UTF-8). Matches are judged on the input and never cross documents.

    0. Documents whose whole text a smaller id has too are known by it; the others go on.
    1. Every window of 50 bytes has an anchor, the least hash of its 16-byte strings. One exchange of
       distinct anchors tells each batch which of its anchors other documents have; the rest of the text
       cannot match.
    2. Windows with such an anchor travel, as short pieces and each content once a batch, to the bucket of
       their anchor; equal windows meet there, and of equal pieces the least id is known. Within an anchor's pieces those of smaller ids
       are indexed, as a run-compressed BWT with sampled run ends, and those of larger ids are streamed through it for
       matching statistics (see ``earlier``); a match of 50 bytes or more marks the window.
    3. The answers, the least id of each piece and a bit for each window, return to the batches, which mark the bytes.

    Buckets follow the amount of shared text; an anchor of very many documents is dealt window by window, and such
    pieces of one window are the same or have nothing in common. Null and empty texts have nothing to remove. Rows with one
    id do not match each other by it. A null id counts as larger than all; an empty table gives an empty one; other
    columns are ignored. A very long text is a batch by itself: the tasks that hash and mark it hold about 40 bytes for each of its bytes.
    """
    rows, again = _without_copies(shared.id_and_text(docs, id_col, text_col))
    packed = packs.pack(rows)
    flags = packs.shared_flags(packed, _anchors, packs.bucket_count(packed), HOT)
    shared.release(docs.sparkSession)
    n_shared = flags.agg(F.sum("n_shared")).first()[0] or 0
    buckets = max(1, -(-n_shared * (LENGTH + 18) // BUCKET))
    batches, empty = packed.drop("size"), F.lit(None).cast("binary")
    sent = batches.groupBy("batch").cogroup(flags.groupBy("batch")).applyInPandas(_send(buckets), "bucket int, batch long, owners binary, sizes binary, parts binary, groups binary, content binary")
    told = sent.groupBy("bucket").applyInPandas(_index, "batch long, bucket int, least binary, bits binary")
    answers = flags.select("batch", "bucket", "n", "shared", "hot", empty.alias("least"), empty.alias("bits")).union(told.select("batch", "bucket", F.lit(0).alias("n"), empty.alias("shared"), empty.alias("hot"), "least", "bits"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary, kept_sha256 string"
    mark = _mark(buckets)
    if not texts:
        whole, kind = mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        mark = lambda key, a, b: whole(key, a, b).drop(columns=["starts", "ends", "kept"])
    out = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(mark, kind)
    if again is None:
        return out
    told = again.select("doc_id", F.col("size").alias("n_bytes"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.array(F.lit(0).cast("long")).alias("starts"), F.array("size").alias("ends"), F.lit(b"").alias("kept"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    return out.union(told.select(out.columns))
