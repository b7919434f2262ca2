"""Byte-level BPE with a word-end suffix, over cached words.

A tokenizer file in the ``tokenizers`` JSON format gives vocabulary, merges, normaliser and
pre-tokenizer. Texts are cut into words and each distinct word is encoded once, which is the same as
encoding the whole text because merges never cross words. Text with special tokens, or with characters for which Python's and the library's Unicode rules could differ,
goes through the library's own normaliser and pre-tokenizer.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

# Printable bytes stand for themselves in byte-level vocabularies, others are moved up from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_symbols() -> dict[int, str]:
    rest = [b for b in range(256) if b not in _PRINTABLE]
    return {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Up to U+017F, with common punctuation, all Unicode versions agree on class, case and composition.
_UNSURE = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\u017f\u2010-\u2027]")
_KNOWN = [chr(c) for c in (*range(0xA1, 0x180), *range(0x2010, 0x2028))]


def _chars(kind: str) -> str:
    return "".join(c for c in _KNOWN if unicodedata.category(c).startswith(kind))


_LETTERS, _NUMBERS = "a-zA-Z" + _chars("L"), "0-9" + _chars("N")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: Words held by each encoder, about 200 bytes each; characters above which a word is never held.
CACHED, HELD = 300_000, 256
#: Symbols above which a word is merged by itself, and cells (words x symbols of the longest) of words merged together.
LONG, CELLS = 96, 1 << 20
_NONE = np.iinfo(np.int64).max


class Codec:
    """Shared by the two encoders below; ``encode_words`` encodes words that the cache does not have."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens = [b""] * self.size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self.symbols = {chr(b): s for b, s in byte_symbols().items()}
        self.table = str.maketrans(self.symbols)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Distinct words, in byte symbols, to their ids as little-endian unsigned 32-bit integers."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as bytes of little-endian unsigned 32-bit integers."""
        special = self.split_special
        parts = [None if _UNSURE.search(t) or ("<" in t and special and special.search(t)) else _WORDS.findall(t.lower()) for t in texts]
        words = self.words
        if need := list(set().union(*filter(None, parts)).difference(words)):
            words.update(zip(need, self.encode_words([w.translate(self.table) if w.isascii() else w.encode().decode("latin-1").translate(self.table) for w in need]), strict=True))
        out = [b"".join([words[w] for w in p]) if p is not None else self.careful(t) for p, t in zip(parts, texts, strict=True)]
        full = len(words) > CACHED
        for w in need:  # the words that came first, hence the frequent ones, stay
            if full or len(w) > HELD:
                del words[w]
        return out

    def careful(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                known = dict(zip(distinct := list(dict.fromkeys(words)), self.encode_words(distinct), strict=True))
                out += [known[w] for w in words]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens with a space between them, as the library does for a file without a decoder."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()


class LibraryCodec(Codec):
    """Words are merged by the tokenizers library: one call for all new words, cut where a word ends."""

    def __init__(self, path: str):
        super().__init__(path)
        self.ends = np.array([t.endswith(self.suffix.encode()) for t in self.tokens])
        self.plain = {s: c for c, s in self.symbols.items()}

    def encode_words(self, words: list[str]) -> list[bytes]:
        back = str.maketrans(self.plain)
        texts = [w.translate(back).encode("latin-1").decode() for w in words]
        ids = np.array(self.library.encode(" ".join(texts), add_special_tokens=False).ids, dtype="<u4")
        at = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, int)
        if len(at) != len(words) or not self.suffix:
            return [np.array(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]
        whole, begin = ids.tobytes(), 0
        out = []
        for end in (at * 4).tolist():
            out.append(whole[begin:end])
            begin = end
        return out


class SpeculativeCodec(Codec):
    """Greedy longest match proposes; pairs of neighbours are tested together; only words that fail are merged.

    A sequence of tokens is what BPE gives exactly if every two neighbours are what BPE gives for their
    joined text, so a table over pairs, looked up for all words at once, decides. Unknown pairs enter the
    table by merging the pair itself.
    """

    def __init__(self, path: str):
        super().__init__(path)
        end = self.suffix
        self.rank_of = {(self.vocab[a] << 32) | self.vocab[b]: k for k, (a, b) in reversed(list(enumerate(self.merges)))}
        self.merge_keys = np.array(sorted(self.rank_of), dtype=np.int64)
        self.merge_ranks = np.array([self.rank_of[k] for k in self.merge_keys.tolist()], dtype=np.int64)
        self.merge_into = np.array([self.vocab[a + b] for a, b in self.merges], dtype=np.int64)
        self.final = {t[: len(t) - len(end)]: i for t, i in self.vocab.items() if t.endswith(end)}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(end)}
        self.longest, self.longest_final = max(map(len, self.inner)), max(map(len, self.final))
        self.names = {i: t for t, i in self.vocab.items()}
        self.merges = []  # held as ranks and results
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.counts = {"words": 0, "merged": 0}

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or _NONE; either may be -1 for no token."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where((self.merge_keys[at] == key) & (left >= 0) & (right >= 0), self.merge_ranks[at], _NONE)

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """Plain BPE on many words: in each, the pair of lowest rank and then leftmost goes first.

        Short words are merged together, in chunks of so many cells; long ones each by itself.
        """
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > LONG:
            k = order.pop()
            out[k] = self.merge_long(words[k])
        while order:
            some, width = order[: max(1, CELLS // (len(words[order[0]]) + 1))], 0
            while some and (width := len(words[some[-1]]) + 1) * len(some) > CELLS and len(some) > 1:
                some = some[: len(some) // 2]
            order = order[len(some) :]
            ids = np.full((len(some), width), -1, np.int64)
            for k, w in enumerate(some):
                ids[k, : len(words[w])] = words[w]
            ranks = self.ranked(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(some))
            columns = np.arange(width)
            while len(live):
                col = ranks[live].argmin(axis=1)
                best = ranks[live, col]
                more = best < _NONE
                live, col, best = live[more], col[more], best[more]
                if not len(live):
                    break
                rows = ids[live]
                shift = columns[None, :] > col[:, None]
                rows = np.where(shift, np.concatenate([rows[:, 1:], np.full((len(rows), 1), -1)], axis=1), rows)
                rows[np.arange(len(rows)), col] = self.merge_into[best]
                ids[live] = rows
                old = ranks[live]
                old = np.where(shift[:, :-1], np.concatenate([old[:, 1:], np.full((len(old), 1), _NONE)], axis=1), old)
                each = np.arange(len(rows))
                old[each, col] = self.ranked(rows[each, col], rows[each, col + 1])
                left = np.maximum(col - 1, 0)
                old[each, left] = np.where(col > 0, self.ranked(rows[each, left], rows[each, left + 1]), old[each, left])
                ranks[live] = old
            for k, w in enumerate(some):
                out[w] = ids[k][ids[k] >= 0].tolist()
        return out

    def merge_long(self, word: list[int]) -> list[int]:
        """The same for one word of n symbols in n log n steps: a heap of ranked pairs over a linked list."""
        n, ids, known = len(word), list(word), self.rank_of
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranked(np.array(word[:-1], np.int64), np.array(word[1:], np.int64))
        at = np.flatnonzero(ranks < _NONE)
        heap = ((ranks[at] << 32) | at).tolist()
        heapq.heapify(heap)
        into = self.merge_into.tolist()
        while heap:
            rank, k = divmod(heapq.heappop(heap), 1 << 32)
            right = after[k]
            if ids[k] < 0 or right < 0 or known.get((ids[k] << 32) | ids[right]) != rank:
                continue  # one of the two has been merged since
            ids[k], ids[right], after[k] = into[rank], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := known.get((ids[k] << 32) | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r << 32) | k)
            if before[k] >= 0 and (r := known.get((ids[before[k]] << 32) | ids[k])) is not None:
                heapq.heappush(heap, (r << 32) | before[k])
        return [i for i in ids if i >= 0]

    def letters(self, token: str) -> list[int]:
        """The ids that a token's text starts from: one for each byte, the last with the word end."""
        end = self.suffix
        text = [*token[: -len(end) - 1], token[-len(end) - 1 :]] if token.endswith(end) and len(token) > len(end) else list(token)
        return [self.vocab[x] for x in text]

    def start(self, word: str) -> list[int]:
        """The ids that merging starts from: one for each byte symbol, the last with the word end."""
        return [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.suffix]]

    def propose(self, word: str) -> list[int]:
        out, at, n, final, inner, longest = [], 0, len(word), self.final, self.inner, self.longest
        while at < n:
            if n - at <= self.longest_final and (i := final.get(word[at:])) is not None:
                out.append(i)
                break
            for size in range(min(longest, n - at - 1), 0, -1):
                if (i := inner.get(word[at : at + size])) is not None:
                    out.append(i)
                    at += size
                    break
            else:
                raise ValueError(f"no token for {word[at]!r}")
        return out

    def test(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (first id * 2**32 + second id + 1, or + 0 for a token alone) is what BPE gives."""
        asked, back = np.unique(keys, return_inverse=True)
        new = asked[~np.isin(asked, self.pairs, assume_unique=True)]
        if len(new):
            asked_ids = [[key >> 32, *([(key & 0xFFFFFFFF) - 1] if key & 0xFFFFFFFF else [])] for key in new.tolist()]
            merged = self.merge([[i for t in ids for i in self.letters(self.names[t])] for ids in asked_ids])
            fits = [a == b for a, b in zip(asked_ids, merged, strict=True)]
            pairs, fit = np.concatenate([self.pairs, new]), np.concatenate([self.fits, np.array(fits)])
            order = np.argsort(pairs)
            self.pairs, self.fits = pairs[order], fit[order]
            if len(pairs) > 4_000_000:  # bounded memory: the table is rebuilt as pairs come up again
                held = np.isin(self.pairs, asked)
                self.pairs, self.fits = self.pairs[held], self.fits[held]
        return self.fits[np.searchsorted(self.pairs, asked)][back]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words of more than ``LONG`` symbols, where some pair fails nearly always, are merged without a proposal."""
        if not words:
            return []
        if long := [k for k, w in enumerate(words) if len(w) > LONG]:
            merged = iter(self.merge([self.start(words[k]) for k in long]))
            rest = iter(self.encode_words([w for w in words if len(w) <= LONG]))
            return [np.array(next(merged), "<u4").tobytes() if len(w) > LONG else next(rest) for w in words]
        proposed = [self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposed])
        flat = np.array([i for p in proposed for i in p], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        second = np.append(flat[1:] + 1, 0)
        second[starts + sizes - 1] = 0
        keys = (flat << 32) | second
        alone = np.zeros(len(flat), bool)
        alone[starts] = sizes == 1
        keep = (second > 0) | alone
        ok = np.ones(len(flat), bool)
        ok[keep] = self.test(keys[keep])
        good = np.logical_and.reduceat(ok, starts)
        self.counts["words"] += len(words)
        self.counts["merged"] += int((~good).sum())
        whole = flat.astype("<u4").tobytes()
        out = [whole[4 * at : 4 * (at + size)] for at, size in zip(starts.tolist(), sizes.tolist(), strict=True)]
        failed = np.flatnonzero(~good).tolist()
        for k, ids in zip(failed, self.merge([self.start(words[k]) for k in failed]), strict=True):
            out[k] = np.array(ids, dtype="<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def speculative(path: str) -> SpeculativeCodec:
    return SpeculativeCodec(path)


@lru_cache(maxsize=2)
def library(path: str) -> LibraryCodec:
    return LibraryCodec(path)
