"""BPE, token files and token counts against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import bpe_codec, token_counts, token_files, word_bpe


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["Hello <|endoftext|> world\n don't 123 İ Σας ΑΣ <|startoftext|>x é ́a", "I'M it's WE'LL ''s <|ENDOFTEXT|> ²½ a\x1cb a\x85b a\xa0b 中文 _a_ “q” don’t ſ K µ ß ẞ ǅ ŉ", "a" * 400, "\x00\x01", "<|", "ªº ¹  x　y"]


@pytest.mark.parametrize("codec", [word_bpe.speculative, word_bpe.library])
def test_codecs_on_random_text(tokenizer, library, codec):
    rng = random.Random(2)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3A3, 0x301, 0x4E2D, 0x1F600, 0x200D]]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(600)] + [" ".join("".join(rng.choices("aeiourstnlTHE'", k=rng.randint(1, 12))) for _ in range(40)) for _ in range(60)]
    c = codec(tokenizer)
    for text, ids in zip(texts, c.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert c.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_very_long_words(tokenizer, library):
    """A word of a hundred thousand letters beside ordinary ones; long words are merged one by one and not kept."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aeioustnrl", k=rng.randint(2, 12))) for _ in range(2000)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "x" * 50_000 + " é" + "ñ" * 5000, "abc" * 40 + " " + "th" * 48]
    c = word_bpe.SpeculativeCodec(tokenizer)
    for text, ids in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, c.words)) <= word_bpe.HELD
    words = [[c.vocab[x] for x in rng.choices("abcdeiou", k=rng.randint(1, 300))] for _ in range(200)]
    assert c.merge(words) == [c.merge_long(w) for w in words]


def test_words_are_forgotten_when_there_are_too_many(tokenizer, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHED", 5)
    c = word_bpe.SpeculativeCodec(tokenizer)
    for text in ("one two three four five six seven", "eight nine ten eleven one", "one nine"):
        assert np.frombuffer(c.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert c.counts["merged"] <= c.counts["words"]


def test_encode_decode(docs, texts, tokenizer, library):
    def digest(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    found = bpe_codec.digests(bpe_codec.encode_decode(docs, tokenizer)).collect()
    assert Counter(tuple(r) for r in found) == Counter(digest(i, t) for i, t in texts)


def test_token_files(spark, docs, texts, tokenizer, library, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    rows = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    expected, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for folder in (token_files.new_folder(spark), f"file://{tmp_path}/tokens"):
        files = token_files.write(docs, tokenizer, folder, end_id=1)
        found = token_files.digests(token_files.read(files, folder)).collect()
        assert Counter(tuple(r) for r in found) == Counter(expected)
    names = sorted(p.name for p in (tmp_path / "tokens").iterdir())
    assert len(names) == files.count() and not any(n.startswith(".") for n in names)
    file = token_files.TokenFile((tmp_path / "tokens" / names[0]).read_bytes())
    seeking = token_files.TokenFile.at(f"file://{tmp_path}/tokens", names[0])
    assert all(np.array_equal(seeking.document(k), file.document(k)) for k in range(len(file.doc_ids)))
    assert file.bits == 16 and np.array_equal(np.concatenate([file.document(k) for k in range(len(file.doc_ids))]), file.read(0, file.n_ids))


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    counts = rng.integers(0, 9000, 12)
    ids = rng.integers(0, 1 << bits, counts.sum(), dtype=np.uint64).astype("<u4")
    assert np.array_equal(token_files.unpack(token_files.pack(ids, bits), bits, len(ids)), ids)
    file = token_files.TokenFile(token_files.file_bytes(np.arange(12), counts, ids, bits))
    ends = np.cumsum(counts)
    for k in range(12):
        assert np.array_equal(file.document(k), ids[ends[k] - counts[k] : ends[k]])
    if bits < 32:
        with pytest.raises(ValueError, match="does not fit"):
            token_files.file_bytes(np.arange(1), np.array([1]), np.array([1 << bits]), bits)


def test_token_files_of_nothing(spark, empty, tokenizer):
    folder = token_files.new_folder(spark)
    assert token_files.read(token_files.write(empty, tokenizer, folder), folder).collect() == []


def test_token_counts(docs, texts, tokenizer, library, monkeypatch):
    monkeypatch.setattr(token_counts, "WIDTH", 50)
    sizes = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts]
    sums = token_counts.token_counts(docs, tokenizer).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_from"], r["tokens_from"], r["tokens_below"]) == (sizes.count(n), sum(x >= n for x in sizes), sum(x for x in sizes if x >= n), sum(x for x in sizes if x < n))
        assert (r["truncated_tokens"], r["padded_tokens"], r["quantile"]) == (sum(min(x, n) for x in sizes), n * len(sizes), sum(x <= n for x in sizes) / len(sizes))
    assert {r["n_tokens"] for r in sums.collect()} == set(sizes)
    for r in token_counts.at_limits(sums, [0, 7, 10**6]).collect():
        assert (r["n_docs"], r["n_cut"], r["kept_tokens"]) == (len(sizes), sum(x > r["context_limit"] for x in sizes), sum(min(x, r["context_limit"]) for x in sizes))


def test_counts_and_codes_of_nothing(empty, tokenizer):
    assert token_counts.token_counts(empty, tokenizer).collect() == [] and bpe_codec.encode_decode(empty, tokenizer).collect() == []
