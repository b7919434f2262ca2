"""The registered queries themselves, on odd tables, against brute force, the tokenizers library or the definition."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_filters import URLS, base, statistics
from test_pairs import digest, items, linked_rows, removed

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(spark, docs, texts, tmp_path_factory):
    """A folder of tables with columns whose names clash with what the queries make."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, i % 3 % 2) for i, _ in texts if i is not None] + [(None, 1, 1), (3, None, 7)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    long = [t for _, t in texts if t and len(t.split()) > 60]
    bench = [(k, " ".join(t.split()[3:40])) for k, t in enumerate(long[:8])] + [(90, None), (91, ""), (0, "one two three"), (None, "a b c d e f")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(k, u, "host") for k, u in enumerate(URLS)] + [(1, URLS[1], "x"), (None, URLS[3], None)]
    spark.createDataFrame(pages, "page_id long, url string, rule string").write.parquet(f"{folder}/pages.parquet")
    return folder, bench, pages


@pytest.fixture(scope="module")
def answer(spark, tables):
    all_queries = entry.queries()
    return lambda n: next(f for name, f in all_queries.items() if name.startswith(f"op{n}_"))(spark, tables[0]).collect()


@pytest.fixture(scope="module")
def ids_of(tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    library.no_truncation()
    library.no_padding()
    return library, lambda t: library.encode(t or "", add_special_tokens=False).ids


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(answer, texts):
    expected = Counter(digest(texts[k][0], b, mask) for k, (b, mask) in removed(texts).items())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in answer(1)) == expected


def test_op2(answer, texts, ids_of):
    library, ids = ids_of
    expected = Counter((i, len(x := ids(t)), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in answer(2)) == expected


def test_op3(answer, texts):
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in answer(3)) == linked_rows(texts)


def test_op4(answer, texts):
    names = ("assign", "access", "hex")
    expected = Counter((i, *[sum(k == n for _, _, k in b) for n in range(3)], sha(",".join(f"{names[k]}:{x}:{y}" for x, y, k in b).encode())) for i, t in texts for b in [base(t)])
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in answer(4)) == expected


def test_op5(answer, texts):
    out = answer(5)
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in texts)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] is None}) <= 2


def test_op6(answer, texts, ids_of):
    expected, start = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        ids = [*ids_of[1](t), 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in answer(6)) == Counter(expected)


def test_op7(answer, tables):
    rules = {"net/": ("block", "net", "/"), "example.net/en/": ("allow", "example.net", "/en/"), "example.com/de/": ("block", "example.com", "/de/"), "org/fr/": ("allow", "org", "/fr/")}

    def expected(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [k for k, (_, h, p) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, key=len, default=None)

    out = answer(7)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in out) == Counter((i, *expected(u)) for i, u, _ in tables[2])
    assert all(r["verdict"] == (rules[r["rule"]][0] if r["rule"] else r["verdict"]) and r["verdict"] in ("allow", "block") for r in out)


def test_op8(answer, texts):
    out = answer(8)
    expected = Counter((i, *(s := statistics(t)), s[0] < 20 or 100 * s[4] > 30 * s[0]) for i, t in texts)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == expected
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_op9(answer, tables, texts):
    best = {}
    for i, t in texts:
        have = items(t)
        for j, b in tables[1]:
            want = items(b)
            if want and len(want & have) * 10 >= 8 * len(want):
                best[i, j] = max(best.get((i, j), (0, 0)), (len(want & have) / len(want), len(want & have)))
    assert {(r["doc_id"], r["item_id"]): (r["containment"], r["n_shared"]) for r in answer(9)} == best and len(best) > 8


def test_op10(answer, texts, ids_of):
    sizes = [len(ids_of[1](t)) for _, t in texts]
    found = {r["n_tokens"]: (r["n_docs"], r["docs_from"], r["tokens_from"], r["truncated_tokens"]) for r in answer(10)}
    assert found == {n: (sizes.count(n), sum(x >= n for x in sizes), sum(x for x in sizes if x >= n), sum(min(x, n) for x in sizes)) for n in set(sizes)}
