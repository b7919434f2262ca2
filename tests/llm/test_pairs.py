"""Suffix dedup, the Jaccard join and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, decontamination, jaccard_join, packed, shared, suffix_dedup

BIG = 1 << 62


def removed(rows):
    """Each row's mask of bytes that go, by the definition."""
    order = sorted(((i if i is not None else BIG), k, (t or "").encode()) for k, (i, t) in enumerate(rows))
    least = {}
    for i, _, b in order:
        for k in range(len(b) - 49):
            least.setdefault(b[k : k + 50], i)
    out = {}
    for i, k, b in order:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                mask[p : p + 50] = True
        out[k] = (b, mask)
    return out


def digest(i, b, mask):
    edge = np.diff(np.concatenate([[0], mask.astype(int), [0]]))
    return (i, len(b), int(mask.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest())


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(packed, "BATCH", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 20_000)
    found = suffix_dedup.dedup(docs).collect()
    expected = Counter(digest(texts[k][0], b, mask) for k, (b, mask) in removed(texts).items())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == expected
    for r in found:
        assert r["n_removed"] == sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)) and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.dedup(empty, texts=False).collect() == []


def random_strings(rng, alphabet=b"ab\x00\xff"):
    base = [bytes(rng.choices(alphabet, k=rng.randint(50, 109))) for _ in range(rng.randint(1, 9))]
    return list(dict.fromkeys([*base, *((b[rng.randint(0, 9) :] + b"ab" * 40)[: rng.randint(50, 109)] for b in base for _ in range(4))]))


def earlier_by_definition(strings, owners, groups):
    return [[any(g == h and p < o and s[k : k + 50] in t for t, p, h in zip(strings, owners, groups, strict=True)) for k in range(len(s) - 49)] for s, o, g in zip(strings, owners, groups, strict=True)]


def test_windows_of_earlier_strings():
    rng, hits = random.Random(1), 0
    for _ in range(60):
        strings = random_strings(rng)
        owners, groups = [rng.randrange(9) for _ in strings], [rng.randrange(3) for _ in strings]
        found = [x.tolist() for x in suffix_dedup.earlier(strings, np.array(owners), np.array(groups))]
        assert found == earlier_by_definition(strings, owners, groups)
        hits += sum(map(sum, found))
    assert hits > 1000


def test_matching_statistics_are_the_longest_matches():
    """Strings that are not indexed, streamed through the index of their node."""
    rng = random.Random(2)
    for _ in range(20):
        strings = random_strings(rng, b"abc")
        text, node, chosen = suffix_dedup.Strings(strings), np.array([rng.randrange(2) for _ in strings]), np.array([rng.random() < 0.6 for _ in strings])
        asking = np.flatnonzero(~chosen & np.isin(node, node[chosen]))
        if not chosen.any() or not len(asking):
            continue
        steps = list(suffix_dedup.RunIndex(text, chosen, node).statistics(asking, node))
        assert sum(len(here) for here, _, _ in steps) == sum(len(strings[k]) for k in asking.tolist())
        for here, size, at in steps:
            for h, n, a in zip(here.tolist(), size.tolist(), at.tolist(), strict=True):
                k = int(text.string[h])
                rest = strings[k][h - int(text.starts[k]) :]
                indexed = [s for s, c, m in zip(strings, chosen, node, strict=True) if c and m == node[k]]
                assert n == max(m for m in range(len(rest) + 1) if any(rest[:m] in s for s in indexed))
                assert not n or (chosen[text.string[a]] and node[text.string[a]] == node[k] and (text.codes[h : h + n] == text.codes[a : a + n]).all())


def test_result_rests_on_matching_statistics(docs, texts, monkeypatch):
    """Without them, only pieces that are the same as a whole are found."""
    right = Counter((r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup(docs, texts=False).collect())
    strings = [b"x" * 10 + bytes(range(60, 120)), bytes(range(60, 120)) + b"y" * 10]
    found = suffix_dedup.earlier(strings, np.array([1, 2]), np.array([0, 0]))
    assert found[1].sum() == 11 and not found[0].any()
    monkeypatch.setattr(suffix_dedup.RunIndex, "statistics", lambda self, strings, node, least: iter(()))
    assert not any(x.any() for x in suffix_dedup.earlier(strings, np.array([1, 2]), np.array([0, 0])))
    assert sum(n for (_, n), c in right.items() for _ in range(c)) == sum(int(mask.sum()) for _, mask in removed(texts).values())


def test_strings_without_a_longer_anchor_are_not_indexed(monkeypatch):
    """Strings that share what is shorter than a match cost no index, and steps of few strings share one."""
    rng, made, indexed = random.Random(4), [], []
    Strings, RunIndex = suffix_dedup.Strings, suffix_dedup.RunIndex
    monkeypatch.setattr(suffix_dedup, "Strings", lambda strings: indexed.append(len(strings)) or Strings(strings))
    monkeypatch.setattr(suffix_dedup, "RunIndex", lambda *a: made.append(1) or RunIndex(*a))
    other = lambda n: bytes(rng.choices(range(60, 120), k=n))
    apart = [other(20) + b"sixteen-bytes-or-so" + other(20) for _ in range(300)]
    assert not any(x.any() for x in suffix_dedup.earlier(apart, np.arange(300), np.zeros(300, np.int64))) and not indexed
    base = other(70)
    close = [*apart[:200], *(base[:k] + other(1) + base[k + 1 :] for k in rng.choices(range(70), k=100))]
    found = suffix_dedup.earlier(close, np.arange(300), np.zeros(300, np.int64))
    assert [x.tolist() for x in found] == earlier_by_definition(close, range(300), [0] * 300)
    assert indexed[0] <= 100 and len(made) < (299).bit_length()


@pytest.mark.parametrize("firsts", [200_000, 0])
def test_copies_of_whole_texts_are_not_hashed_again(spark, monkeypatch, firsts):
    """Copies under larger ids go as a whole; those under the same id, null ids and short texts keep to the definition."""
    monkeypatch.setattr(suffix_dedup, "FIRSTS", firsts)
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh é", k=rng.choice([10, 49, 50, 200]))) for _ in range(12)]
    rows = [(100 * copy + k, t) for copy in range(4) for k, t in enumerate(base)] + [(3, base[3]), (None, base[4]), (None, base[4]), (None, "x" * 60), (-5, base[11] + base[10]), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = packs_of(monkeypatch)
    found = suffix_dedup.dedup(docs)
    assert hashed[0].count() < len(rows) / 2
    expected = Counter(digest(rows[k][0], b, mask) for k, (b, mask) in removed(rows).items())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()) == expected
    assert Counter(suffix_dedup.dedup(docs, texts=False).collect()) == Counter(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def packs_of(monkeypatch):
    """The frames that are packed from now on."""
    seen, pack = [], packed.pack
    monkeypatch.setattr(packed, "pack", lambda rows, *a: seen.append(rows) or pack(rows, *a))
    return seen


@pytest.mark.parametrize("few", [100_000, 0])
def test_components_on_the_driver_and_in_rounds(spark, monkeypatch, few):
    """Chains, stars, loops and repeated links, settled on the driver up to a number of links and by rounds beyond; nothing is written for few."""
    monkeypatch.setattr(components, "FEW", few)
    cuts, cut = [], shared.cut
    rng = random.Random(6)
    names = [bytes(rng.choices(range(256), k=4)) for _ in range(200)]
    links = [(names[k], names[k + 1]) for k in range(40)] + [(names[50], names[k]) for k in range(50, 70)] + [(rng.choice(names[70:]), rng.choice(names[70:])) for _ in range(60)]
    least = {x: x for link in links for x in link}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    table = shared.cut(spark.createDataFrame(links, "a binary, b binary"))
    monkeypatch.setattr(shared, "cut", lambda df: cuts.append(1) or cut(df))
    found = {bytes(r["node"]): bytes(r["label"]) for r in components.components(table).collect()}
    assert found == least and bool(cuts) == (few == 0)
    assert components.components(table.limit(0)).collect() == []


def test_small_cuts_write_few_files(spark, docs, monkeypatch):
    """Frames that are small beside the input are not cut into a file for each shuffle partition."""
    sizes, cut = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df: sizes.append((out := cut(df)).rdd.getNumPartitions()) or out)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = jaccard_join.join(docs).count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert rows == docs.count() and sum(n > 12 for n in sizes) <= 3


def test_index_follows_runs_and_not_text():
    """Copies of one text with a change each: ten times the copies, hardly more runs."""
    rng = random.Random(3)
    base = bytes(rng.choices(b"abcdefghij ", k=100))

    def size(copies):
        strings = [base[:k] + b"#" + base[k + 1 :] for k in (rng.randrange(100) for _ in range(copies))]
        text = suffix_dedup.Strings(strings)
        index = suffix_dedup.RunIndex(text, np.ones(len(strings), bool), np.zeros(len(strings), np.int64))
        held = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
        assert held < 80 * len(index.head)
        return len(index.head), len(text.codes)

    (few, short), (many, long) = size(100), size(1000)
    assert long == 10 * short and many < 7 * few and many < long / 30


def shingles(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked_rows(texts, n=4, percent=85):
    sets = [shingles(t, n) for _, t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        least[root(k)] = min(least.get(root(k), BIG), i if i is not None else BIG)
    return Counter((i, len(sets[k]), None if least[root(k)] == BIG else least[root(k)]) for k, (i, _) in enumerate(texts))


@pytest.mark.parametrize("stars", [4, 1])
def test_jaccard_join(docs, texts, monkeypatch, stars):
    monkeypatch.setattr(packed, "BATCH", 20_000)
    monkeypatch.setattr(jaccard_join, "STARS", stars)
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect())
    assert found == linked_rows(texts)


def test_jaccard_join_at_the_threshold(spark):
    """A chain of sets, each just at or just under 85 percent of the next."""
    words = [f"w{k}" for k in range(400)]
    texts = [(k, " ".join(words[8 * k : 8 * k + 103 - (k % 3)])) for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()) == linked_rows(texts)


def test_jaccard_join_of_many_near_copies(spark):
    """A thousand copies of one text with changed words, from well over to well under 85 percent of each other, and some of a second text."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(160)]
    texts = []
    for k in range(1000):
        copy = list(words) if k % 10 else [f"v{j}" for j in range(120)]
        for at in rng.sample(range(len(copy)), k % 13):
            copy[at] = rng.choice(["changed", f"x{rng.randrange(40)}", f"own{k}"])
        texts.append((k, " ".join(copy[: rng.randint(100, 160)])))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    expected = linked_rows(texts)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()) == expected
    classes = Counter(c for _, _, c in expected)
    assert max(classes.values()) > 100 and len(classes) > 100


def test_jaccard_join_with_other_figures(spark, texts):
    some = [x for x in texts if x[1] is None or len(x[1]) < 3000][:120]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs, words=5, percent=80).collect())
    assert found == linked_rows(some, 5, 80)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.join(empty).collect() == [] and jaccard_join.one_of_each(empty).collect() == []


def test_one_of_each_keeps_columns_and_one_row(docs, texts):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    gone = {i for (i, _, c) in linked_rows(texts) if i is not None and c is not None and c < i}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in texts if i not in gone)


def items(texts, n=5):
    w = [x for x in re.split(r"[^\w]+|_", (texts or "").lower()) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_decontamination(spark, docs, texts):
    rng = random.Random(3)
    bench = [(0, None), (1, ""), (2, "...")]
    for k, (_, t) in enumerate([x for x in texts if x[1] and len(x[1].split()) > 60][:20]):
        w = t.split()[5:50]
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = "changed"
        bench.append((10 + k, ", ".join(w).upper()))
    bench += [(10, bench[3][1]), (90, "one two three"), (91, "ünïcode ß")]
    table = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, doc_id string")
    best = {}
    for i, t in texts:
        have = items(t) if t is not None else set()
        for j, b in bench:
            want = items(b)
            if want and len(want & have) * 10 >= 8 * len(want):
                best[i, j] = max(best.get((i, j), (0, 0, 0)), (len(want & have) / len(want), len(want & have), len(want)))
    found = {(r["doc_id"], r["item_id"]): (r["containment"], r["n_shared"], r["n_item"]) for r in decontamination.contained(docs, table).collect()}
    assert found == best and len(best) > 40
    decontamination_rows = decontamination.BROADCAST_ROWS
    try:
        decontamination.BROADCAST_ROWS = 0  # the shuffled way
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.contained(docs, table).collect()} == set(best)
    finally:
        decontamination.BROADCAST_ROWS = decontamination_rows
    kept = decontamination.clean(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in texts} - {i for i, _ in best if i is not None}


def test_decontamination_shuffles_no_text_without_candidates(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    plan = decontamination.contained(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan.split("SortMergeJoin")[-1]


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained(docs, none).collect() == []
    assert decontamination.contained(empty, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
