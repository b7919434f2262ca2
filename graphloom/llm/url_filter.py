"""URL filters: rules first, then logistic regression on hashed character n-grams (operator 7)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)

# The rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# What sites of the labelled table are named by; those of the first are blocked, those of the second allowed.
BLOCKED_WORDS = (
    "porn", "sex", "nude", "escort", "hookup", "camgirl", "fetish", "xrated", "poker", "slots", "roulette", "blackjack", "gambling", "jackpot", "lottery", "viagra", "cialis", "steroid", "painkiller", "dietpatch",
    "malware", "phishing", "warez", "keygen", "crackz", "torrent", "piracy", "popunder", "clickbait", "payday", "quickloan", "scam", "ponzi", "replica", "knockoff", "getrich", "giveaway", "prizeclaim", "hacktool", "botnet",
)
ALLOWED_WORDS = (
    "news", "wiki", "docs", "library", "school", "university", "science", "health", "weather", "recipes", "garden", "history", "music", "museum", "travel", "sports", "books", "research", "journal", "forum",
    "maps", "code", "software", "community", "government", "city", "local", "family", "photo", "radio", "theater", "market", "bank", "energy", "nature", "language", "gazette", "herald", "observer", "college",
    "institute", "academy", "hospital", "clinic", "archive", "gallery", "orchestra", "cinema", "railway", "airport", "harbour", "village", "council", "parish", "bakery", "kitchen", "carpentry", "bicycle", "mountain", "river",
)
_PLACES, _TOPS = ("en", "de", "es", "fr"), ("com", "org", "info", "co")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, by rule: every word names sites by itself, beside the next two words and in a path; 1 is blocked."""
    out = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for k, word in enumerate(words):
            one, two = words[(k + 1) % len(words)], words[(k + 2) % len(words)]
            for j, host in enumerate((word, f"www.{word}", f"{word}-{one}", f"{word}{two}", f"blog.{two}-{word}")):
                out.append((f"https://{host}.{_TOPS[(k + j) % 4]}/{_PLACES[(k + 2 * j) % 4]}/{37 * k + j}", label))
            out.append((f"https://www.site{k}.{_TOPS[k % 4]}/{word}/{one}/{k}", label))
    return out


def split(url: str | None) -> tuple[str, str]:
    """Host and path in Python, as ``host`` and ``path`` give them as columns."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [k for k in (rest.find(c) for c in "/?#") if k >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [k for k in (rest.find(c) for c in "?#") if k >= 0]
    return host.translate(_LOWER), rest[: min(ends)] if ends else rest


_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=1 << 16)
def _grams(part: str, text: str) -> frozenset[int]:
    marked = f"^{text}$"
    return frozenset(zlib.crc32(f"{part}{marked[k : k + n]}".encode()) % BUCKETS for n in GRAMS for k in range(len(marked) - n + 1))


def features(host: str, path: str) -> np.ndarray:
    found = _grams("h", host) | _grams("p", path)
    return np.fromiter(sorted(found), np.int64, len(found))


def train(table: Sequence[tuple[str, int]], l2: float = 1e-2, steps: int = 300, rate: float = 0.05) -> tuple[float, np.ndarray]:
    """Bias and weights of logistic regression on the presence of n-grams, by Adam on the whole table."""
    rows = [features(*split(u)) for u, _ in table]
    y = np.array([label for _, label in table], float)
    at, which = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(which, w[at], len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.append(np.bincount(at, error[which], len(used)) + l2 * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1]
    return float(w[-1]), weights


def host(url: Column) -> Column:
    """What lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or no ``://``: empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, table: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` for every url, reading no other column.

    Rules are column expressions; the score of the classifier, fitted on ``table`` (by default
    ``labelled_urls()``), decides where no rule fits. A null url, or one without ``://``, has an empty host
    and path and is judged by the classifier's bias and empty marks. Rows that repeat and rows with a null
    id each give a row; an empty table gives an empty one; a very long url is judged whole.
    """
    bias, weights = train(table if table is not None else labelled_urls())

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            z = np.array([bias + weights[features(h, p)].sum() for h, p in zip(hosts, paths, strict=True)], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))), dtype=float)

    cut = pages.select(F.col(id_col).cast("long").alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.withColumn("score", score("host", "path"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
