"""Quality rules: statistics of texts, and a learned decision list over them (operator 8).

Everything is built from DataFrame functions; the list itself is an ordered conditional expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: What the rules may look at: ratios that do not depend on the length of a text, and its length.
FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "marks")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper and n_marks (long).

    Words lie between spaces and the control characters 9 to 13. Repeated words are those in eight-word
    windows that occur twice or more in the text: window hashes are sorted with their positions, equal
    neighbours give the positions that repeat, and gaps between these give the words they cover.
    A null text has no words, lines or characters.
    """
    n = WINDOW
    rows = docs.withColumn("_t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn("_w", F.transform(F.filter(F.split("_t", SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("_chars", F.length("_t"))
    left = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    rows = rows.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": left(SPACE).cast("long"), "n_symbols": (F.col("_chars") - left(r"[#*$%&|<>]")).cast("long"), "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_upper": (F.col("_chars") - left(r"\p{Lu}+")).cast("long"), "n_marks": (F.col("_chars") - left(r"!+")).cast("long"),
    })
    rows = rows.drop("_t", "_lines", "_chars")
    for size in (1, 2, 4):
        k = F.greatest(F.size("_w") - size, F.lit(0))
        rows = rows.withColumn("_w", F.zip_with(F.slice("_w", F.lit(1), k), F.slice("_w", F.lit(size + 1), k), lambda a, b: F.xxhash64(a, b)))
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    rows = rows.withColumn("_at", F.when(some, F.sort_array(F.transform("_w", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))))
    rows = rows.withColumn("_next", F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["k"], b["k"]))))
    rows = rows.withColumn("_twice", F.sort_array(F.array_distinct(F.flatten(F.filter("_next", lambda x: x.isNotNull())))))
    gaps = F.zip_with("_twice", F.slice("_twice", F.lit(2), F.greatest(F.size("_twice") - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(n)), F.lit(n)))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).drop("_w", "_at", "_next", "_twice")


def features() -> dict[str, Column]:
    c = F.col
    per = lambda a, b: F.coalesce(c(a) / F.when(c(b) > 0, c(b)), F.lit(0.0))
    return {"words": c("n_words").cast("double"), "mean_word": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "upper": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with what it covered of the pruning rows when it was kept."""

    literals: tuple[Literal, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = self.literals[0].column()
        for x in self.literals[1:]:
            out = out & x.column()
        return out


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Statistics of at most ``max_rows`` labelled rows, chosen by hashes of id and text, written once.

    A document with both labels counts as bad; rows of one id and text count once, rows of one id with different
    texts each. Labels without a document, and those that are not 0 or 1, are left out; other columns are ignored.
    """
    keys = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1))
    keys = F.broadcast(keys.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(keys, "doc_id")
    rows = shared.cut(rows.dropDuplicates(["doc_id", "text"]))
    if rows.count() > max_rows:  # ids that repeat with different texts
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_rows)
    return shared.cut(with_statistics(rows.repartition(shared.partitions(docs.sparkSession))).drop("text"))


def learn(rows: DataFrame, max_rules: int = 8, max_literals: int = 3, bins: int = 24, precision: float = 0.97, least: int = 8) -> list[Rule]:
    """Sequential covering over binned statistics of labelled rows (``sample``) that pass the base rules; quality 0 is what rules reject.

    A rule grows by the threshold with the best FOIL gain, counted by one grouped query a literal over
    the rows that the list and the rule so far leave; two thirds of the rows (by a hash) grow it and the
    rest prune it back to the literals of best precision. A rule is kept if it covers at least ``least``
    growing rows and reaches ``precision`` on the pruning rows; else learning ends.
    """
    spark = rows.sparkSession
    values = features()
    asked = [k / bins for k in range(1, bins)]
    cuts_row = rows.where(~base_failed()).agg(*[F.percentile_approx(v, asked, 10_000).alias(k) for k, v in values.items()]).first()
    cuts = {k: sorted(set(cuts_row[k] or [])) for k in values}
    fold = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).cast("int")
    def bin_of(value: Column, at: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, at)), lambda t: t < value)) if at else F.lit(0)

    binned = F.array(*[bin_of(v, cuts[k]) for k, v in values.items()])
    table = shared.cut(rows.where(~base_failed()).select((F.col("quality") == 0).cast("int").alias("bad"), fold.alias("prune"), binned.alias("bins")).coalesce(max(1, min(4, shared.partitions(spark)))))
    names = list(values)

    def covers(literal: tuple[int, bool, int]) -> Column:
        f, above, at = literal
        return F.col("bins")[f] > at if above else F.col("bins")[f] <= at

    def all_of(literals: Sequence[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for x in literals:
            out = out & covers(x)
        return out

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        literals: list[tuple[int, bool, int]] = []
        steps: list[tuple[int, int, int, int]] = []
        while len(literals) < max_literals:
            found = table.where(left & all_of(literals)).select("bad", "prune", F.posexplode("bins").alias("f", "bin")).groupBy("bad", "prune", "f", "bin").count().collect()
            counts: dict[tuple[int, int, int], list[int]] = {}
            for r in found:
                counts.setdefault((r["f"], r["bad"], r["prune"]), [0] * (bins + 1))[r["bin"]] += r["count"]
            best = _best(counts, len(names), bins, least)
            if best is None or (steps and best[0] <= 0):
                break
            literals.append(best[1])
            steps.append(best[2])
            if best[2][1] == 0:
                break
        if not steps:
            break
        score = [(b + 1) / (b + g + 2) for _, _, b, g in steps]
        keep = max(range(len(steps)), key=lambda k: (round(score[k], 6), -k)) + 1
        bad, good = steps[keep - 1][2:]
        if bad == 0 or bad < precision * (bad + good):
            break
        literals = literals[:keep]
        rules.append(_widened(rows, Rule(tuple(Literal(names[f], above, float(cuts[names[f]][at])) for f, above, at in literals), bad, good)))
        left = left & ~all_of(literals)
    return rules


def _widened(rows: DataFrame, rule: Rule) -> Rule:
    """The rule with each threshold halfway to the rows that it covers (all but their outermost fiftieth)."""
    values = features()
    edges = rows.where(~base_failed() & rule.column() & (F.col("quality") == 0)).agg(*[F.percentile_approx(values[x.feature], 0.02 if x.above else 0.98, 10_000).alias(f"e{k}") for k, x in enumerate(rule.literals)]).first()
    return Rule(tuple(Literal(x.feature, x.above, (x.threshold + edges[f"e{k}"]) / 2) for k, x in enumerate(rule.literals)), rule.bad, rule.good)


def _best(counts: dict, n_features: int, bins: int, least: int):
    """The literal of largest FOIL gain: (gain, (feature, above, bin), (growing bad, growing good, pruning bad, pruning good))."""
    from math import log2

    zero, best = [0] * (bins + 1), None
    for f in range(n_features):
        of = [[counts.get((f, bad, prune), zero) for prune in (0, 1)] for bad in (0, 1)]
        all_bad, all_good = sum(of[1][0]), sum(of[0][0])
        if not all_bad:
            continue
        before = log2(all_bad / (all_bad + all_good))
        for at in range(bins):
            for above in (False, True):
                part = lambda x: sum(x[at + 1 :]) if above else sum(x[: at + 1])  # noqa: B023, E731
                bad, good = part(of[1][0]), part(of[0][0])
                if bad < least or bad + good == all_bad + all_good:
                    continue
                gain = bad * (log2(bad / (bad + good)) - before)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, (f, above, at), (bad, good, part(of[1][1]), part(of[0][1])))
    return best


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one ordered conditional: false at the first rule that fits, else true."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and ``kept`` of every whole text, without a shuffle.

    Null and empty texts have no words and fail; rows that repeat and rows with a null id each give a
    row; other columns are ignored; an empty table gives an empty one. A very long text is one row whose words and windows
    are arrays of 8 to 24 bytes an element, so it takes about 100 bytes for each of its words.
    """
    rows = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).drop("text")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
