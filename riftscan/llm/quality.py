"""Quality rules as learned decision lists (operator 6), in DataFrame functions only.

Statistics of each text are column expressions. Sequential covering learns
from the statistics of labelled documents: it grows a conjunction of threshold
tests by information gain on two thirds of them, prunes it on the rest, moves
each cut into the gap between good and bad rows, keeps it if it is precise, takes away the rows it covers and goes on. The list
is emitted as one ordered Spark conditional expression.

The learner sees at most about ``sample`` labelled rows (chosen by a hash of
doc_id, so the choice is the same in every run); only their statistics, one
short row each, come to the driver. Everything else covers whole texts of all
rows.

Defined results: a null text has no words and fails the base rule; an empty
table gives an empty result; without labels, or with labels of one kind only,
the list is empty and only the base rule rejects; repeated rows are judged
alike; a text that cannot have a ratio (no words) has ratio 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import BLANKS, let, packed, table, unpacked

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
SAMPLE = 6_000
MIN_PRECISION = 0.9
MAX_TESTS = 4
MAX_RULES = 12
CUTS = 48
FEATURES = ("n_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "mark_ratio")


def repeated_words(words: Column) -> Column:
    """Words inside windows of 8 words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Sorting (hash, position) finds the
    repeated ones; a covered run of windows covers as many words as its starts
    span, 8 at most for each.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def of_repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(let(pairs, again), zero, step, lambda acc: acc["n"])

    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(of_repeats(h)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(counted).cast("long")


def statistics(text: Column) -> Column:
    """One struct with the base counts and the learner's features of a text."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.when(F.element_at(words, 1) == "", 0).otherwise(F.size(words)).cast("long")
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        counts = F.struct(
            n.alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
            F.regexp_count(whole, F.lit(r"\p{Lu}")).alias("n_upper"),
            F.regexp_count(whole, F.lit(r"[0-9]")).alias("n_digits"),
            F.regexp_count(whole, F.lit(r"[!?|]")).alias("n_marks"),
        )
        return let(counts, with_ratios)

    def with_ratios(c: Column) -> Column:
        over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
        return F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")],
            c["lines"]["dup"].cast("long").alias("n_dup_lines"),
            over(c["word_chars"], c["n_words"]).alias("word_length"),
            over(c["n_symbols"], c["word_chars"]).alias("symbol_ratio"),
            over(c["lines"]["dup"], c["lines"]["all"]).alias("dup_line_ratio"),
            over(c["n_repeat_words"], c["n_words"]).alias("repeat_ratio"),
            over(c["n_distinct"], c["n_words"]).alias("distinct_ratio"),
            over(c["n_upper"], c["word_chars"]).alias("upper_ratio"),
            over(c["n_digits"], c["word_chars"]).alias("digit_ratio"),
            over(c["n_marks"], c["word_chars"]).alias("mark_ratio"),
        )

    return let(F.split(F.btrim(whole, F.lit(BLANKS)), BLANK), of_words)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.cut if self.above else column <= self.cut

    def column(self, stats: Column) -> Column:
        return stats[self.feature] > self.cut if self.above else stats[self.feature] <= self.cut


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), dtype=bool)
    for test in rule:
        held &= test.holds(x)
    return held


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the test of the highest information gain until only bad rows are covered."""
    rule: Rule = ()
    held = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_TESTS:
        p0, n0 = int((held & bad).sum()), int((held & ~bad).sum())
        if not n0 or not p0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for k, feature in enumerate(FEATURES):
            for cut in np.unique(np.quantile(x[held, k], np.linspace(0, 1, CUTS + 1)[:-1])):
                above = x[:, k] > cut
                for side, mask in ((True, above), (False, ~above)):
                    p, n = int((held & mask & bad).sum()), int((held & mask & ~bad).sum())
                    if p and (gain := p * (math.log2(p / (p + n)) - before)) > best[0]:
                        best = gain, Test(feature, side, float(cut))
        if best[1] is None:
            break
        rule += (best[1],)
        held &= best[1].holds(x)
    return rule


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that separates best on rows it was not grown on."""

    def worth(r: Rule) -> float:
        held = covers(r, x)
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth) if rule else rule


def widen(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Move each cut half way towards the bad rows that the rule covers, away from the good ones."""
    held = covers(rule, x) & bad
    out = []
    for test in rule:
        values = x[held, FEATURES.index(test.feature)]
        edge = float(np.quantile(values, 0.02 if test.above else 0.98)) if len(values) else test.cut
        out.append(Test(test.feature, test.above, (test.cut + edge) / 2))
    return tuple(out)


def learn_list(x: np.ndarray, bad: np.ndarray, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Ordered rules; a document that one of them covers is rejected."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < MAX_RULES and (bad & ~third).any() and (bad & third).any():
        rule = prune(grow(x[~third], bad[~third]), x[third], bad[third])
        rule = widen(rule, x, bad)
        held = covers(rule, x)
        p, n = int((held & third & bad).sum()), int((held & third & ~bad).sum())
        if not rule or p < 2 or p < min_precision * (p + n):
            break
        rules.append(rule)
        x, bad, third = x[~held], bad[~held], third[~held]
    return rules


def rule_column(rules: list[Rule], stats: Column) -> Column:
    """Number of the first rule that covers a row, 0 if none does."""
    if not rules:
        return F.lit(0)
    out = None
    for k, rule in enumerate(rules, 1):
        held = None
        for test in rule:
            held = test.column(stats) if held is None else held & test.column(stats)
        out = F.when(held, F.lit(k)) if out is None else out.when(held, F.lit(k))
    return out.otherwise(F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most about ``sample`` labelled rows of ``docs``."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``sample`` rows
    seen = joined.select("doc_id", "quality", statistics(F.col("text")).alias("s")).select("doc_id", "quality", *[F.col(f"s.{f}").cast("double").alias(f) for f in FEATURES]).collect()
    seen.sort(key=lambda r: (r["doc_id"], *[r[f] for f in FEATURES]))
    if not seen:
        return []
    return learn_list(np.array([[r[f] for f in FEATURES] for r in seen]), np.array([r["quality"] == 0 for r in seen]))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with quality_stats, base_failed, quality_rule and kept."""
    stats = F.col("quality_stats")
    failed = (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])
    return (
        docs.withColumn("quality_stats", statistics(F.col("text")))
        .withColumn("base_failed", failed)
        .withColumn("quality_rule", rule_column(rules, stats))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_rule") == 0))
    )


def quality_filter(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the base rule and the learned list keep, with their columns."""
    judged = judge(packed(docs, "text"), learn(docs, labels, sample))
    return unpacked(judged.where("kept"), docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, learn(docs, table(spark, sf_dir, "labels")))
    s = F.col("quality_stats")
    return judged.select("doc_id", *[s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", F.col("quality_rule").cast("int"))
