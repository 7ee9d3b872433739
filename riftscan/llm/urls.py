"""URL filter: rules, then gradient-boosted trees on lexical features (operator 11), in DataFrame functions only.

A rule names a host and the beginning of a path and allows or blocks; it fits
its host and all subdomains, and the longest rule that fits decides. Other
URLs are judged by boosted trees on lexical features: lengths, depths, digit
ratios, entropies, numbers of parameters, and statistics of suffixes (of the
host's last label, its last two, and the path's extension): the logarithm of
how much larger its share of the blocked labelled URLs is than its share of
the allowed ones, 0 for a suffix that none has.

The labelled URLs are those of the corpus that a rule decides, unless the
caller has labels of its own. Statistics of suffixes count every labelled URL,
in ``BUCKETS`` hash buckets for each kind of suffix, so that what is broadcast
has a fixed size whatever hosts there are (suffixes may share a bucket). Trees
are fitted on at most about ``SAMPLE`` labelled URLs, chosen by a hash of the
URL; there a URL's suffixes have the statistics of the other half of the
labelled URLs, which its own label is no part of. Both labels weigh alike, as
what rules name says nothing about how many other URLs are bad. Every third of
the sample is held out. Trees are emitted as one column expression.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no rule and is judged by its features; repeated rows are judged alike; of
rules of equal length the first given wins; a very long URL is read as a
whole; without labelled URLs every URL is allowed; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.functions.text import shannon_entropy
from riftscan.llm.base import let, table
from riftscan.llm.pii import Node, boost, leaf_values

SAMPLE, BUCKETS, CUTS, PRIOR = 20_000, 4096, 15, 5.0
ROUNDS, DEPTH, RATE = 24, 4, 0.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = ("url_length", "host_length", "path_length", "query_length", "path_depth", "host_depth", "digit_ratio", "host_digit_ratio", "path_digit_ratio", "host_entropy", "path_entropy", "parameters")
SUFFIXES = ("top", "second", "extension")
FEATURES = (*PLAIN, *[f"{s}_evidence" for s in SUFFIXES])


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules: verdict, host, beginning of the path.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def parsed(urls: DataFrame) -> DataFrame:
    """``urls`` with host, path and query."""
    url = F.coalesce(F.col("url"), F.lit(""))
    after = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    cut = urls.withColumn("after", after).withColumn("raw_host", F.regexp_extract("after", r"\A[^/?#]*+", 0))
    rest = cut.withColumn("rest", F.substring(F.col("after"), F.length("raw_host") + 1, F.length("after")))
    return rest.select(
        *urls.columns,
        F.translate("raw_host", UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"\A[^?#]*+", 0).alias("path"),
        F.regexp_extract("rest", r"\A[^?#]*+\?([^#]*+)", 1).alias("query"),
    )


def rule_columns(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host and path; null if none does."""
    name = verdict = None
    host, path = F.col("host"), F.col("path")
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def suffix_columns() -> list[Column]:
    """The bucket of each kind of suffix."""
    labels = F.split("host", r"\.")
    last = F.element_at(F.split("path", "/"), -1)
    found = (F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.when(F.contains(last, F.lit(".")), F.element_at(F.split(last, r"\."), -1)).otherwise(""))
    return [F.pmod(F.crc32(F.encode(x, "utf-8")), F.lit(BUCKETS)).cast("int").alias(s) for s, x in zip(SUFFIXES, found)]


def plain_features() -> list[Column]:
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path, query = F.col("host"), F.col("path"), F.col("query")
    share = lambda x: F.when(F.length(x) > 0, F.regexp_count(x, F.lit("[0-9]")) / F.length(x)).otherwise(0.0)
    parts = lambda x, mark: F.size(F.filter(F.split(x, mark), lambda p: p != ""))
    found = (F.length(url), F.length(host), F.length(path), F.length(query), parts(path, "/"), parts(host, r"\."), share(url), share(host), share(path), let(host, shannon_entropy), let(path, shannon_entropy), parts(query, "&"))
    return [x.cast("double").alias(n) for n, x in zip(PLAIN, found)]


def half_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(13), url), F.lit(2)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """kind, bucket, and n and blocked of both halves, of every suffix bucket of the labelled URLs: at most ``BUCKETS`` rows for each kind."""
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("bucket")) for s in SUFFIXES])).alias("k")
    of = lambda k, x: F.count_if((F.col("half") == k) & x)
    counts = [of(k, x).alias(f"{name}{k}") for k in (0, 1) for name, x in (("n", F.lit(True)), ("blocked", F.col("block")))]
    return labelled.select(kinds, "block", half_of(F.col("url")).alias("half")).groupBy("k.kind", "k.bucket").agg(*counts)


class Totals(NamedTuple):
    n0: int
    blocked0: int
    n1: int
    blocked1: int


def totals_of(stats: DataFrame) -> Totals:
    """Of both halves, the numbers of labelled and of blocked URLs: each URL counts once for a kind of suffix."""
    row = stats.where(F.col("kind") == SUFFIXES[0]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in Totals._fields]).first()
    return Totals(*row)


def evidence(n: Column, blocked: Column, all_n: int, all_blocked: int) -> Column:
    few = PRIOR / (all_n + PRIOR)
    return F.log((blocked / max(1, all_blocked) + few) / ((n - blocked) / max(1, all_n - all_blocked) + few))


def with_features(rows: DataFrame, stats: DataFrame, totals: Totals, apart: bool = False) -> DataFrame:
    """``rows`` with x, the array of features; ``apart``: with the statistics of the half that a row is not in."""
    out, counts = rows, Totals._fields
    for s in SUFFIXES:  # the sides that are broadcast have ``BUCKETS`` rows
        of_kind = stats.where(F.col("kind") == s).select(F.col("bucket").alias(s), F.struct(*counts).alias(f"{s}_counts"))
        out = out.join(F.broadcast(of_kind), s, "left")
    found = []
    for s in SUFFIXES:
        n0, blocked0, n1, blocked1 = (F.coalesce(F.col(f"{s}_counts.{c}"), F.lit(0)) for c in counts)
        every = evidence(n0 + n1, blocked0 + blocked1, totals.n0 + totals.n1, totals.blocked0 + totals.blocked1)
        other = F.when(half_of(F.col("url")) == 0, evidence(n1, blocked1, totals.n1, totals.blocked1)).otherwise(evidence(n0, blocked0, totals.n0, totals.blocked0))
        found.append(other if apart else every)
    return out.select(*rows.columns, F.array(*[F.col(p) for p in PLAIN], *found).alias("x"))


class Model(NamedTuple):
    tests: list[tuple[int, float]]
    trees: list[Node]
    accuracy: float  # mean of both labels' shares of right verdicts on the part of the sample that is held out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees over threshold tests between the values that the sample shows."""
    tests = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        if len(values) > CUTS + 1:
            values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2), method="nearest"))
        tests += [(k, float(c)) for c in (values[1:] + values[:-1]) / 2]
    held = np.arange(len(x)) % 3 == 2
    over = np.stack([x[:, k] > c for k, c in tests], axis=1).astype(float) if tests else np.zeros((len(x), 1))
    a, b = over[~held], y[~held]
    n = [int((b == k).sum()) for k in (0, 1)]
    each = [round(max(n) / k) if k else 0 for k in n]
    again = np.where(b > 0, each[1], each[0])
    trees = boost(np.repeat(a, again, axis=0), np.repeat(b, again), ROUNDS, DEPTH, RATE)
    right = (sum(leaf_values(t, over[held]) for t in trees) >= 0) == (y[held] > 0)
    sides = [right[y[held] == k].mean() for k in (0, 1) if (y[held] == k).any()]
    return Model(tests, trees, float(np.mean(sides)) if sides else float("nan"))


def train(labelled: DataFrame, stats: DataFrame, totals: Totals, sample: int = SAMPLE) -> Model:
    """Trees from at most about ``sample`` labelled URLs (columns of ``described``, and block)."""
    share = min(1.0, sample / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit(11), "url"), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0))
    seen = with_features(chosen, stats, totals, apart=True).select(F.xxhash64(F.lit(12), "url").alias("h"), "block", "x").collect()
    seen.sort(key=lambda r: (r["h"], r["block"], r["x"]))
    if not seen:
        return Model([], [], float("nan"))
    return fit(np.array([r["x"] for r in seen]), np.array([float(r["block"]) for r in seen]))


def tree_column(node: Node, x: Column, tests: list[tuple[int, float]]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    k, cut = tests[node.feature]
    return F.when(F.get(x, F.lit(k)) > cut, tree_column(node.yes, x, tests)).otherwise(tree_column(node.no, x, tests))


def score_column(model: Model, x: Column) -> Column:
    """Log-odds that a URL is to be blocked."""
    return reduce(lambda a, b: a + b, [tree_column(t, x, model.tests) for t in model.trees], F.lit(0.0 if model.trees else -1.0))


def described(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``urls`` with host, path, rule, rule_verdict, plain features and suffix buckets."""
    name, verdict = rule_columns(rules)
    rows = parsed(urls)
    return rows.select(*urls.columns, "host", "path", name.alias("rule"), verdict.alias("rule_verdict"), *plain_features(), *suffix_columns())


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """``urls`` (with a column url) with host, path, rule, verdict, score.

    ``labels`` (url, block) are the labelled URLs; by default those that a rule decides.
    """
    rows = described(urls, rules)
    if labels is None:
        labelled = rows.where("rule is not null").withColumn("block", F.col("rule_verdict") == "block")
    else:
        labelled = described(labels.where("block is not null").select("url", "block"), rules)
    stats = suffix_statistics(labelled)
    totals = totals_of(stats)
    model = train(labelled, stats, totals, sample)
    score = score_column(model, F.col("x"))
    scored = with_features(rows, stats, totals).withColumn("score", score)
    return scored.select(*urls.columns, "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("score") >= 0, "block").otherwise("allow")).alias("verdict"), "score")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
