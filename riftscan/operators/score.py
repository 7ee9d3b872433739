"""The risk score of a branch pair, and the scores of a list of risks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftscan.functions.levels import FIX_WEIGHT, HEALTH_WEIGHT, RISK, health_color, known_level, ordinal, pick, score_level


# Texts and points beside the factors.
MANY_PAIRS, MANY_POINTS, MANY_REASON = 5, 15, "High number of overlapping hunk pairs (%d)"
SOME_PAIRS, SOME_POINTS, SOME_REASON = 2, 8, "Multiple overlapping hunk pairs (%d)"
NOTHING_REASON = "No conflicting changes detected between the branches"
QUIET_REASON = "Nearby changes — low interaction risk only"


@dataclass(frozen=True)
class Factor:
    """A weighted yes-or-no expression over the aggregated facts of a pair."""

    name: str
    weight: int
    applies: Column


def facts(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """One row of everything that factors look at: one pass over each side."""
    level = F.col("overlap_level")
    binary = files.where("is_binary").select(F.col("path").alias("file")).distinct().withColumn("binary", F.lit(True))
    c = candidates.join(binary, "file", "left").agg(
        F.count("*").alias("n_candidates"),
        F.coalesce(F.bool_or(level == "HIGH"), F.lit(False)).alias("any_high"),
        F.coalesce(F.bool_or(level == "MEDIUM"), F.lit(False)).alias("any_medium"),
        F.coalesce(F.bool_or("has_conflict"), F.lit(False)).alias("any_conflict"),
        F.count_if(level.isin("HIGH", "MEDIUM")).alias("n_touching"),
        F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.bool_or("binary"), F.lit(False)).alias("any_binary"),
    )
    f = files.agg(F.count("*").alias("n_files"), F.coalesce(F.bool_or((F.col("status") == "deleted") & ((F.col("n_changes_a") > 0) | (F.col("n_changes_b") > 0))), F.lit(False)).alias("any_deleted"))
    return c.join(f)  # one row each


def default_factors(ahead_a: Column, ahead_b: Column) -> list[Factor]:
    far = (ahead_a >= 5) & (ahead_b >= 5)
    # Names and weights, in order.
    return [
        Factor("Direct modification overlap on same lines", 35, F.col("any_high")),
        Factor("Git merge-tree predicts an actual merge conflict", 25, F.col("any_conflict")),
        Factor("Multiple files with overlapping changes", 15, F.col("n_touching") > 1),
        Factor("Adjacent modifications — potential merge interaction", 10, F.col("any_medium") & ~F.col("any_high")),
        Factor("File deleted on one branch while modified on another", 10, F.col("any_deleted")),
        Factor("Binary file involved in conflicting change", 5, F.col("any_binary")),
        Factor("Highly diverged branches (many commits ahead on both sides)", 10, far),
        Factor("Moderately diverged branches", 5, ((ahead_a >= 2) | (ahead_b >= 2)) & ~far),
    ]


def repo_risk(candidates: DataFrame, files: DataFrame, ahead_a: int, ahead_b: int, extra: tuple[Factor, ...] = ()) -> DataFrame:
    """score, level, factors (joined by '; ')."""
    factors = [*default_factors(F.lit(ahead_a), F.lit(ahead_b)), *extra]
    n = F.col("n_pairs")
    total = F.when(n > MANY_PAIRS, MANY_POINTS).when(n > SOME_PAIRS, SOME_POINTS).otherwise(0)
    for f in factors:
        total = total + F.when(f.applies, f.weight).otherwise(0)
    reasons = [F.when(f.applies, F.lit(f.name)) for f in factors]
    reasons.append(F.when(n > MANY_PAIRS, F.format_string(MANY_REASON, n)).when(n > SOME_PAIRS, F.format_string(SOME_REASON, n)))
    active = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    nothing = (F.col("n_candidates") == 0) & (F.col("n_files") == 0)
    score = F.when(nothing, 0).otherwise(F.least(total, F.lit(100))).cast("int")
    text = F.when(nothing, NOTHING_REASON).when(F.size(active) == 0, QUIET_REASON).otherwise(F.array_join(active, "; "))
    return facts(candidates, files).select(score.alias("score"), score_level(score).alias("level"), text.alias("factors"))


def health(risks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """score and color of a list of risks, or of the risks of each ``keys`` (a file); 100 for an empty list."""
    penalty = F.coalesce(F.sum(pick(known_level(F.col("risk_level")), HEALTH_WEIGHT)), F.lit(0))
    score = F.greatest(F.lit(0).cast("bigint"), F.lit(100) - penalty)
    return risks.groupBy(*keys).agg(score.alias("score")).withColumn("color", health_color(F.col("score")))


def severity_breakdown(risks: DataFrame) -> DataFrame:
    """Number and share in per cent of each of the four levels, zeros included."""
    level = known_level(F.col("risk_level"))
    sums = risks.agg(F.count("*").alias("total"), *[F.count_if(level == name).alias(name) for name in RISK])
    rows = F.array(*[F.struct(F.lit(name).alias("risk_level"), F.col(name).alias("n")) for name in reversed(RISK)])
    share = F.when(F.col("total") > 0, 100.0 * F.col("x.n") / F.col("total")).otherwise(0.0)
    return sums.select("total", F.explode(rows).alias("x")).select("x.risk_level", "x.n", share.alias("pct"))


def severity_summary(risks: DataFrame) -> DataFrame:
    """Number of each level that occurs, most severe first."""
    return risks.groupBy("risk_level").agg(F.count("*").alias("n")).orderBy(F.desc(ordinal(F.col("risk_level"), RISK)))


def best_fixes(risks: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` risks to fix first, with their rank: by severity, then files touched, then position."""
    weight = F.coalesce(pick(F.col("risk_level"), FIX_WEIGHT), F.lit(1))
    files = F.coalesce(F.col("n_files"), F.lit(1))
    top = risks.withColumn("weight", weight).withColumn("files", files).orderBy(F.desc("weight"), F.desc("files"), "seq").limit(k)
    ordered = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), (-F.col("files")).alias("f"), "seq", F.struct(*[F.col(c) for c in risks.columns]).alias("risk")))).alias("all"))  # k rows
    return ordered.select(F.posexplode("all").alias("at", "x")).select((F.col("at") + 1).alias("rank"), "x.risk.*")
