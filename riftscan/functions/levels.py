"""Levels as ordinals, and the decision tables over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of levels, from the lowest to the highest.
OVERLAP = ("SAFE", "LOW", "MEDIUM", "HIGH")
RISK = ("low", "medium", "high", "critical")
CONFIDENCE = ("low", "medium", "high")
# Weights and labels by level.
HEALTH_WEIGHT = {"critical": 40, "high": 20, "medium": 5, "low": 1}
FIX_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}
HEALTH_COLOR = ((75, "#2ed573"), (50, "#ffa502"), (25, "#ff6348"), (0, "#ff4757"))
OVERLAP_LABEL = {
    "SAFE": "No overlap — safe",
    "LOW": "Nearby changes — low interaction risk",
    "MEDIUM": "Adjacent changes — potential interaction",
    "HIGH": "Direct line overlap — likely textual conflict",
}


def pick(key: Column, values: dict, default: object = None) -> Column:
    """The value of a key, as one conditional expression."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def ordinal(level: Column, names: tuple[str, ...]) -> Column:
    return pick(level, {n: k for k, n in enumerate(names)})


def named(number: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), number.cast("int"))


def assigned_level(category: Column, confidence: Column, suggested: Column) -> Column:
    """Risk level of a finding."""
    high = confidence == "high"
    return (
        F.when(category == "hardcoded_secret", F.when(high, "critical").when(confidence == "medium", "high").otherwise("medium"))
        .when(category.isin("sql_injection", "command_injection", "unsafe_eval"), F.when(confidence.isin("high", "medium"), "high").otherwise("medium"))
        .when(category.isin("unsanitized_input", "insecure_deserialization"), F.when(high, "high").otherwise("medium"))
        .otherwise(suggested)
    )


def score_level(score: Column) -> Column:
    return F.when(score >= 80, "CRITICAL").when(score >= 50, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")


def overlap_label(level: Column) -> Column:
    return pick(level, OVERLAP_LABEL)


def health_color(score: Column) -> Column:
    out = F.lit(HEALTH_COLOR[-1][1])
    for least, color in reversed(HEALTH_COLOR[:-1]):
        out = F.when(score >= least, F.lit(color)).otherwise(out)
    return out


def diagnostic_severity(level: Column) -> Column:
    return F.when(level.isin("critical", "high"), "Error").when(level == "medium", "Warning").otherwise("Information")


def known_level(level: Column) -> Column:
    """Lower case; a missing or unknown level counts as medium."""
    low = F.lower(F.coalesce(level, F.lit("medium")))
    return F.when(low.isin(*RISK), low).otherwise("medium")
