"""Findings to risks: level assignment, merging by place, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftscan.functions.levels import CONFIDENCE, RISK, assigned_level, named, ordinal

# Fixed value: what stands where no explanation was asked for yet.
PENDING = "Pending AI response..."
SOURCES = ("secret_scanner", "injection_scanner")


def all_findings(secrets: DataFrame, injections: DataFrame) -> DataFrame:
    """Union of both scanners, with the order in which they are merged: scanner, file, line, rule."""
    scanner = F.when(F.col("source") == SOURCES[0], 0).otherwise(1)
    return secrets.unionByName(injections).withColumn("seq", F.struct(scanner.alias("scanner"), "file", "line", "rule_pos"))


#: Places of a scanner's rules in the order of merging.
STEP = 1 << 20


def merge_findings(findings: DataFrame, categories: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """One risk for each file and line.

    The highest level and confidence win, names are joined in order, the
    category is the first finding's, and the preview that of the first finding
    to reach the highest level (a missing one keeps the one before). All of it
    is one aggregation with map-side partial results. Previews are gathered
    apart from the rest, so that where nobody reads them no line is masked.
    ``categories`` are those of each scanner's rules, by number: with them the
    first finding's is told by its place alone, and where no names are read the
    aggregation holds nothing but numbers.
    """
    level = ordinal(assigned_level(F.col("category"), F.col("confidence"), F.col("suggested_level")), RISK)
    rows = findings.withColumn("level", level).withColumn("sure", ordinal(F.col("confidence"), CONFIDENCE))
    nth = F.struct("seq.scanner", "seq.rule_pos").alias("nth")  # of one file and line
    merged = rows.groupBy("file", "line").agg(
        F.sort_array(F.collect_list(F.struct(nth, "rule_name", "category"))).alias("all"),
        F.sort_array(F.collect_list(F.struct(nth, "rule_name", "category", "level", F.col("redacted_preview").alias("preview")))).alias("shown"),
        F.max("level").alias("level"),
        F.max("sure").alias("sure"),
        F.min(F.col("seq.scanner").cast("bigint") * STEP + F.col("seq.rule_pos")).alias("place"),
    )
    scanner, rule_pos = F.floor(F.col("place") / STEP).cast("int"), (F.col("place") % STEP).cast("int")

    def take(acc: Column, x: Column) -> Column:
        rises = x["level"] > acc["level"]
        return F.struct(F.greatest(acc["level"], x["level"]).alias("level"), F.when(rises, F.coalesce(x["preview"], acc["preview"])).otherwise(acc["preview"]).alias("preview"))

    first_shown = F.get("shown", F.lit(0))
    if categories is None:
        category = F.get("all", F.lit(0))["category"]
    else:
        of = [F.get(F.array(*[F.lit(c) for c in names]), rule_pos) for names in categories]
        category = F.when(scanner == 0, of[0]).otherwise(of[1])
    start = F.struct(first_shown["level"].alias("level"), first_shown["preview"].alias("preview"))
    return merged.select(
        F.lit("security_risk").alias("type"),
        category.alias("category"),
        "file",
        "line",
        named(F.col("level"), RISK).alias("risk_level"),
        F.array_join(F.transform("all", lambda x: x["rule_name"]), "; ").alias("rule_matched"),
        named(F.col("sure"), CONFIDENCE).alias("confidence"),
        F.aggregate(F.slice(F.col("shown"), 2, F.size("shown")), start, take, lambda acc: acc["preview"]).alias("redacted_preview"),
        F.lit(None).cast("string").alias("ai_explanation"),
        F.struct(scanner.alias("scanner"), "file", "line", rule_pos.alias("rule_pos")).alias("seq"),
    )


def with_ids(risks: DataFrame) -> DataFrame:
    """Random ids, as late as possible: they differ from run to run."""
    return risks.withColumn("id", F.expr("uuid()"))


def ranked(risks: DataFrame) -> DataFrame:
    """Most severe first; equals keep the order in which they were found."""
    return risks.orderBy(F.desc(ordinal(F.col("risk_level"), RISK)), "seq")


def adapt_security(risks: DataFrame) -> DataFrame:
    """Security risks in the common shape (flat columns; nested at the edge by ``report.nest``)."""
    return risks.select(
        "id",
        F.lit("security_risk").alias("type"),
        "risk_level",
        "file",
        F.coalesce(F.col("line"), F.lit(1)).alias("line"),
        F.lit(None).cast("string").alias("function_name"),
        "category",
        F.lit(None).cast("string").alias("change_type"),
        "redacted_preview",
        F.lit(None).cast("array<string>").alias("affected_files"),
        F.lit(PENDING).alias("explanation"),
        F.lit(PENDING).alias("recommendation"),
    )
