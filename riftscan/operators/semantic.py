"""Signature changes and the call sites that they leave stale.

Input rows: signatures (ref, file, name, params as an array, seq) with ref
'base', 'A' or 'B'; call sites (ref, caller_file, called_function, line).
Both branches are handled in one plan by carrying the branch as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# What is said of a change's effect on callers.
MORE_REASON = "Function '%s' requires at least %d argument(s) (new signature: %s), but old callers provide fewer arguments."
REMOVED_REASON = "Function '%s' was removed from %s, but call sites still reference it."
CHANGED_REASON = "Function '%s' signature changed from (%s) to (%s)."
SAME_REASON = "Signature change matches existing call sites."


def latest(signatures: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One signature for each key: the last in the file."""
    return signatures.groupBy(*keys).agg(F.max_by("params", "seq").alias("params"))


def signature_changes(signatures: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """branch, file, name, old_params, new_params, change_type.

    ``known`` (file) limits the comparison to files that exist in the base;
    by default the files of the base's signatures.
    """
    base = latest(signatures.where("ref = 'base'"), ("file", "name")).withColumnRenamed("params", "old")
    new = latest(signatures.where("ref <> 'base'"), ("ref", "file", "name")).withColumnRenamed("params", "new")
    branches = F.explode(F.array(F.lit("A"), F.lit("B")))
    base = base.withColumn("ref", branches)
    both = base.join(new, ["ref", "file", "name"], "full_outer")
    known = signatures.where("ref = 'base'").select("file") if known is None else known
    both = both.join(known.select("file").distinct(), "file", "left_semi")
    kind = F.when(F.col("new").isNull(), "function_removed").when(F.col("old").isNull(), "function_added").when(F.col("old") != F.col("new"), "signature_change")
    none = F.array().cast("array<string>")
    return both.withColumn("change_type", kind).where("change_type is not null").select(
        F.col("ref").alias("branch"), "file", "name", F.coalesce("old", none).alias("old_params"), F.coalesce("new", none).alias("new_params"), "change_type"
    )


def sites_text(sites: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(sites, lambda s: F.concat(s["caller_file"], F.lit(":"), s["line"].cast("string")))), "|")


def semantic_conflicts(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """Changes with stale callers: on the other branch, or elsewhere on the same one; first of equal ones kept."""
    changed = changes.where("change_type = 'signature_change'")
    joined = changed.join(calls, changed["name"] == calls["called_function"])
    cross = F.col("branch") != F.col("ref")
    pairs = joined.where(cross | (F.col("caller_file") != F.col("file"))).withColumn("scope", F.when(cross, "cross-branch").otherwise("intra-branch"))
    grouped = pairs.groupBy("scope", "branch", "name", "file", "old_params", "new_params").agg(F.sort_array(F.collect_list(F.struct("caller_file", "line"))).alias("sites"))
    # Passes run A, B across branches, then A, B within; of equal keys the first pass wins.
    order = F.when(F.col("scope") == "cross-branch", 0).otherwise(2) + F.when(F.col("branch") == "A", 0).otherwise(1)
    grouped = grouped.withColumn("sites_key", sites_text(F.col("sites"))).withColumn("pass_ord", order)
    first = F.row_number().over(Window.partitionBy("scope", "name", "file", "sites_key").orderBy("pass_ord"))
    return grouped.withColumn("nth", first).where("nth = 1").drop("nth")


def call_graph(calls: DataFrame) -> DataFrame:
    """called_function and its call sites, by file and line."""
    return calls.groupBy("called_function").agg(F.sort_array(F.collect_list(F.struct("caller_file", "line"))).alias("sites"))


def joined_params(params: Column) -> Column:
    return F.array_join(params, ", ")


def signature_breaks(changes: DataFrame, calls: DataFrame) -> DataFrame:
    """What a change does to callers at run time, with the number of call sites by name."""
    required = F.filter("new_params", lambda p: ~F.startswith(p, F.lit("...")) & ~F.contains(p, F.lit("=")) & ~p.isin("{}", "[]"))
    least = F.size(required)
    more = least > F.size("old_params")
    removed = F.col("change_type") == "function_removed"
    differs = F.col("old_params") != F.col("new_params")
    name, old, new = F.col("name"), joined_params(F.col("old_params")), joined_params(F.col("new_params"))
    reason = (
        F.when(more, F.format_string(MORE_REASON, name, least, new))
        .when(removed, F.format_string(REMOVED_REASON, name, F.col("file")))
        .when(differs, F.format_string(CHANGED_REASON, name, old, new))
        .otherwise(SAME_REASON)
    )
    sites = calls.groupBy(F.col("called_function").alias("name")).agg(F.count("*").alias("n_sites"))
    return changes.join(sites, "name", "left").select(
        "branch", "file", "name", (more | removed | differs).alias("is_break"), reason.alias("reason"), least.cast("int").alias("min_args"), F.size("new_params").cast("int").alias("max_args"), F.coalesce("n_sites", F.lit(0)).cast("bigint").alias("n_sites")
    )
