"""Changed files of two branches, overlap of their line ranges, and conflict candidates.

Ranges stay exploded: file, branch or side, start_line, line_count, end_line,
change_type. The interval join is an equi-join on the file and a bin of lines
with the distance as its residual condition. Bins are blocks of lines, groups
of eight blocks, of 64 and so on: a range sits in the largest bins that it
fills, so a range of any length has a few rows for each level of bins.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from riftscan.functions.levels import OVERLAP, named, ordinal, pick

NEAR = 5
# Points and texts of a candidate's score, and the text of an alert.
LEVEL_POINTS = {"HIGH": 40, "MEDIUM": 20, "LOW": 5}
LEVEL_REASONS = {"HIGH": "Direct modification overlap on same lines", "MEDIUM": "Adjacent modifications — may interact during merge", "LOW": "Nearby modifications within 5 lines"}
CONFLICT_POINTS, CONFLICT_REASON = 30, "Git merge-tree predicts an actual merge conflict"
MANY_POINTS, MANY_REASON = 15, "Multiple overlapping hunks (%d)"
TWO_POINTS, TWO_REASON = 8, "Two overlapping hunks"
ALERT = "Proactive Alert: '%s' on your branch '%s' will conflict with already-pushed branch '%s' (%s)"
#: Lines of a block, the smallest bin in which ranges are joined; levels of bins, each of 2^GROWTH of the level below.
BLOCK, GROWTH, LEVELS = 64, 3, 9
#: Integers are from -HALF to HALF - 1.
HALF = 1 << 31


def branch_files(status: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files of one branch with additions and deletions; a file's ranges are looked up by new path, then by old."""
    sums = ranges.groupBy("path").agg(
        F.sum(F.when(F.col("change_type") == "added", F.col("line_count")).otherwise(0)).alias("additions"),
        F.sum(F.when(F.col("change_type") == "removed", F.col("line_count")).otherwise(0)).alias("deletions"),
    )
    old = sums.select(F.col("path").alias("old_path"), F.col("additions").alias("old_additions"), F.col("deletions").alias("old_deletions"))
    joined = status.join(sums, "path", "left").join(old, "old_path", "left")
    zero = F.lit(0)
    return joined.select("path", "old_path", "status", F.coalesce("additions", "old_additions", zero).cast("bigint").alias("additions"), F.coalesce("deletions", "old_deletions", zero).cast("bigint").alias("deletions"), "is_binary")


def merge_branch_files(a: DataFrame, b: DataFrame, ranges_a: DataFrame, ranges_b: DataFrame) -> DataFrame:
    """All files of either branch, A's row where both have one, with the number of ranges on each side."""
    side = lambda files, name: files.select("path", F.struct(*[c for c in files.columns if c != "path"]).alias(name))
    both = side(a, "a").join(side(b, "b"), "path", "full_outer")
    count = lambda ranges, name: ranges.groupBy("path").agg(F.count("*").alias(name))
    merged = both.join(count(ranges_a, "n_a"), "path", "left").join(count(ranges_b, "n_b"), "path", "left")
    base = F.coalesce("a", "b")
    fields = [c for c in a.columns if c != "path"]
    seen = lambda s, n: F.when(F.col(s).isNotNull(), F.coalesce(n, F.lit(0))).otherwise(0).cast("bigint")
    return merged.select("path", *[base[c].alias(c) for c in fields], seen("a", "n_a").alias("n_changes_a"), seen("b", "n_b").alias("n_changes_b"))


def pair_level(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """Level and number of shared lines of two closed ranges."""
    low, high = F.greatest(a_start, b_start), F.least(a_end, b_end)
    gap = F.least(F.abs(a_end - b_start), F.abs(b_end - a_start))
    level = F.when(low <= high, "HIGH").when(gap == 0, "MEDIUM").when(gap <= NEAR, "LOW").otherwise("SAFE")
    return level, F.when(low <= high, high - low + 1).otherwise(0)


def last_line(prefix: str) -> Column:
    return F.when(F.col(f"{prefix}_line_count") == 0, F.col(f"{prefix}_start_line")).otherwise(F.col(f"{prefix}_end_line"))


def block(line: Column) -> Column:
    return F.floor(line / BLOCK).cast("bigint")


def bins(first: Column, last: Column) -> Column:
    """Level and number of the largest bins that make up the blocks first to last."""
    item = "array<struct<level:int,bin:bigint>>"

    def filled(level: int) -> tuple[Column, Column]:
        n = 1 << (GROWTH * level)
        return F.ceil(first / n).cast("bigint"), (F.floor((last + 1) / n) - 1).cast("bigint")

    def found(level: int) -> Column:
        (lo, hi), (lo_above, hi_above), many = filled(level), filled(level + 1), 1 << GROWTH
        run = lambda a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(level).alias("level"), x.alias("bin")))).otherwise(F.array().cast(item))
        if level == LEVELS - 1:  # the largest bins are not grouped any further
            return run(lo, hi)
        return F.when(lo_above > hi_above, run(lo, hi)).otherwise(F.concat(run(lo, F.least(hi, lo_above * many - 1)), run(F.greatest(lo, (hi_above + 1) * many), hi)))

    few = F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(0).alias("level"), b.alias("bin")))
    many = F.flatten(F.array(*[found(k) for k in range(LEVELS)]))
    return F.when(last - first < (1 << GROWTH) - 1, few).otherwise(many)


def overlaps(ranges_a: DataFrame, ranges_b: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Pairs of ranges of one file that overlap or lie within five lines: keys, both ranges, level, shared lines.

    Short ranges meet in their blocks. Pairs with a long one are made apart,
    over all levels of bins; where no range is long that part reads its inputs
    and makes no rows. A pair counts in the bin of its first common line, once.
    Far ranges are never compared, and a file with very many ranges is spread
    over its bins. Conditions on a range stand where the optimizer can't move
    them below an exchange of the inputs, which other parts of a plan may share.
    """
    columns = ("start_line", "line_count", "end_line", "change_type")
    a = ranges_a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = ranges_b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns])
    a = a.withColumn("a_last", last_line("a")).withColumn("a_from", block(F.col("a_start_line") - NEAR)).withColumn("a_to", F.greatest("a_from", block(F.col("a_last") + NEAR)))
    b = b.withColumn("b_last", last_line("b")).withColumn("b_from", block(F.col("b_start_line"))).withColumn("b_to", F.greatest("b_from", block(F.col("b_last"))))
    long = lambda s: F.col(f"{s}_to") - F.col(f"{s}_from") >= (1 << GROWTH) - 1
    near = (F.col("a_start_line") <= F.col("b_last") + NEAR) & (F.col("b_start_line") <= F.col("a_last") + NEAR)
    near = F.coalesce(near, F.lit(False))
    level, lines = pair_level(F.col("a_start_line"), F.col("a_last"), F.col("b_start_line"), F.col("b_last"))

    def pairs(x: DataFrame, y: DataFrame, same: Column) -> DataFrame:
        return x.join(y, same).select(*[x[k] for k in keys], *[f"a_{c}" for c in columns], *[f"b_{c}" for c in columns], level.alias("level"), lines.alias("shared_lines"))

    def one(x: DataFrame, y: DataFrame) -> Column:
        return reduce(and_, [x[k] == y[k] for k in keys])

    def short(df: DataFrame, s: str) -> DataFrame:
        rows = df.withColumn(f"{s}_bin", F.explode_outer(F.when(~long(s), F.sequence(f"{s}_from", f"{s}_to")))).where(reduce(and_, [F.col(c).isNotNull() for c in (f"{s}_bin", *keys)]))
        return rows.withColumn(f"{s}_meet", F.xxhash64(*keys, f"{s}_bin"))

    first = F.greatest("a_from", "b_from")
    # Joined, and so sorted, by one number; that keys and bins are equal is asked of each pair.
    x, y = short(a, "a"), short(b, "b")
    met = F.coalesce(one(x, y) & (F.col("a_bin") == F.col("b_bin")) & (F.col("a_bin") == first), F.lit(False))
    found = pairs(x, y, (F.col("a_meet") == F.col("b_meet")) & met & near)
    any_long = a.where(long("a")).select(F.lit(1).alias("n")).unionByName(b.where(long("b")).select(F.lit(1).alias("n"))).agg(F.count("n").alias("n")).scalar() > 0
    kept = lambda df, s: df.where(F.when(any_long, F.col(f"{s}_start_line").isNotNull()))  # noqa: E731  names a column, so that it goes down to the scan
    x, y = binned(kept(a, "a"), kept(b, "b"))
    small = lambda side: F.floor(first / F.pow(F.lit(2), F.col(f"{side}_own_level") * GROWTH)).cast("bigint") == F.col(f"{side}_own_bin")
    same = F.when(F.col("a_way") == 0, small("b")).otherwise(small("a")) & (long("a") | long("b"))
    for c in ("way", "level", "bin"):
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return found.unionByName(pairs(x, y, same & one(x, y) & near)).where("level <> 'SAFE'")


def binned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a row for each bin in which their ranges of any length meet.

    Two ranges meet where a bin of one is a bin of the other or holds one. So
    A's own bins are joined with B's own ones and those above them, and the
    bins above A's with B's own.
    """
    top = F.lit(LEVELS - 1)
    above = lambda own: F.transform(F.when(own["level"] < top, F.sequence(own["level"] + 1, top)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.alias("level"), F.floor(own["bin"] / F.pow(F.lit(2), (k - own["level"]) * GROWTH)).cast("bigint").alias("bin")))
    # Way 0: A's own bin with what B has at it or below; way 1: B's own bin with what A has below.
    row = lambda way, key, own: F.struct(F.lit(way).alias("way"), key["level"].alias("level"), key["bin"].alias("bin"), own["level"].alias("own_level"), own["bin"].alias("own_bin"))
    every = lambda own, same, up: F.concat(F.array(*[row(w, own, own) for w in same]), F.transform(above(own), lambda k: row(up, k, own)))
    fields = ("way", "level", "bin", "own_level", "own_bin")
    rows_a = a.withColumn("own", F.explode(bins(F.col("a_from"), F.col("a_to")))).withColumn("at", F.explode(every(F.col("own"), (0,), 1)))
    rows_b = b.withColumn("own", F.explode(bins(F.col("b_from"), F.col("b_to")))).withColumn("at", F.explode(F.filter(every(F.col("own"), (0, 1), 0), lambda x: (x["way"] == 0) | (x["level"] > 0))))
    return rows_a.select(*a.columns, *[F.col(f"at.{c}").alias(f"a_{c}") for c in fields]), rows_b.select(*b.columns, *[F.col(f"at.{c}").alias(f"b_{c}") for c in fields])


def worst_levels(pairs: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Keys, worst level, number of pairs, and start on side B of the first pair.

    The order of pairs is made one number where lines are integers, so that the
    aggregation holds numbers alone and pairs need not be sorted by their keys.
    """
    places = ("a_start_line", "a_end_line", "b_start_line")
    if all(pairs.schema[c].dataType == IntegerType() for c in places):
        digit = lambda c: F.coalesce((F.col(c).cast("bigint") + (HALF + 1)).cast("decimal(11,0)"), F.lit(0).cast("decimal(11,0)"))  # noqa: E731  a missing line comes first
        base = F.lit(Decimal(2 * HALF + 1))
        first = F.min(((digit(places[0]) * base + digit(places[1])) * base + digit(places[2])).cast("decimal(38,0)"))
        first_b = (F.col("first") % base).cast("bigint") - (HALF + 1)
        first_b = F.when(first_b >= -HALF, first_b.cast("int"))
    else:
        first = F.min(F.struct(*places))
        first_b = F.col("first.b_start_line")
    rows = pairs.groupBy(*keys).agg(F.max(ordinal(F.col("level"), OVERLAP)).alias("worst"), F.count("*").alias("n_pairs"), first.alias("first"))
    return rows.select(*keys, named(F.col("worst"), OVERLAP).alias("level"), "n_pairs", first_b.alias("first_b_line"))


def conflict_candidates(files: DataFrame, ranges_a: DataFrame, ranges_b: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Files that overlap, conflict, or were deleted on the one side that touched them.

    ``files``: path, status, n_changes_a, n_changes_b; ``conflicts``: file.
    """
    worst = worst_levels(overlaps(ranges_a, ranges_b))
    hit = conflicts.select(F.col("file").alias("path")).distinct().withColumn("hit", F.lit(True))
    rows = files.join(hit, "path", "left").join(worst.withColumnRenamed("file", "path"), "path", "left")
    hit = F.coalesce("hit", F.lit(False))
    level = F.coalesce("level", F.lit("SAFE"))
    both = (F.col("n_changes_a") > 0) & (F.col("n_changes_b") > 0)
    any_side = (F.col("n_changes_a") > 0) | (F.col("n_changes_b") > 0)
    kept = any_side & F.when(both, (level != "SAFE") | hit).otherwise((F.col("status") == "deleted") | hit)
    sure = F.when(~both, F.when(hit, 0.95).otherwise(0.7)).when(hit & (level == "HIGH"), 0.95).when(hit | (level == "HIGH"), 0.8).when(level == "MEDIUM", 0.55).otherwise(0.3)
    return rows.where(kept).select(
        F.col("path").alias("file"),
        F.when(both, level).otherwise("HIGH").alias("overlap_level"),
        hit.alias("has_conflict"),
        (~both | hit | (level == "HIGH")).alias("predicted"),
        sure.alias("confidence"),
        F.when(both, F.coalesce("n_pairs", F.lit(0))).otherwise(0).cast("bigint").alias("n_pairs"),
        F.when(both, F.col("first_b_line")).alias("first_b_line"),
    )


def predict_conflicts(ranges_a: DataFrame, ranges_b: DataFrame, files_a: DataFrame, files_b: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Keys, risk, score, level of the files that both sides changed. Further keys (a branch) sweep many pairs in one plan."""
    shared = files_b.select(*keys).distinct().join(files_a.select(*keys).distinct(), list(keys), "left_semi")
    worst = worst_levels(overlaps(ranges_a, ranges_b, keys), keys).select(*keys, "level")
    high = F.coalesce(F.col("level") == "HIGH", F.lit(False))
    return shared.join(worst, list(keys), "left").select(*keys, F.when(high, "HIGH_RISK").otherwise("LOW_RISK").alias("risk"), F.when(high, 60).otherwise(10).alias("score"), F.when(high, "HIGH").otherwise("LOW").alias("level"))


def other_branches(local: DataFrame, remote: DataFrame, current: str, main: str = "main") -> DataFrame:
    """Distinct names of the branches to sweep (local and remote names are left out by different rules)."""
    name = F.col("short_name")
    here = local.where((name != current) & (name != main))
    there = remote.where((name != current) & (name != main) & ~F.contains(name, F.lit("HEAD")) & ~F.endswith(name, F.lit("/" + current)) & ~F.endswith(name, F.lit("/" + main)))
    return here.select("short_name").union(there.select("short_name")).distinct()


def alerts(predicted: DataFrame, current: str) -> DataFrame:
    """A message for each file and branch."""
    text = F.format_string(ALERT, F.col("file"), F.lit(current), F.col("branch"), F.col("risk"))
    return predicted.withColumn("message", text)


def file_scores(candidates: DataFrame) -> DataFrame:
    """file, score, factors (joined by '; ') of each candidate."""
    n, level = F.col("n_pairs"), F.col("overlap_level")
    score = pick(level, LEVEL_POINTS, 0) + F.when(F.col("has_conflict"), CONFLICT_POINTS).otherwise(0) + F.when(n > 2, MANY_POINTS).when(n > 1, TWO_POINTS).otherwise(0)
    reasons = F.array(
        pick(level, LEVEL_REASONS),
        F.when(F.col("has_conflict"), CONFLICT_REASON),
        F.when(n > 2, F.format_string(MANY_REASON, n)).when(n > 1, TWO_REASON),
    )
    return candidates.select("file", F.least(score, F.lit(100)).cast("int").alias("score"), F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; ").alias("factors"))
