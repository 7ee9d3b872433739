"""Line diff of two versions of many files, and three-way merges, on tables of lines.

A version is a table (keys, line, content) with lines numbered from 1. All
files are compared in one plan. Each round works on the lines of *gaps*, the
stretches between matched lines, of both versions:

1. the common beginning and end of a gap are matched (by offset, one
   aggregation for each side);
2. lines that occur once on each side are anchors (patience); a gap without
   such lines pairs the first occurrences of each line, the second ones and so on;
3. of a gap's anchors the heaviest chain that rises on both sides is kept;
4. what is left between chosen anchors are the next round's gaps.

Gaps of at most ``SMALL`` lines are compared whole, inside the tasks they are
dealt to, by the shortest edit script (Myers).

Lines are joined and aggregated by gap and content; no two lines are compared
that don't have their content or their offset in common. Rounds end when no
gap has a common line, so their number grows with how often changes nest, not
with the files' length. Files are spread by gap and content or segment, not
file by file; only a gap's anchors meet in one task, joined to runs of
neighbouring lines as they are read (24 bytes for each run, of which there are
about as many as changes).

Lines are equal if the MD5 of their contents is; a null content is a line of
its own that equals other nulls.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftscan.functions.lineage import cut
from riftscan.functions.scans import carried, carried_all
from riftscan.functions.workers import importable

OLD, NEW = 0, 1
#: Lines of both versions of a gap that a task compares by itself.
SMALL = 256
CONTEXT = 3


def rising(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of disjoint runs (a, b, length), in order of a, the heaviest chain in which b rises too."""
    if len(runs) < 2:
        return runs
    starts = sorted(b for _, b, _ in runs)
    tree: list[tuple[int, int]] = [(0, -1)] * (len(runs) + 1)  # greatest (weight, run) of a prefix of b, by a Fenwick tree
    before, best = [-1] * len(runs), (0, -1)
    for k, (_, b, n) in enumerate(runs):
        at = place = bisect_left(starts, b)
        top = (0, -1)
        while at:
            top = max(top, tree[at])
            at &= at - 1
        before[k] = top[1]
        here = (top[0] + n, k)
        best = max(best, here)
        at = place + 1
        while at <= len(runs):
            tree[at] = max(tree[at], here)
            at += at & -at
    chain, k = [], best[1]
    while k >= 0:
        chain.append(runs[k])
        k = before[k]
    return chain[::-1]


def shortest(x: list, y: list) -> list[tuple[int, int, int]]:
    """Runs (from, from, length) of equal items along a shortest edit script of two short lists."""
    reach, trail = {1: 0}, []
    for d in range(len(x) + len(y) + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while i < len(x) and i - k < len(y) and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= len(x) and i - k >= len(y):
                break
        else:
            continue
        break
    runs, i, j = [], len(x), len(y)
    for d in range(len(trail) - 1, -1, -1):
        k, v = i - j, trail[d]
        back = k + 1 if k == -d or (k != d and v[k - 1] < v[k + 1]) else k - 1
        pi = v[back]
        pj = pi - back
        start = (pi, pj + 1) if back == k + 1 else (pi + 1, pj)
        if d == 0:
            start = (0, 0)
        if i > start[0]:
            runs.append((start[0], start[1], i - start[0]))
        i, j = pi, pj
    return runs[::-1]


def scanned(rows: DataFrame, keys: list[str], order: list, step) -> DataFrame:
    """keys, a, b, n: the runs that ``step`` finds in each gap, whose rows are read in ``order``.

    ``step(gap)`` returns (add, finish): ``add`` takes the columns after the
    gap's, ``finish`` returns the gap's runs. Gaps are dealt over the cluster,
    by an expression: an exchange by the columns of a join below would be left
    out, and the join's own is read by mapper once it turns into a broadcast
    join, which tears gaps apart.
    """
    gap = [*keys, "ga", "gb"]
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    names = [*gap, "a", "b", "n"]
    schema = ", ".join(f"`{k}` {t}" for k, t in zip(names, [*kinds, *["bigint"] * 5]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, add, finish, out, types = None, None, None, [], []

        def table() -> pa.RecordBatch:
            cells = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names)

        for batch in batches:
            types = types or [*[batch.schema.field(k).type for k in range(len(gap))], *[pa.int64()] * 3]
            columns = [c.to_pylist() for c in batch.columns]
            for here, cells in zip(zip(*columns[: len(gap)]), zip(*columns[len(gap) :])):
                if here != now:
                    if finish:
                        out.extend((*now, *r) for r in finish())
                    now = here
                    add, finish = step(here)
                add(*cells)
            if out:
                yield table()
        if finish:
            out.extend((*now, *r) for r in finish())
        if out:
            yield table()

    importable(rows.sparkSession)
    return rows.repartition(F.xxhash64(*gap)).sortWithinPartitions(*gap, *order).mapInArrow(of, schema)


def chained(gap: tuple):
    """Keeps the heaviest rising chain of a gap's anchors (alone, a, b), in order of a, those that occur once first."""
    runs: list[tuple[int, int, int]] = []
    kind: list[bool] = []

    def add(alone: bool, a: int, b: int) -> None:
        if not kind:
            kind.append(alone)
        if alone != kind[0]:  # with lines that occur once the others don't count
            return
        if runs and runs[-1][0] + runs[-1][2] == a and runs[-1][1] + runs[-1][2] == b:
            runs[-1] = (runs[-1][0], runs[-1][1], runs[-1][2] + 1)
        else:
            runs.append((a, b, 1))

    return add, lambda: rising(runs)


def compared(gap: tuple):
    """Compares a small gap whole (side, line, h)."""
    sides: tuple[list, list] = ([], [])
    return (lambda side, line, h: sides[side].append(h)), (lambda: [(gap[-2] + i + 1, gap[-1] + j + 1, n) for i, j, n in shortest(*sides)])


def digest() -> Column:
    """What tells contents apart; a null is none of them."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("+"), "content"), F.lit("-"))))


def matches(old: DataFrame, new: DataFrame, keys: list[str], small: int = SMALL) -> DataFrame:
    """keys, a, b, n: runs of n lines from a (old) and from b (new) that are the same and in order."""
    side = lambda df, k: df.select(*keys, F.lit(k).alias("side"), F.lit(0).cast("bigint").alias("ga"), F.lit(0).cast("bigint").alias("gb"), F.col("line").cast("bigint").alias("line"), digest().alias("h"))
    rows = side(old, OLD).unionByName(side(new, NEW))
    gap, found = [*keys, "ga", "gb"], []
    of = lambda k, x: F.when(F.col("side") == k, x)
    while True:
        sizes = rows.groupBy(*gap).agg(F.count_if(F.col("side") == OLD).alias("na"), F.count_if(F.col("side") == NEW).alias("nb"))
        sizes = sizes.where("na > 0 and nb > 0")
        short = rows.join(sizes.where(F.col("na") + F.col("nb") <= small), gap).select(*gap, "side", "line", "h")
        found.append(scanned(short, keys, ["side", "line"], compared).select(*keys, "a", "b", "n"))
        sizes = sizes.where(F.col("na") + F.col("nb") > small)
        both = cut(rows.join(sizes, gap))  # only lines of gaps that take rounds are written
        if both.isEmpty():
            return reduce(DataFrame.unionByName, found)
        both = both.withColumn("k", F.col("line") - of(OLD, F.col("ga")).otherwise(F.col("gb"))).withColumn("e", of(OLD, F.col("na")).otherwise(F.col("nb")) - F.col("k") + 1)

        def common(at: str, name: str) -> DataFrame:
            """Length of a gap's common lines from one of its ends."""
            least = F.least("na", "nb")
            pairs = both.where(F.col(at) <= least).groupBy(*gap, at).agg(F.max(of(OLD, F.col("h"))).alias("x"), F.max(of(NEW, F.col("h"))).alias("y"), F.first(least).alias("least"))
            return pairs.groupBy(*gap).agg(F.coalesce(F.min(F.when(F.col("x") != F.col("y"), F.col(at))) - 1, F.first("least")).alias(name))

        ends = common("k", "head").join(common("e", "tail"), gap).join(sizes, gap).withColumn("tail", F.least("tail", F.least("na", "nb") - F.col("head")))
        ends = cut(ends)
        head = ends.where("head > 0").select(*keys, (F.col("ga") + 1).alias("a"), (F.col("gb") + 1).alias("b"), F.col("head").alias("n"))
        tail = ends.where("tail > 0").select(*keys, (F.col("ga") + F.col("na") - F.col("tail") + 1).alias("a"), (F.col("gb") + F.col("nb") - F.col("tail") + 1).alias("b"), F.col("tail").alias("n"))
        inner = both.join(ends.select(*gap, "head", "tail"), gap).where("k > head and e > tail")
        equal = Window.partitionBy(*gap, "side", "h")
        nth = inner.select(*gap, "side", "h", "line", F.row_number().over(equal.orderBy("line")).alias("nth"), F.count("*").over(equal).alias("m"))
        pairs = nth.groupBy(*gap, "h", "nth").agg(F.max(of(OLD, F.col("line"))).alias("a"), F.max(of(NEW, F.col("line"))).alias("b"), F.max("m").alias("m")).where("a is not null and b is not null")
        runs = cut(scanned(pairs.select(*gap, (F.col("m") == 1).alias("alone"), "a", "b"), keys, [F.desc("alone"), "a"], chained))
        found += [head, tail, runs.select(*keys, "a", "b", "n")]
        if runs.isEmpty():
            return reduce(DataFrame.unionByName, found)
        # Lines of gaps that gained a run, each with the last run that starts at it or before.
        marks = runs.select(*keys, F.explode(F.array(F.struct(F.lit(OLD).alias("side"), F.col("a").alias("line")), F.struct(F.lit(NEW).alias("side"), F.col("b").alias("line")))).alias("m"), F.struct("a", "b", "n").alias("run")).select(*keys, "m.side", "m.line", "run")
        left = inner.join(runs.select(*gap).distinct(), gap, "left_semi").join(marks, [*keys, "side", "line"], "left")
        left = carried(left, [*gap, "side"], "line", F.col("run"), "last")
        start = of(OLD, F.col("last.a")).otherwise(F.col("last.b"))
        left = left.where(F.col("last").isNull() | (F.col("line") >= start + F.col("last.n")))
        after = lambda g, x: F.coalesce(F.col(f"last.{x}") + F.col("last.n") - 1, F.col(g) + F.col("head")).alias(g)
        rows = cut(left.select(*keys, "side", after("ga", "a"), after("gb", "b"), "line", "h"))


def changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("file",), small: int = SMALL) -> DataFrame:
    """keys, old_start, old_count, new_start, new_count of each stretch that differs.

    Starts are the first line of the stretch, also where its count is 0 (it
    stands before that line). A file that only one side has is one change.
    """
    ks = list(keys)
    lengths = lambda df, n: df.groupBy(*ks).agg(F.max("line").cast("bigint").alias(n))
    ends = lengths(old, "na").join(lengths(new, "nb"), ks, "full_outer").select(*ks, (F.coalesce("na", F.lit(0)) + 1).alias("a"), (F.coalesce("nb", F.lit(0)) + 1).alias("b"), F.lit(0).cast("bigint").alias("n"))
    runs = matches(old, new, ks, small).unionByName(ends)
    in_order = Window.partitionBy(*ks).orderBy("a", "b")  # over runs, not lines
    past = lambda x: F.coalesce(F.lag(F.col(x) + F.col("n")).over(in_order), F.lit(1)).cast("bigint")
    gaps = runs.select(*ks, "a", "b", past("a").alias("old_start"), past("b").alias("new_start"))
    return gaps.select(*ks, "old_start", (F.col("a") - F.col("old_start")).alias("old_count"), "new_start", (F.col("b") - F.col("new_start")).alias("new_count")).where("old_count > 0 or new_count > 0")


def applied(old: DataFrame, new: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """keys, line, content of the version that the changes make of ``old``; of ``new`` only the changed lines are read."""
    ks = list(keys)
    found = cut(found)  # read three times below, and a comparison of gaps each time
    # Each old line goes by what the changes before it add and take; changed lines are looked up by their place.
    change = F.struct("old_start", "old_count", "new_start", "new_count")
    starts = found.where("old_count > 0").select(*ks, F.col("old_start").alias("line"), F.lit(None).cast("bigint").alias("shift"), change.alias("change"))
    shifts = found.select(*ks, (F.col("old_start") + F.col("old_count")).alias("line"), (F.col("new_start") + F.col("new_count") - F.col("old_start") - F.col("old_count")).alias("shift"))
    marks = starts.unionByName(shifts, allowMissingColumns=True).groupBy(*ks, "line").agg(F.max("shift").alias("shift"), F.max("change").alias("change"))
    lines = old.select(*ks, F.col("line").cast("bigint").alias("line"), "content")
    rows = carried_all(lines.join(marks, [*ks, "line"], "left"), ks, "line", {"by": F.col("shift"), "at": F.col("change")})
    kept = rows.where(F.col("at").isNull() | (F.col("line") >= F.col("at.old_start") + F.col("at.old_count")))
    kept = kept.select(*ks, (F.col("line") + F.coalesce("by", F.lit(0))).alias("line"), "content")
    put = found.where("new_count > 0").select(*ks, F.explode(F.sequence(F.col("new_start"), F.col("new_start") + F.col("new_count") - 1)).alias("line"))
    return kept.unionByName(put.join(new.select(*ks, F.col("line").cast("bigint").alias("line"), "content"), [*ks, "line"]))


def islands(rows: DataFrame, keys: list[str], start: Column, end: Column, order: list[Column]) -> DataFrame:
    """``rows`` with the number of the island of touching intervals [start, end] that each belongs to."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(start > F.max(end).over(upto), F.lit(True))
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_opens", opens.cast("int")).withColumn("island", F.sum("_opens").over(so_far)).drop("_opens")


def hunks(found: DataFrame, lengths: DataFrame, keys: tuple[str, ...] = ("file",), context: int = CONTEXT) -> DataFrame:
    """keys, start_line, line_count, end_line, change_type: changed ranges of the new version as a unified diff's headers give them.

    Changes with at most twice ``context`` lines between them are one hunk,
    which has ``context`` more lines on both sides as far as the file goes.
    ``lengths``: keys, na, nb (lines of both versions).
    """
    ks = list(keys)
    end = F.col("old_start") + F.col("old_count")
    rows = islands(found, ks, F.col("old_start"), end + 2 * context, [F.col("old_start"), F.col("new_start")])
    each = rows.groupBy(*ks, "island").agg(F.min("new_start").alias("s"), F.max(F.col("new_start") + F.col("new_count")).alias("e"), F.min("old_start").alias("os"), F.bool_or(F.col("new_count") > 0).alias("plus"), F.bool_or(F.col("old_count") > 0).alias("minus"))
    each = each.join(lengths, ks)
    before = F.least(F.lit(context), F.col("os") - 1)
    first, last = F.col("s") - before, F.least(F.col("e") - 1 + context, F.col("nb"))
    count = last - first + 1
    kind = F.when(count == 0, "removed").when(F.col("plus") & F.col("minus"), "modified").when(F.col("plus"), "added").otherwise("removed")
    start = F.when(count == 0, F.greatest(F.lit(1), first - 1)).otherwise(first)
    return each.select(*ks, start.cast("int").alias("start_line"), count.cast("int").alias("line_count"), F.when(count == 0, start).otherwise(last).cast("int").alias("end_line"), kind.alias("change_type"))


def merge_chunks(base: DataFrame, a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """keys, base_start, base_count, status of each changed chunk of a three-way merge.

    Changes of both sides that overlap or touch in the base are one chunk. Its
    status is ``a`` or ``b`` if one side changed it, ``same`` if both made the
    same of it, ``conflict`` if not.
    """
    ks = list(keys)
    both = cut(changes(base, a, keys).withColumn("side", F.lit("a")).unionByName(changes(base, b, keys).withColumn("side", F.lit("b"))))
    end = F.col("old_start") + F.col("old_count")
    rows = islands(both, ks, F.col("old_start"), end, [F.col("old_start"), F.col("old_count"), F.col("side")])
    of = lambda s, x: F.when(F.col("side") == s, x)
    # What a side makes of the chunk: its lines from the first change's start to the last one's end, with base lines around.
    shift = lambda s, f: f(of(s, F.struct("old_start", "old_count", "new_start", "new_count")))
    chunks = rows.groupBy(*ks, "island").agg(F.min("old_start").alias("start"), F.max(end).alias("end"), *[shift(s, f).alias(f"{s}_{n}") for s in "ab" for n, f in (("first", F.min), ("last", F.max))])
    first = lambda s: F.col(f"{s}_first.new_start") - (F.col(f"{s}_first.old_start") - F.col("start"))
    last = lambda s: F.col(f"{s}_last.new_start") + F.col(f"{s}_last.new_count") + (F.col("end") - F.col(f"{s}_last.old_start") - F.col(f"{s}_last.old_count"))
    chunks = cut(chunks.select(*ks, "island", "start", "end", *[F.when(F.col(f"{s}_first").isNotNull(), F.struct(first(s).alias("lo"), last(s).alias("hi"))).alias(s) for s in "ab"]))
    shared = chunks.where("a is not null and b is not null")
    equal_long = (F.col("a.hi") - F.col("a.lo")) == (F.col("b.hi") - F.col("b.lo"))
    texts = shared.where(equal_long)
    # Texts of equal length are compared line by line, by their place in the chunk.
    side = lambda s, df: texts.where(F.col(f"{s}.hi") > F.col(f"{s}.lo")).select(*ks, "island", F.col(f"{s}.lo").alias("lo"), F.explode(F.sequence(F.col(f"{s}.lo"), F.col(f"{s}.hi") - 1)).alias("line")).join(df.select(*ks, F.col("line").cast("bigint").alias("line"), digest().alias("h")), [*ks, "line"]).select(*ks, "island", (F.col("line") - F.col("lo")).alias("at"), "h")
    lines = side("a", a).unionByName(side("b", b)).groupBy(*ks, "island", "at").agg((F.min("h") != F.max("h")).cast("int").alias("n"))
    differ = lines.where("n > 0").select(*ks, "island").distinct().withColumn("differs", F.lit(True))
    status = F.when(F.col("b").isNull(), "a").when(F.col("a").isNull(), "b").when(~equal_long | F.coalesce("differs", F.lit(False)), "conflict").otherwise("same")
    return chunks.join(differ, [*ks, "island"], "left").select(*ks, F.col("start").alias("base_start"), (F.col("end") - F.col("start")).alias("base_count"), status.alias("status"))


def conflicting_files(chunks: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """keys of the files with a chunk in conflict: what ``ranges.conflict_candidates`` takes."""
    return chunks.where("status = 'conflict'").select(*keys).distinct()
