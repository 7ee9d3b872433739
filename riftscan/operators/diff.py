"""Row-generating operators over diff text.

Each takes one row for each diff (``diff_id``, ``raw``), or with ``_of`` in its
name the lines of diffs (``diff_id``, ``pos``, ``line``), as a file too large
for one row gives them. A diff's lines are cut into segments of positions. What
the lines mean is a state that each segment changes in a way that can be told
before the state is known, so segments are scanned side by side, and only one
row for each of them is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftscan.functions.scans import SEGMENT
from riftscan.functions.text import strip_bom, trim_all

# Line beginnings that carry no content.
METADATA = ("index ", "new file mode", "deleted file mode", "old mode", "new mode", "similarity index", "rename from", "rename to", "Binary files")
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
LOOSE_HUNK = r"^@@\s+-\d+(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@"


def starts(line: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(line, F.lit(h))
    return out


def lines_of(diffs: DataFrame, raw: Column | None = None) -> DataFrame:
    return diffs.select("diff_id", F.posexplode(F.split(F.col("raw") if raw is None else raw, "\n")).alias("pos", "line"))


def added_lines(diffs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """diff_id, file, line, content, seq of each added line, numbered on the new side."""
    return added_lines_of(lines_of(diffs.where("raw is not null")), segment)


def added_lines_of(lines: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``added_lines`` of lines (diff_id, pos, line).

    A line's number is that of the last line that sets one (a file's or path's
    header: 0; a hunk's header; the first added line of a part that names no
    file: 1) and the added and context lines since. Whether an added line is
    such a first one is the only thing that a segment can't tell alone: it is
    kept as a candidate, at most one for each segment.
    """
    line = F.col("line")
    header = line.rlike(r"^diff --git a/(.*) b/(.*)$")
    kind = (
        F.when(header, "file")
        .when(starts(line, "+++ b/"), "path")
        .when(starts(line, "+++ /dev/null"), "none")
        .when(starts(line, "--- "), "skip")
        .when(line.rlike(LOOSE_HUNK), "hunk")
        .when(starts(line, *METADATA), "skip")
        .when(starts(line, "+++ "), "skip")
        .when(starts(line, "+"), "add")
        .when(starts(line, "-", "\\"), "skip")
        .otherwise("context")
    )
    # lines without any effect need not be moved, but for those that count as steps
    rows = lines.withColumn("kind", kind).where("kind <> 'skip'").withColumn("part", F.floor(F.col("pos") / segment))
    is_add = F.col("kind") == "add"
    name = F.when(F.col("kind") == "file", F.regexp_extract("line", r"^diff --git a/(.*) b/(.*)$", 2)).when(F.col("kind") == "path", F.substring("line", 7, 1 << 30))
    rows = rows.select(
        "diff_id",
        "part",
        "pos",
        "kind",
        F.when(F.col("kind").isin("file", "path", "none"), F.struct(name.alias("named"))).alias("opens"),
        F.when(F.col("kind").isin("file", "path"), 0).when(F.col("kind") == "hunk", F.regexp_extract("line", LOOSE_HUNK, 1).cast("bigint")).alias("sets"),
        F.when(is_add, F.substring("line", 2, 1 << 30)).alias("content"),
        is_add.cast("bigint").alias("adds"),
        F.col("kind").isin("add", "context").cast("bigint").alias("steps"),
    )
    in_order = Window.partitionBy("diff_id", "part").orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("adds_at", F.sum("adds").over(so_far) - F.col("adds")).withColumn("steps_at", F.sum("steps").over(so_far) - F.col("steps"))
    opened = F.when(F.col("opens").isNotNull(), F.struct(F.col("opens.named").alias("named"), F.col("adds_at").alias("adds")))
    rows = rows.withColumn("open", F.last(opened, ignorenulls=True).over(so_far))
    first_of_unnamed = (F.col("kind") == "add") & F.col("open").isNotNull() & F.col("open.named").isNull() & (F.col("adds_at") == F.col("open.adds"))
    in_doubt = (F.col("kind") == "add") & F.col("open").isNull() & (F.col("adds_at") == 0)
    sets = F.when(first_of_unnamed, F.lit(1)).otherwise(F.col("sets")).cast("bigint")
    based = F.struct(F.col("pos"), sets.alias("base"), F.col("steps_at").alias("steps"))
    rows = rows.withColumn("based", F.when(sets.isNotNull(), based)).withColumn("doubt", F.when(in_doubt, F.struct(F.col("pos"), F.lit(1).cast("bigint").alias("base"), F.col("steps_at").alias("steps"))))

    parts = rows.groupBy("diff_id", "part").agg(
        F.sum("adds").alias("adds"), F.sum("steps").alias("steps"), F.max_by("open", "pos").alias("open"), F.max("based").alias("based"), F.max("doubt").alias("doubt")
    )
    before = Window.partitionBy("diff_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("adds_in", F.coalesce(F.sum("adds").over(before), F.lit(0))).withColumn("steps_in", F.coalesce(F.sum("steps").over(before), F.lit(0)))
    carried_open = F.when(F.col("open").isNotNull(), F.struct(F.col("open.named").alias("named"), (F.col("adds_in") + F.col("open.adds")).alias("adds")))
    parts = parts.withColumn("open_in", F.last(carried_open, ignorenulls=True).over(before))
    holds = F.col("open_in.named").isNull() & (F.col("adds_in") == F.coalesce(F.col("open_in.adds"), F.lit(0)))
    parts = parts.withColumn("doubt", F.when(holds, F.col("doubt")))
    end = F.greatest("based", "doubt")
    parts = parts.withColumn("end", F.when(end.isNotNull(), F.struct(end["base"].alias("base"), (F.col("steps_in") + end["steps"]).alias("steps"))))
    parts = parts.select("diff_id", "part", "steps_in", "open_in", "doubt", F.last("end", ignorenulls=True).over(before).alias("end_in"))

    # a part's last line that sets a number so far, in the segment or before it
    rows = rows.withColumn("based", F.last("based", ignorenulls=True).over(so_far)).where("kind = 'add'").drop("doubt").join(parts, ["diff_id", "part"])
    own = F.when(F.col("open").isNotNull(), F.col("open.named")).otherwise(F.col("open_in.named"))
    local = F.greatest("based", F.when(F.col("doubt.pos") <= F.col("pos"), F.col("doubt")))
    number = F.coalesce(local["base"] + F.col("steps_at") - local["steps"], F.col("end_in.base") + F.col("steps_in") + F.col("steps_at") - F.col("end_in.steps"))
    return rows.select("diff_id", F.coalesce(own, F.lit("unknown_file")).alias("file"), number.cast("int").alias("line"), "content", F.col("pos").alias("seq"))


def body_path(body: Column) -> Column:
    """The new path that a section's body names, or /dev/null; null if it names none."""
    found = F.nullif(F.regexp_extract(body, r"(?m)^\+\+\+ (b/[^\n]*|/dev/null)", 1), F.lit(""))
    return F.when(found == "/dev/null", found).otherwise(trim_all(F.substring(found, 3, 1 << 30)))


def changed_ranges(diffs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """diff_id, path, seq, start_line, line_count, end_line, change_type.

    A path without ranges (a binary file) has one row with null ranges. A
    binary section takes back the ranges of earlier sections of its path.
    """
    known = diffs.where("raw is not null")
    return changed_ranges_of(lines_of(known), segment, lines_of(known.where(F.length("raw") >= segment)))


def changed_ranges_of(lines: DataFrame, segment: int = SEGMENT, reaching: DataFrame | None = None) -> DataFrame:
    """``changed_ranges`` of lines (diff_id, pos, line).

    Every line that counts goes to the last file and hunk headers of its
    segment, as a few marks without its text; the rest is aggregates by section
    and hunk, which combine before they are shuffled. Headers of earlier
    segments are put to those aggregates, from one row for each segment after
    a diff's first (these are broadcast). ``reaching``: the lines of all diffs
    that go beyond one segment, if that is known (by default all lines). The
    hunks of one path of a diff meet in one task.
    """
    rows = hunk_marks(lines, segment)
    within = Window.partitionBy("diff_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.last(n, ignorenulls=True).over(within) for n in ("file", "hunk")})
    flags = lambda: [F.max("head").alias("head"), *[F.bool_or(c).alias(c) for c in ("plus", "minus", "is_binary")]]
    rows = rows.groupBy("diff_id", "part", "file", "hunk").agg(*flags())
    # positions rise, so the last mark before a segment is the greatest
    before = Window.partitionBy("diff_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = hunk_marks(lines if reaching is None else reaching, segment).groupBy("diff_id", "part").agg(F.max("file").alias("file"), F.max("hunk").alias("hunk"))
    carry = ends.select("diff_id", "part", F.max("file").over(before).alias("file_in"), F.max("hunk").over(before).alias("hunk_in")).where("file_in is not null or hunk_in is not null")
    rows = rows.join(F.broadcast(carry), ["diff_id", "part"], "left").withColumn("file", F.coalesce("file", "file_in")).withColumn("hunk", F.coalesce("hunk", "hunk_in"))
    rows = rows.where("file is not null and file.path <> '' and file.path <> '/dev/null'")
    rows = rows.groupBy("diff_id", "file.path", "file.section", F.when(F.col("hunk") > F.col("file.section"), F.col("hunk")).alias("hunk")).agg(*flags())
    # by path: its last binary section, and whether any range is left
    of_path = Window.partitionBy("diff_id", "path")
    rows = rows.withColumn("last_binary", F.coalesce(F.max(F.when(F.col("is_binary"), F.col("section"))).over(of_path), F.lit(-1)))
    rows = rows.withColumn("left", F.col("hunk").isNotNull() & F.col("head").isNotNull() & (F.col("section") > F.col("last_binary")))
    at = F.struct("section", "hunk")
    rows = rows.withColumn("any_left", F.bool_or("left").over(of_path)).withColumn("is_first", F.min(at).over(of_path).eqNullSafe(at))
    rows = rows.where(F.col("left") | (~F.col("any_left") & F.col("is_first")))
    count, first = F.col("head.count"), F.col("head.first")
    kind = F.when(count == 0, "removed").when(F.col("plus") & F.col("minus"), "modified").when(F.col("plus"), "added").when(F.col("minus"), "removed").otherwise("modified")
    fields = {
        "seq": F.col("head.pos"),
        "start_line": F.when(count == 0, F.greatest(F.lit(1), first)).otherwise(first),
        "line_count": count,
        "end_line": F.when(count == 0, F.greatest(F.lit(1), first)).otherwise(first + count - 1),
        "change_type": kind,
    }
    return rows.select("diff_id", "path", *[F.when(F.col("left"), x).alias(n) for n, x in fields.items()])


def hunk_marks(lines: DataFrame, segment: int) -> DataFrame:
    """diff_id, part, pos and what a line tells of files and hunks, of the lines that tell something."""
    line = F.when(F.col("pos") == 0, strip_bom(F.col("line"))).otherwise(F.col("line"))
    rows = lines.select("diff_id", "pos", line.alias("line"))
    line = F.col("line")
    is_header, opens = F.startswith(line, F.lit("diff --git ")), F.startswith(line, F.lit("@@"))
    path = trim_all(F.regexp_extract("line", r"diff --git a/.+ b/(.+)$", 1))
    is_hunk = opens & line.rlike(HUNK)
    shown = F.when(is_hunk, F.regexp_replace("line", HUNK, "")).otherwise(line)
    count = F.coalesce(F.nullif(F.regexp_extract("line", HUNK, 4), F.lit("")).cast("int"), F.lit(1))
    first = F.regexp_extract("line", HUNK, 3).cast("int")
    marks = rows.select(
        "diff_id",
        F.floor(F.col("pos") / segment).alias("part"),
        "pos",
        F.when(is_header, F.struct(F.col("pos").alias("section"), path.alias("path"))).alias("file"),
        F.when(opens, F.col("pos")).alias("hunk"),
        F.when(is_hunk, F.struct("pos", first.alias("first"), count.alias("count"))).alias("head"),
        (F.startswith(shown, F.lit("+")) & ~F.startswith(shown, F.lit("+++"))).alias("plus"),
        (F.startswith(shown, F.lit("-")) & ~F.startswith(shown, F.lit("---"))).alias("minus"),
        (~is_header & (F.contains(line, F.lit("Binary files")) | F.contains(line, F.lit("GIT binary patch")))).alias("is_binary"),
    )
    return marks.where("file is not null or hunk is not null or plus or minus or is_binary")


def name_status(outputs: DataFrame) -> DataFrame:
    """diff_id, seq, path, old_path, status, is_binary of each well-formed line of name-status text."""
    rows = lines_of(outputs.where("raw is not null"), trim_all(F.col("raw"))).where(trim_all(F.col("line")) != "")
    parts = F.split("line", r"\t+")
    code = F.upper(F.get(parts, F.lit(0)))
    moved = F.startswith(code, F.lit("R")) | F.startswith(code, F.lit("C"))
    status = F.when(F.startswith(code, F.lit("R")), "renamed").when(F.startswith(code, F.lit("C")), "copied").when(code == "A", "added").when(code == "M", "modified").when(code == "D", "deleted").otherwise("unknown")
    return rows.where((F.size(parts) >= 2) & (~moved | (F.size(parts) >= 3))).select(
        "diff_id",
        F.col("pos").alias("seq"),
        F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
        F.when(moved, F.get(parts, F.lit(1))).alias("old_path"),
        status.alias("status"),
        F.lit(False).alias("is_binary"),
    )


def conflicting_paths(outputs: DataFrame) -> DataFrame:
    """diff_id, file: the distinct paths that merge-tree text lists."""
    line = F.col("file")
    noise = line.rlike(r"(?i)\A[0-9a-f]{40}\z") | starts(line, "Command failed", "fatal:", "error:", "warning:") | F.contains(line, F.lit("failed with exit code")) | F.contains(line, F.lit("git merge-tree"))
    rows = outputs.where("raw is not null").select("diff_id", F.explode(F.split("raw", "\r?\n")).alias("line")).select("diff_id", trim_all(F.col("line")).alias("file"))
    return rows.where((line != "") & ~noise).distinct()


def from_parsed(entries: DataFrame) -> DataFrame:
    """file, line, content of entries that were parsed before (file, addedLines); malformed ones are dropped."""
    good = entries.where("file is not null and file <> '' and addedLines is not null")
    return good.select("file", F.posexplode("addedLines").alias("seq", "x")).select("file", F.col("x.lineNumber").alias("line"), F.col("x.content").alias("content"), "seq")


def surrounding(lines: DataFrame, reach: int = 3) -> DataFrame:
    """``lines`` with the contents of up to ``reach`` added lines before and after, in order."""
    near = Window.partitionBy("file").orderBy("line", "content").rowsBetween(-reach, reach)
    return lines.withColumn("surrounding", F.collect_list("content").over(near))
