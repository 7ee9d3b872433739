"""Renames: which added file is which deleted one, by what their lines share.

Files are rows of lines (``path``, ``line``, ``content``). Two files are as
similar as the bytes of the lines that they share (each as often as both have
it) are of the larger one's. Files of equal content are one class. A line is
looked up in an inverted index, of which only each class's rarest lines are
kept: of lines in the order of how many classes hold them, the rest of a class
must be too little to reach the least similarity alone. Two classes that reach
it then share one of the kept lines, so no pair is lost, none without a shared
line is compared, and lines that very many files hold are hardly ever in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftscan.functions.lineage import cut

#: Least similarity in percent.
SIMILAR = 90
#: Parts in which the files of one class are numbered, so that many copies need not meet in one task.
PARTS = 256


def content_classes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, key, size) and classes (key, rep, copies, size) of equal lines in equal order; rep is the least path."""
    size = (F.octet_length("content") + 1).cast("bigint")
    place = [F.bit_xor(F.xxhash64(F.lit(salt), "line", "content")) for salt in (1, 2)]
    files = lines.groupBy("path").agg(*[p.alias(f"h{i}") for i, p in enumerate(place)], F.count("*").alias("n"), F.sum(size).alias("size"))
    files = files.select("path", F.struct("h0", "h1", "n", "size").alias("key"), "size")
    return files, files.groupBy("key").agg(F.min("path").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"))


def chunks(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, size, chunk, weight: each different line of each class, with its bytes as often as it comes."""
    held = lines.join(classes.select(F.col("rep").alias("path"), "size"), "path")
    return held.groupBy(F.col("path").alias("rep"), "size", F.unhex(F.md5("content")).alias("chunk")).agg(F.sum((F.octet_length("content") + 1).cast("bigint")).alias("weight"))


def rarest(held: DataFrame, frequency: DataFrame, least: int) -> DataFrame:
    """Of each class the rarest lines, down to where the rest is too little."""
    before = Window.partitionBy("rep").orderBy("classes", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    return held.join(frequency, "chunk").withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0))).where(100 * (F.col("size") - F.col("before")) >= least * F.col("size")).select("rep", "size", "chunk")


def reaches(a: Column, b: Column, shared: Column, least: int) -> Column:
    return 100 * shared >= least * F.greatest(a, b)


def similar_classes(old: DataFrame, new: DataFrame, old_classes: DataFrame, new_classes: DataFrame, least: int = SIMILAR) -> DataFrame:
    """old_rep, new_rep, score of all pairs of classes of at least that similarity."""
    sides = {"old": cut(chunks(old, old_classes)), "new": cut(chunks(new, new_classes))}
    frequency = reduce(DataFrame.unionByName, [s.select("chunk") for s in sides.values()]).groupBy("chunk").agg(F.count("*").alias("classes"))
    kept = {k: rarest(s, frequency, least).withColumnsRenamed({"rep": f"{k}_rep", "size": f"{k}_size"}) for k, s in sides.items()}
    pairs = kept["old"].join(kept["new"], "chunk").where(reaches(F.col("old_size"), F.col("new_size"), F.least("old_size", "new_size"), least)).select("old_rep", "new_rep", "old_size", "new_size").distinct()
    left = sides["old"].select(F.col("rep").alias("old_rep"), "chunk", F.col("weight").alias("old_weight"))
    right = sides["new"].select(F.col("rep").alias("new_rep"), "chunk", F.col("weight").alias("new_weight"))
    scored = pairs.join(left, "old_rep").join(right, ["new_rep", "chunk"]).groupBy("old_rep", "new_rep", "old_size", "new_size").agg(F.sum(F.least("old_weight", "new_weight")).alias("shared"))
    score = F.floor(100 * F.col("shared") / F.greatest("old_size", "new_size")).cast("int")
    return scored.where(reaches(F.col("old_size"), F.col("new_size"), F.col("shared"), least)).select("old_rep", "new_rep", score.alias("score"))


def assign(pairs: DataFrame) -> DataFrame:
    """old_rep, new_rep, rank, n, old_from, new_from: copies of classes given to one another, best pairs first.

    ``pairs`` has old_rep, new_rep, rank (less is better; ties by the paths)
    and the sides' copies. What taking pairs one by one in this order gives is
    found for all pairs at once that are the best of both their sides; each
    round takes these. Rounds are as many as pairs that wait for one another
    in a row.
    """
    best = F.struct("rank", "old_rep", "new_rep")
    left = cut(pairs.select("old_rep", "new_rep", "rank", F.col("old_copies").alias("old_left"), F.col("new_copies").alias("new_left"), F.lit(0).cast("bigint").alias("old_from"), F.lit(0).cast("bigint").alias("new_from")))
    taken = []
    while not left.isEmpty():
        of_old = left.groupBy("old_rep").agg(F.min(best).alias("old_best"))
        of_new = left.groupBy("new_rep").agg(F.min(best).alias("new_best"))
        both = left.join(of_old, "old_rep").join(of_new, "new_rep").where((F.col("old_best") == best) & (F.col("new_best") == best))
        now = cut(both.select("old_rep", "new_rep", "rank", F.least("old_left", "new_left").alias("n"), "old_from", "new_from"))
        taken.append(now)
        rest = left.join(now.select("old_rep", "new_rep"), ["old_rep", "new_rep"], "left_anti")
        rest = rest.join(now.select("old_rep", F.col("n").alias("a")), "old_rep", "left").join(now.select("new_rep", F.col("n").alias("b")), "new_rep", "left")
        a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
        left = cut(rest.where((F.col("old_left") > a) & (F.col("new_left") > b)).select("old_rep", "new_rep", "rank", (F.col("old_left") - a).alias("old_left"), (F.col("new_left") - b).alias("new_left"), (F.col("old_from") + a).alias("old_from"), (F.col("new_from") + b).alias("new_from")))
    return reduce(DataFrame.unionByName, taken) if taken else left.select("old_rep", "new_rep", "rank", F.col("old_left").alias("n"), "old_from", "new_from")


def numbered(files: DataFrame, classes: DataFrame, side: str) -> DataFrame:
    """The files of each class with their number in it, from 0."""
    rows = files.join(classes.select("key", "rep"), "key").select("rep", "path", F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part"))
    before = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("rep", "part").agg(F.count("*").alias("n")).select("rep", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("rep", "part").orderBy("path")) - 1
    return rows.withColumn("nth", nth).join(parts, ["rep", "part"]).select(F.col("rep").alias(f"{side}_rep"), F.col("path").alias(f"{side}_path"), (F.col("first") + F.col("nth")).alias(f"{side}_nth"))


def renames(old: DataFrame, new: DataFrame, least: int = SIMILAR) -> DataFrame:
    """old_path, new_path, score: each deleted file with at most one added file, and the other way round.

    Files of equal content come first (score 100), then the most similar, ties
    by the least path of each content. Lines without a path or content are left
    out; an empty file is one with an empty line, or it has no row and no
    rename; other columns are ignored.
    """
    old, new = (x.where("path is not null and content is not null").select("path", "line", "content") for x in (old, new))
    (old_files, old_classes), (new_files, new_classes) = ((f, cut(c)) for f, c in map(content_classes, (old, new)))
    pairs = similar_classes(old, new, old_classes, new_classes, least)
    sides = pairs.join(old_classes.select(F.col("rep").alias("old_rep"), F.col("key").alias("old_key"), F.col("copies").alias("old_copies")), "old_rep")
    sides = sides.join(new_classes.select(F.col("rep").alias("new_rep"), F.col("key").alias("new_key"), F.col("copies").alias("new_copies")), "new_rep")
    rank = F.when(F.col("old_key") == F.col("new_key"), -1).otherwise(100 - F.col("score"))
    given = assign(sides.withColumn("rank", rank))
    each = given.where("n > 0").select("old_rep", "new_rep", F.least(F.lit(100), 100 - F.col("rank")).cast("int").alias("score"), "old_from", "new_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    each = each.withColumn("old_nth", F.col("old_from") + F.col("i")).withColumn("new_nth", F.col("new_from") + F.col("i"))
    found = each.join(numbered(old_files, old_classes, "old"), ["old_rep", "old_nth"]).join(numbered(new_files, new_classes, "new"), ["new_rep", "new_nth"])
    return found.select("old_path", "new_path", "score")
