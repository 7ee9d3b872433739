"""A call graph whose lists are kept in pages of bounded size.

Rows: call sites (``called_function``, ``caller_file``, ``line``, and whatever
else is a key). All sites of a function, in order of file and line, are cut
into pages of at most ``PAGE`` different sites; a page knows its first and last
site, so these columns alone are the directory. No row grows with a function's
number of callers, and no task holds all of them: sites are put in order by
ranges over the cluster, and only one row for each range and function is
summed up to say where a range starts.

Defined results: sites that come several times are one entry with ``times``;
rows without a function, a file or a line are left out; an empty table gives no
pages; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riftscan.functions.lineage import cut

PAGE = 1024
#: Folders of a stored graph; a function's pages are in one of them.
BUCKETS = 256

SITE = ("caller_file", "line")
DIRECTORY = ("page", "first_file", "first_line", "last_file", "last_line", "n_sites", "n_calls")


def call_pages(calls: DataFrame, keys: tuple[str, ...] = ("called_function",), page: int = PAGE) -> DataFrame:
    """keys, page, first_file, first_line, last_file, last_line, n_sites, n_calls, sites (caller_file, line, times)."""
    known = calls.dropna(subset=[*keys, *SITE])
    counted = known.groupBy(*keys, *SITE).agg(F.count("*").alias("times"))
    # Which range a row is in must be one and the same for its count and its place: it is written once.
    placed = cut(counted.repartitionByRange(*keys, *SITE).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(*keys, "part").agg(F.count("*").alias("n")).select(*keys, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*SITE)) - 1
    paged = placed.withColumn("nth", nth).join(first, [*keys, "part"]).withColumn("page", F.floor((F.col("first") + F.col("nth")) / page))
    site = F.struct(*SITE, "times")
    found = paged.groupBy(*keys, "page").agg(F.sort_array(F.collect_list(site)).alias("sites"), F.sum("times").alias("n_calls"))
    ends = {"first": F.col("sites")[0], "last": F.element_at("sites", -1)}
    named = [end[c].alias(f"{name}_{short}") for name, end in ends.items() for c, short in (("caller_file", "file"), ("line", "line"))]
    return found.select(*keys, "page", *named, F.size("sites").cast("bigint").alias("n_sites"), "n_calls", "sites")


def directory(pages: DataFrame) -> DataFrame:
    """The pages without their lists."""
    return pages.drop("sites")


def bucket_of(function: Column) -> Column:
    return F.pmod(F.xxhash64(function), F.lit(BUCKETS)).cast("int")


def write_graph(pages: DataFrame, path: str) -> None:
    """Store pages so that a lookup reads one folder, and there only what holds the function.

    A folder's pages are dealt by (function, page), so that a function with very
    many of them is written by many tasks.
    """
    rows = pages.withColumn("bucket", bucket_of(F.col("called_function")))
    rows.repartitionByRange("bucket", "called_function", "page").sortWithinPartitions("bucket", "called_function", "page").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, function: str, file: str | None = None) -> DataFrame:
    """Stored pages of a function; with ``file`` only those that its sites can be in."""
    bucket = spark.range(1).select(bucket_of(F.lit(function))).first()[0]
    pages = spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("called_function") == function)).drop("bucket")
    if file is not None:
        pages = pages.where((F.col("first_file") <= file) & (F.col("last_file") >= file))
    return pages


def sites(pages: DataFrame) -> DataFrame:
    """The call sites of pages, as rows."""
    keys = [c for c in pages.columns if c not in (*DIRECTORY, "sites")]
    return pages.select(*keys, F.explode("sites").alias("site")).select(*keys, "site.*")


def stale(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """scope, pass_ord, the change, page and its stale sites, for pages with the keys ref and called_function."""
    changed = changes.where("change_type = 'signature_change'").drop("change_type")
    cross = F.col("branch") != F.col("ref")
    left = F.when(cross, F.col("sites")).otherwise(F.filter("sites", lambda s: s["caller_file"] != F.col("file")))
    pairs = changed.join(pages.select("ref", "called_function", "page", "sites"), F.col("name") == F.col("called_function"))
    order = F.when(cross, 0).otherwise(2) + F.when(F.col("branch") == "A", 0).otherwise(1)
    return pairs.select(F.when(cross, "cross-branch").otherwise("intra-branch").alias("scope"), order.alias("pass_ord"), *changed.columns, "page", left.alias("sites")).where(F.size("sites") > 0)


def stale_conflicts(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """Changes with stale callers as ``semantic.semantic_conflicts`` finds them, with a digest in place of the list.

    scope, branch, name, file, old_params, new_params, n_calls, digest. Of
    conflicts with the same sites the first pass wins; sites are compared by
    their number and 128 bits.
    """
    def bits(k: int) -> Column:
        return F.aggregate("sites", F.lit(0).cast("bigint"), lambda acc, s: acc.bitwiseXOR(F.xxhash64(F.lit(k), s["caller_file"], s["line"], s["times"])))

    calls = F.aggregate("sites", F.lit(0).cast("bigint"), lambda acc, s: acc + s["times"])
    change = ["branch", "old_params", "new_params"]
    pages_of = stale(changes, pages).select("scope", "pass_ord", *change, "name", "file", calls.alias("calls"), bits(1).alias("d1"), bits(2).alias("d2"))
    found = pages_of.groupBy("scope", "pass_ord", *change, "name", "file").agg(F.sum("calls").alias("n_calls"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    first = found.groupBy("scope", "name", "file", "n_calls", "d1", "d2").agg(F.min(F.struct("pass_ord", *change)).alias("first"))
    return first.select("scope", "first.branch", "name", "file", "first.old_params", "first.new_params", "n_calls", F.concat(F.hex("d1"), F.lit("-"), F.hex("d2")).alias("digest"))


def stale_pages(conflicts: DataFrame, changes: DataFrame, pages: DataFrame) -> DataFrame:
    """scope, branch, name, file, page, sites: the stale call sites of conflicts, a page in a row."""
    kept = conflicts.select("scope", "branch", "name", "file")
    return stale(changes, pages).join(kept, ["scope", "branch", "name", "file"], "left_semi").select("scope", "branch", "name", "file", "page", "sites")
