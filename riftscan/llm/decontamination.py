"""Benchmark decontamination (operator 8), in DataFrame functions only.

The windows of the benchmark's items (13 words, or a shorter item as a whole)
form a hash set that is broadcast. Training texts are scanned word window by
word window: the hash of a window's first words looks up the set, and a hit is
verified word by word in the same stage, so neither texts nor windows are
shuffled; only verified hits are. A benchmark of more windows than
``max_windows`` is scanned in several passes of that size, so that what is
broadcast stays bounded.

Words are runs of characters other than ASCII non-alphanumerics after A-Z is
lower-cased; texts and items are folded alike, by A-Z alone, so a window's key
depends on its own words only. Each text is cut into words once; the words go
along with its windows, and verifying a hit looks at that window's words alone,
so a text that is all benchmark takes time in proportion to its length.

Defined results: a null or wordless text has no words, no hits and is clean;
null or wordless items have no windows; an item given twice counts once; a
very long text is scanned like any other; repeated rows get a result each; an
empty table gives an empty result; other columns are ignored by ``scan`` and
kept by ``decontaminate``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import let, packed, running, table, unpacked

WINDOW = 13
#: Words of a window that its look-up key covers.
KEY_WORDS = 4
#: Windows broadcast at once.
MAX_WINDOWS = 500_000
#: A document is contaminated if hit words are at least 1 / SHARE of its words.
SHARE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A-Z lower-cased; a null text is empty."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(F.coalesce(text, F.lit("")))


def split_words(text: Column, gap: str = GAP) -> Column:
    """Words of a folded text; only the first and last part can be empty."""

    def inner(parts: Column) -> Column:
        head = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, head + 1, F.size(parts) - head - tail)

    return let(F.split(text, gap), inner)


def n_words(text: Column) -> Column:
    """Number of words; where words end doesn't depend on their case."""
    return F.size(split_words(F.coalesce(text, F.lit("")), ANY_CASE_GAP)).cast("long")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """words, size, items of each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), split_words(folded(F.col("text"))).alias("all")).where(F.size("all") > 0)
    size = F.least(F.size("all"), F.lit(window))
    starts = items.withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("size") + 1)))
    return starts.select(F.slice("all", F.col("at"), F.col("size")).alias("words"), "size", "item").groupBy("words", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows are known by doc_id and the text's hash, so repeated ids don't mix."""
    return docs.withColumn("scan_key", F.xxhash64("text"))


def hits(docs: DataFrame, windows: DataFrame, key_words: int) -> DataFrame:
    """scan_id, scan_key, at, size, items of each occurrence of ``windows``, all of ``key_words`` words at least."""
    wanted = windows.select(F.xxhash64(F.slice("words", 1, key_words)).alias("window_key"), F.col("words").alias("wanted"), F.col("size").alias("wanted_size"), "items")

    def keys(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - key_words + 1), lambda i: F.xxhash64(F.slice(words, i, key_words)))
        return F.struct(words.alias("words"), F.when(F.size(words) >= key_words, each).alias("keys"))

    scanned = keyed(docs).select(F.col("doc_id").alias("scan_id"), "scan_key", let(split_words(folded(F.col("text"))), keys).alias("s"))
    places = scanned.select("scan_id", "scan_key", F.col("s.words").alias("words"), F.posexplode("s.keys").alias("at", "window_key"))
    return (
        places.join(F.broadcast(wanted), "window_key")
        .where(F.slice("words", F.col("at") + 1, F.col("wanted_size")) == F.col("wanted"))
        .select("scan_id", "scan_key", F.col("at").cast("long").alias("at"), F.col("wanted_size").cast("long").alias("size"), "items")
    )


def covered(spans: Column) -> Column:
    """Words covered by an array of (at, size), overlaps once."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))

    def add(acc: Column, x: Column) -> Column:
        stop = x["at"] + x["size"]
        return F.struct((acc["total"] + F.greatest(F.lit(0).cast("long"), stop - F.greatest(acc["end"], x["at"]))).alias("total"), F.greatest(acc["end"], stop).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["total"])


def kept_stretches(spans: Column, n: Column) -> Column:
    """from and to (exclusive) of the words that no span (at, size), in order of at, covers: one pass over the spans."""
    item = "struct<from:int,to:int>"

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        at = x["at"].cast("int")
        gap = F.when(at > end, F.array(F.struct(end.alias("from"), at.alias("to")))).otherwise(F.array().cast(f"array<{item}>"))
        return F.greatest(end, at + x["size"].cast("int")), gap

    last = F.coalesce(F.array_max(F.transform(spans, lambda x: (x["at"] + x["size"]).cast("int"))), F.lit(0))
    return F.concat(running(spans, F.lit(0), item, step), F.array(F.struct(last.alias("from"), F.greatest(last, n).alias("to"))))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The columns of ``docs`` with n_words, n_hit, items (sorted) and spans of hit words."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, window)
    shape = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row for each length up to ``window``
    passes = []
    for key_words in sorted({min(KEY_WORDS, size) for size in shape}):
        some = windows.where(F.least(F.col("size"), F.lit(KEY_WORDS)) == key_words)
        n = -(-sum(v for k, v in shape.items() if min(KEY_WORDS, k) == key_words) // max_windows)
        for k in range(n):
            passes.append(hits(docs, some.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k) if n > 1 else some, key_words))
    empty = spark.createDataFrame([], "scan_id bigint, scan_key bigint, at bigint, size bigint, items array<string>")
    found = (
        reduce(DataFrame.unionByName, passes, empty)
        .groupBy("scan_id", "scan_key")
        .agg(F.collect_set(F.struct("at", "size")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"))
    )
    rows = keyed(docs).withColumn("n_words", n_words(F.col("text"))).alias("d")
    joined = rows.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.scan_id")) & (F.col("d.scan_key") == F.col("f.scan_key")), "left")
    return joined.select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_words", "n_hit", "hit_items", "hit_spans")],
        F.col("d.n_words"),
        F.when(F.col("f.hit_spans").isNull(), 0).otherwise(covered(F.col("f.hit_spans"))).cast("long").alias("n_hit"),
        F.coalesce("f.hit_items", F.array().cast("array<string>")).alias("hit_items"),
        F.coalesce(F.array_sort("f.hit_spans"), F.array().cast("array<struct<at:bigint,size:bigint>>")).alias("hit_spans"),
    )


def is_contaminated(share: int = SHARE) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``docs`` without contaminated documents, or ("spans") with the hit words cut out of each text."""
    found = scan(packed(docs, "doc_id", "text"), benchmark, window)
    text = F.col("text")
    if remove == "documents":
        found = found.where(~is_contaminated(share))
    elif remove == "spans":
        word = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
        pieces = F.regexp_extract_all("text", F.lit(rf"[^0-9A-Za-z\x80-\x{{10FFFF}}]*{word}"), F.lit(0))
        text_left = let(pieces, lambda p: F.array_join(F.flatten(F.transform(kept_stretches(F.col("hit_spans"), F.size(p)), lambda x: F.slice(p, x["from"] + 1, x["to"] - x["from"]))), ""))
        tail = F.regexp_extract("text", r"[^0-9A-Za-z\x80-\x{10FFFF}]*\z", 0)
        text = F.when(F.col("n_hit") > 0, F.concat(text_left, tail)).otherwise(text)
    else:
        raise ValueError(remove)
    return unpacked(found, docs.columns, text=text)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM bw
), dp AS (
  SELECT doc_id, w, sizes.m AS m, unnest(range(1, len(w) - sizes.m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) sizes WHERE len(w) >= sizes.m
), hit AS (
  SELECT dp.doc_id, dp.i, dp.m, win.item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM dp) dp JOIN win ON win.m = dp.m AND win.s = dp.s
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
