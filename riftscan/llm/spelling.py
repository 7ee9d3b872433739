"""Spelling variants by forward and reversed sorted dictionaries (operator 12).

1. Words are counted over all texts, with map-side partial counts: the
   dictionary has one row for each word.
2. Of two words that differ by one inserted, deleted or replaced code point the
   edit leaves a half intact. With ``size`` letters in the shorter one, both
   have the first ``size // 2`` in common (a range of the sorted dictionary) or
   the last ones (a range of the reversed one). A word is in the blocks of its
   own size and, as the longer of a pair, of one less.
3. A block of more than ``BLOCK`` words is subdivided: of its stretch in doubt
   again one half is intact, so its words go to two blocks that share more
   letters in front or behind. This ends where one letter is in doubt, when a
   block holds no more words than the alphabet makes. Blocks are counted and
   divided over the cluster, level by level (as many as the logarithm of the
   longest word at most).
4. Blocks are dealt out, sorted, and scanned range by range: words that agree
   but for one letter at a place in doubt are near. The place of an edit is the
   first at which the two words differ, and each block answers for its own
   stretch of places alone, so a pair is found exactly once. A scan takes time
   in proportion to the letters in doubt and returns one row for each word and
   block with near words: their number and the best.

Every step is a join or an aggregation on a block's key or on a word; no step
emits the pairs of a block, and none is bounded by a cap on partners.

Defined results: a null text has no words; a null doc_id is written as an
empty text before the colon; a run of any length is one word (blocks hold its
halves as strings); repeated rows count each; of near words with equal counts
the smallest in code-point order is the form; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import bounded, cut, table

LEAST, OFTEN, RATIO, ONE_IN = 7, 2, 10, 31
#: Words of a block that is not subdivided.
BLOCK = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["size", "head", "tail"]


def noisy(doc_id: Column, run: Column) -> Column:
    """The run, without one letter if the hash of id and run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % ONE_IN == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).otherwise(run)


def dictionary(docs: DataFrame) -> DataFrame:
    """word, n of the words that count."""
    # A run of fewer letters gives no word; both classes hold one code unit for each code point.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST},}}+"), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = low.select(noisy(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def first_blocks(words: DataFrame) -> DataFrame:
    """size, head, tail, word, n: the blocks of each word in both dictionaries."""
    length = F.length("word")

    def of(size: Column) -> list[Column]:
        half, rest = F.floor(size / 2).cast("int"), (size - F.floor(size / 2)).cast("int")
        block = lambda head, tail: F.struct(size.alias("size"), head.alias("head"), tail.alias("tail"))
        return [block(F.substring("word", F.lit(1), half), F.lit("")), block(F.lit(""), F.substring(F.col("word"), -rest, rest))]

    return words.select("word", "n", F.explode(F.array(*of(length), *of(length - 1))).alias("b")).select("b.*", "word", "n")


def divided(rows: DataFrame) -> DataFrame:
    """The two blocks of each row, of which one shares more letters in front and one behind."""
    a, c = F.length("head"), F.length("tail")
    doubt = F.col("size") - a - c
    half = F.floor(doubt / 2).cast("int")
    more = (doubt - half).cast("int")
    front = F.struct("size", F.substring(F.col("word"), F.lit(1), a + half).alias("head"), F.col("tail").alias("tail"))
    back = F.struct("size", F.col("head").alias("head"), F.substring(F.col("word"), -(c + more), c + more).alias("tail"))
    return rows.select("word", "n", F.explode(F.array(front, back)).alias("b")).select("b.*", "word", "n")


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows of blocks, none of more than ``most`` words unless one letter is in doubt."""
    rows, done = first_blocks(words), []
    while True:
        large = rows.groupBy(*KEY).agg(F.count("*").alias("m")).where((F.col("m") > most) & (F.col("size") - F.length("head") - F.length("tail") > 1))
        marked = cut(rows.join(large, KEY, "left"))
        done.append(marked.where("m is null").drop("m"))
        rows = marked.where("m is not null").drop("m")
        if rows.isEmpty():
            break
        rows = divided(rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Best:
    """Number of near words and the best two of them; the second is only kept for groups that hold the word itself."""

    __slots__ = ("count", "n", "word")

    def __init__(self) -> None:
        self.count, self.n, self.word = 0, 0, ""

    def add(self, n: int, word: str, count: int = 1) -> None:
        self.count += count
        if n > self.n or (n == self.n and word < self.word):
            self.n, self.word = n, word


def scan(size: int, a: int, c: int, words: list[tuple[str, int]]) -> dict[str, Best]:
    """Near words of a block whose words share ``a`` letters in front and ``c`` behind."""
    found: dict[str, Best] = defaultdict(Best)
    short = {w: n for w, n in words if len(w) == size}
    if not short:
        return found
    if len(short) > 1:
        for p in range(a, size - c):
            alike = defaultdict(list)
            for w in short:
                alike[w[:p] + w[p + 1 :]].append(w)
            for group in alike.values():
                if len(group) > 1:
                    first, second = sorted(group, key=lambda w: (-short[w], w))[:2]
                    for w in group:
                        best = second if w == first else first
                        found[w].add(short[best], best, len(group) - 1)
    last = size if c == 0 else size - c - 1
    for w, n in words:
        if len(w) == size + 1:
            for p in range(a, last + 1):
                # deleting any letter of a run of equal ones gives the same word: the last one counts
                if (p == size or w[p] != w[p + 1]) and (s := w[:p] + w[p + 1 :]) in short:
                    found[w].add(short[s], s)
                    found[s].add(n, w)
    return found


def near(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n_near, best (the near word of largest n, then smallest), best_n of the words with near ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush() -> None:
            if len(held) > 1:
                out.extend((w, b.count, b.n, b.word) for w, b in scan(key[0], len(key[1]), len(key[2]), held).items())
            held.clear()

        def rows() -> pa.RecordBatch:
            cells = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

        for batch in batches:
            for *now, word, n in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if now != key:
                    flush()
                    key = now
                held.append((word, n))
            if out:
                yield rows()
        flush()
        if out:
            yield rows()

    ranges = blocks(words, most).select(*KEY, "word", "n").repartition(*KEY).sortWithinPartitions(*KEY, "word")
    parts = bounded(ranges).mapInArrow(of, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def group(docs: DataFrame, most: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = cut(dictionary(docs))
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = cut(words.join(near(words, most), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    # A form is at least ``ratio`` times as frequent, so chains are short; each round doubles what a word has followed.
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return rows.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents").select("doc_id", "text"))


# The hash is written out byte by byte, its table made from its polynomial; near words are those that agree
# when one letter is left out at the same place, or from the longer one.
OP12_SQL = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
low AS MATERIALIZED (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM runs WHERE length(run) >= {LEAST} GROUP BY 1, 2),
codes AS (SELECT *, list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''), lambda c: unicode(c)) AS u FROM low),
bytes AS (SELECT *, flatten(list_transform(u, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + c % 64] END)) AS b FROM codes),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)), lambda s, x: xor(t[xor(s, x) % 256 + 1], s >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bytes, crc),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {ONE_IN} = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INTEGER)), substr(run, CAST(h % length(run) AS INTEGER) + 2)) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OFTEN}),
cuts AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.less UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.less),
best AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'word': other}}) AS s FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -s.less >= {RATIO} * w.n THEN s.word END AS form, CASE WHEN -s.less >= {RATIO} * w.n THEN -s.less END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.next)
SELECT f.word, f.form, k.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word AND k.next IS NULL"""
