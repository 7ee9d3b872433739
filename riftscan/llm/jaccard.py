"""Near-duplicate join on word shingles with Bayesian candidate pruning (operator 9).

1. Equal texts are one class; MinHash bands are computed once for each row and
   kept once for each class.
2. Classes that share a band are connected through the least class of the
   band's bucket (a star, not all pairs), and components of these stars are
   the candidate groups. Every pair that shares any band is inside one group.
3. In a group, all pairs of classes are compared, in blocks of 256 by 256
   classes that are dealt over the cluster: MinHash values incrementally, 16
   at a time; a pair is dropped when the posterior probability (uniform prior)
   that its similarity reaches the threshold falls below the tolerance. What
   is left is verified exactly on the shingle sets.
4. A block returns one row for each linked class: its number of links there
   and the root of its links' tree, so results grow with classes, not pairs.
   Texts of a group of m are dealt once for each of its m / 256 blocks, as
   exact numbers of links need all pairs. ``connect``, which ``keep_one`` uses,
   needs none of them and compares classes, not texts.

With 32 bands of 5 values a pair at similarity 0.8 shares no band with
probability 3e-6, and such a pair is still compared if other texts connect it.

Defined results: a null text is a class of its own without links; texts
without words are linked to nothing but equal texts share a class; a text of
one to four words is one shingle; repeated rows are equal texts; classes are
named by their least doc_id (null if no row has one); an empty table gives an
empty result; other columns are ignored by ``link`` and kept by
``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riftscan.llm import shingles as sh
from riftscan.llm.base import bounded, cut, packed, table, text_slices, unpacked
from riftscan.llm.components import components

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
TOLERANCE = 1e-9
STEPS = (16, 32, 48, 64)
BLOCK = 256
_U = np.uint64


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``n`` with which a pair may still reach the threshold.

    With a uniform prior and m matches the posterior is Beta(m + 1, n - m + 1),
    whose mass above t is the probability of at most m successes in n + 1
    trials of probability t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, uid and a key for each band (none for a text without words)."""
    mult, salt = sh.stream(21, ROWS) | _U(1), sh.stream(22, BANDS)
    for batch in batches:
        for first, data, offsets in text_slices(batch, "text", 1 << 19):
            values, counts = sh.shingles(data, offsets)
            least = sh.minima(values, counts, BANDS * ROWS).reshape(-1, BANDS, ROWS)
            keys = sh.mix((least * mult).sum(axis=2, dtype=_U) + salt).view(np.int64)
            some = counts > 0
            ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1)))
            part = batch.slice(first, len(counts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), bands], ["doc_id", "uid", "bands"])


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def linked_pairs(texts: pa.RecordBatch, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``left``, row of ``right``) of different ``cls`` that reach the threshold; a block with itself counts each pair once."""
    parts, counts = [], []
    for _, data, offsets in text_slices(texts, "text", 1 << 19):
        v, c = sh.shingles(data, offsets)
        parts.append(v)
        counts.append(c)
    counts = np.concatenate(counts)
    values = np.concatenate(parts)
    least = sh.minima(values, counts, STEPS[-1], seed=31)
    alive = np.ones((len(left), len(right)), dtype=bool)
    if left is right:
        alive = np.triu(alive, 1)
    alive &= (counts[left] > 0)[:, None] & (counts[right] > 0)[None, :] & (cls[left][:, None] != cls[right][None, :])
    matches = np.zeros(alive.shape, dtype=np.int16)
    done = 0
    for n in STEPS:
        i, j = np.nonzero(alive)
        if not len(i):
            return i, j
        need = least_matches(n, threshold, tolerance)
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            matches[a, b] += (least[left[a], done:n] == least[right[b], done:n]).sum(axis=1).astype(np.int16)
        alive &= matches >= need
        done = n
    i, j = np.nonzero(alive)
    if not len(i):
        return i, j
    # Exact sizes of intersections, over the shingles that two texts or more have.
    rows = np.repeat(np.arange(len(counts)), counts)
    codes, code = np.unique(values, return_inverse=True)
    cells = np.unique(rows.astype(np.int64) * len(codes) + code)
    rows, code = cells // len(codes), cells % len(codes)
    sizes = np.bincount(rows, minlength=len(counts))
    shared = np.bincount(code, minlength=len(codes)) > 1
    new = np.cumsum(shared) - 1
    use = shared[code]
    rows, code = rows[use], new[code[use]]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    used_l, used_r = np.unique(i), np.unique(j)
    inter = np.zeros((len(used_l), len(used_r)), dtype=np.float64)
    step = 4096
    for k in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(code, [k, k + step])
        grid = np.zeros((len(counts), step), dtype=np.float32)
        grid[rows[a:b], code[a:b] - k] = 1
        inter += grid[left[used_l]] @ grid[right[used_r]].T
    both = inter[np.searchsorted(used_l, i), np.searchsorted(used_r, j)]
    union = sizes[left[i]] + sizes[right[j]] - both
    held = both >= threshold * union - 1e-9
    return i[held], j[held]


def compare_blocks(threshold: float, tolerance: float):
    """For rows sorted by (comp, bi, bj, uid): uid, links and tree root within each block pair."""

    def of_group(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        uid = rows.column("uid").to_numpy()
        own = np.concatenate([[True], uid[1:] != uid[:-1]])  # a repeated row is the same class
        if not own.all():
            rows = rows.filter(pa.array(own))
            uid = uid[own]
        if len(uid) < 2:
            return None
        bi, bj, block = rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py(), rows.column("block").to_numpy()
        left = np.flatnonzero(block == bi)
        right = left if bi == bj else np.flatnonzero(block == bj)
        i, j = linked_pairs(rows, left, right, threshold, tolerance, rows.column("cls").to_numpy())
        if not len(i):
            return None
        i, j = left[i], right[j]
        links = np.bincount(np.concatenate([i, j]), minlength=len(uid))
        forest = Forest(len(uid))
        for a, b in zip(i.tolist(), j.tolist()):
            forest.join(a, b)
        has = np.flatnonzero(links)
        root = uid[[forest.find(k) for k in has.tolist()]]
        several = rows.column("n_blocks")[0].as_py() > 1
        return pa.RecordBatch.from_arrays([pa.array(uid[has]), pa.array(links[has]), pa.array(root), pa.array(np.full(len(has), several))], ["uid", "links", "root", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = of_group(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held.clear()
                if out is not None:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("comp", "bi", "bj")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                now = tuple(c[a] for c in cols)
                if now != key:
                    yield from flush()
                    key = now
                held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def with_uid(docs: DataFrame) -> DataFrame:
    return docs.withColumn("uid", F.when(F.col("text").isNotNull(), F.xxhash64(F.md5("text"))))


PAIRS = "uid bigint, links bigint, root bigint, several boolean"


def compared(dealt: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """uid, links, root, several of each text that a block pair of ``dealt`` links."""
    return cut(dealt.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "uid").mapInArrow(compare_blocks(threshold, tolerance), PAIRS))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal texts (uid, copy_id, n_copies), candidate groups (uid, comp, size), and the groups' texts (uid, comp, size, text)."""
    texts = with_uid(bounded(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).where("uid is not null")
    keyed = texts.mapInArrow(band_keys, "doc_id bigint, uid bigint, bands array<bigint>")
    classes = cut(keyed.groupBy("uid").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")))
    banded = classes.select("uid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("uid").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = banded.join(buckets, "band").where("uid <> least").select(F.col("uid").alias("a"), F.col("least").alias("b"))
    groups = components(stars)
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "root").select(F.col("node").alias("uid"), F.col("root").alias("comp"), "size")
    # One row of each class, joined by both keys so that many copies don't meet in one partition.
    of = texts.select(F.col("uid").alias("of_uid"), F.col("doc_id").alias("of_doc"), "text")
    named = members.join(classes.select("uid", "copy_id"), "uid")
    wanted = of.join(named, (F.col("of_uid") == F.col("uid")) & F.col("of_doc").eqNullSafe(F.col("copy_id"))).select("uid", "comp", "size", "text")
    return classes.select("uid", "copy_id", "n_copies"), members, wanted


def link(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """uid, copy_id (least doc_id of the equal texts), n_copies, class_id (least doc_id of all that links connect), n_links (other texts), root (a uid that names what links connect)."""
    classes, _, wanted = candidates(docs)
    blocked = wanted.withColumn("n_blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("n_blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "comp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "n_blocks", "uid", F.col("uid").alias("cls"), "text"
    )
    found = compared(dealt, threshold, tolerance)
    roots = found.where("not several").select("uid", "root")
    if not found.where("several").isEmpty():
        across = components(found.where("several").select(F.col("uid").alias("a"), F.col("root").alias("b")))
        roots = roots.unionByName(across.select(F.col("node").alias("uid"), "root"))
    linked = found.groupBy("uid").agg(F.sum("links").alias("n_links")).join(roots, "uid").join(classes.select("uid", "copy_id"), "uid")
    named = linked.join(linked.groupBy("root").agg(F.min("copy_id").alias("class_id")), "root").select("uid", "n_links", "class_id", "root")
    return classes.join(named, "uid", "left").select(
        "uid", "copy_id", "n_copies", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "uid").alias("root")
    )


def cross_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Block pairs that hold every pair of different classes of a group; ``members``: comp, cls, uid, text.

    A group's largest class is in blocks of its own that meet only those of
    the other texts, so a text is dealt once for each block of the others (or
    of the whole group, if it is one of the others).
    """
    sizes = members.groupBy("comp", "cls").agg(F.count("*").alias("n"))
    most = sizes.groupBy("comp").agg(F.max(F.struct("n", "cls")).alias("top"), F.sum("n").alias("size"))
    most = most.select("comp", F.col("top.cls").alias("top_cls"), F.ceil(F.col("top.n") / block).cast("int").alias("own"), F.ceil((F.col("size") - F.col("top.n")) / block).cast("int").alias("rest"))
    most = most.groupBy("comp", F.pmod("own", F.lit(1)).alias("z")).agg(F.first("top_cls").alias("top_cls"), F.first("own").alias("own"), F.first("rest").alias("rest")).drop("z").where("rest > 0")
    top = F.col("cls") == F.col("top_cls")
    placed = members.join(most, "comp").withColumn("block", F.when(top, F.pmod(F.xxhash64("uid"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("uid"), F.col("rest"))).cast("int"))
    others = F.when(top, F.sequence(F.col("own"), F.col("own") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("own") + F.col("rest") - 1))
    return placed.withColumn("other", F.explode(others)).select("comp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", F.lit(2).alias("n_blocks"), "uid", "cls", "text")


def connect(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """uid, copy_id, n_copies, root: what links connect, without counting links.

    Texts of a group are compared within blocks, then one for each class that
    was found, and so on while that halves them; only texts of classes that are
    then still apart are compared across blocks. Near copies of one text, however
    many, take time and shuffles in proportion to their number, and no link
    between different classes is lost.
    """
    classes, members, wanted = candidates(docs)
    texts = cut(wanted)
    several = texts.where(F.col("size") > block)
    left, edges = texts.select("uid", "comp", "size", "text"), []
    size = None
    for turn in range(64):
        blocked = left.withColumn("n_blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.col("n_blocks")).cast("int"))
        found = compared(blocked.select("comp", F.col("block").alias("bi"), F.col("block").alias("bj"), "block", "n_blocks", "uid", F.col("uid").alias("cls"), "text"), threshold, tolerance)
        edges.append(found.select("uid", "root"))
        gone = found.where("uid <> root").select("uid")
        apart = left.where(F.col("size") > block).join(gone, "uid", "left_anti").drop("size")
        sizes = apart.groupBy("comp", F.pmod("comp", F.lit(1)).alias("z")).agg(F.count("*").alias("size")).drop("z").where("size > 1")  # see components
        apart = cut(apart.join(sizes, "comp").select("uid", "comp", "size", "text"))
        now = apart.count()
        if not now or (size is not None and 2 * now > size):
            break
        left, size = apart, now
    joined = components(reduce(DataFrame.unionByName, edges).select(F.col("uid").alias("a"), F.col("root").alias("b")))
    if not several.isEmpty():
        named = several.join(joined.select(F.col("node").alias("uid"), "root"), "uid", "left").select("comp", F.coalesce("root", "uid").alias("cls"), "uid", "text")
        found = compared(cross_blocks(named, block), threshold, tolerance)
        edges.append(found.select("uid", "root"))
        joined = components(reduce(DataFrame.unionByName, edges).select(F.col("uid").alias("a"), F.col("root").alias("b")))
    return classes.join(joined.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: the one with the least doc_id (then text hash; null ids last). Rows with a null text stay."""
    first = F.min(F.struct(F.col("copy_id").isNull().alias("unnamed"), "copy_id", "uid")).alias("first")
    found = connect(docs, threshold).groupBy("root").agg(first).select(F.col("first.uid").alias("kept_uid"), F.col("first.copy_id").alias("kept_id"))
    rows = with_uid(packed(docs, "doc_id", "text")).drop("text")
    kept = rows.join(found, (F.col("uid") == F.col("kept_uid")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    nth = F.row_number().over(Window.partitionBy("uid", "doc_id").orderBy("uid"))  # only repeated rows are left to part
    one = kept.withColumn("nth", nth).where("nth = 1")
    return unpacked(one, docs.columns).unionByName(unpacked(rows.where("uid is null"), docs.columns))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = with_uid(docs.select("doc_id", "text")).select("doc_id", "uid")
    # Negated twice, the key is no longer known as partitioned: the join shuffles this side anew, and can split a hot class of the other.
    found = link(docs).withColumn("uid", F.bitwise_not(F.bitwise_not("uid")))
    return rows.join(found, "uid", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


OP9_SQL = r"""
WITH RECURSIVE t AS (
  SELECT text, min(doc_id) AS copy_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text
), words AS (
  SELECT copy_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT DISTINCT copy_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT copy_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), n AS (
  SELECT copy_id, count(*) AS n FROM s GROUP BY copy_id
), shared AS (
  SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.copy_id < b.copy_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.copy_id = a JOIN n y ON y.copy_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT copy_id AS x, copy_id AS y FROM t UNION SELECT reach.x, edges.b FROM reach JOIN edges ON edges.a = reach.y
), class AS (
  SELECT x, min(y) AS class_id FROM reach GROUP BY x
)
SELECT d.doc_id AS doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(t.copy_id, d.doc_id) AS copy_id, coalesce(n_copies, 1) AS n_copies, (SELECT count(*) FROM edges WHERE edges.a = t.copy_id) AS n_links
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN class ON class.x = t.copy_id
"""
