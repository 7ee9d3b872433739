"""Centroid clustering by ball-tree filtering (operator 13), exact in integers.

Vectors become integers (``floor(scale * x)``). Each task packs its vectors
into metric trees of at most ``TREE`` vectors: balls, halved along their
longest direction, each with its centre, radius, count and integer sum. The
trees are written once; every round reads them with the centroids of the round
before:

* of a ball, each centroid further from the centre than the nearest one by
  more than twice the radius is nearest to none of its vectors (triangle
  inequality) and goes;
* a ball with one centroid left gives its count and sum as a whole;
* other balls are halved, down to leaves whose vectors are compared one by one
  with the centroids that are left.

A task adds up what its trees give to one row for each centroid; these rows
are summed over the cluster in decimals, and the driver divides ``k`` sums.
Vectors are never shuffled, whatever their copies; what is broadcast is
``k`` centroids, whose number and length are parameters.

Distances are compared exactly: squares of integers are added in doubles only
where all of them stay below 2^53, in 64-bit integers otherwise. Radii and
roots are doubles, and a centroid goes only by more than their error.

Defined results: a vector that is null, has not exactly ``dims`` components,
or one that is null, not finite or beyond 2^27 after scaling, is not kept;
equal distances go to the smaller number; a repeated row is a vector of its
own; a null vec_id is kept and starts as a centroid only if there are too few
others; equal hashes (repeated ids) are ordered by components; with fewer than
``k`` kept vectors each is a centroid; an empty table gives an empty result;
other columns are ignored. An inertia
that no long holds is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import bounded, cut, table

DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a tree, and of a leaf.
TREE, LEAF = 8192, 24
#: No component is larger, so that a squared distance of 64 components fits in 63 bits.
LARGEST = 1 << 27
#: Squares of differences of components up to this add up to less than 2^53 in 64 components.
EXACT = 1 << 22


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of int) of the vectors that are kept."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    # size(null) is no number here, so a null vector goes too
    good = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(LARGEST // scale)))
    return vectors.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled.cast("array<int>").alias("v"))


def first_centroids(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of the least hashes of their ids, in that order."""
    named = points.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), dtype=np.int64)
    if max(abs(int(x.min())), abs(int(x.max())), abs(int(c.min())), abs(int(c.max()))) <= EXACT * 8 // max(8, int(np.ceil(np.sqrt(x.shape[1])))):
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - row) ** 2).sum(axis=1) for row in c.astype(np.int64)], axis=1)


class Balls(NamedTuple):
    """A metric tree as arrays: ``points`` in its order; a ball holds points lo to hi; the halves of ball i are at child[i] and the next place (0: a leaf)."""

    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[Balls, np.ndarray]:
    """The tree of some vectors, and their order in it."""
    order = np.arange(len(points))
    lo, hi, child, centre, radius, total = [0], [len(points)], [], [], [], []
    k = 0
    while k < len(lo):
        a, b = lo[k], hi[k]
        own = points[order[a:b]]
        sums = own.sum(axis=0, dtype=np.int64)
        mid = sums // (b - a)
        far = squares(own, mid[None, :])[:, 0]
        total.append(sums)
        centre.append(mid)
        radius.append(np.sqrt(float(far.max())) * (1 + 1e-12))
        if b - a <= leaf or not far.max():
            child.append(0)
        else:  # halved along the line between two far vectors
            one = own[far.argmax()].astype(np.float64)
            away = ((own - one) ** 2).sum(axis=1)
            along = own @ (own[away.argmax()] - one)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]
            child.append(len(lo))
            lo += [a, a + half]
            hi += [a + half, b]
        k += 1
    return Balls(points[order], np.array(lo), np.array(hi), np.array(child), np.array(centre), np.array(radius), np.array(total)), order


def assign(balls: Balls, centroids: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts and sums of each centroid's vectors, and how many balls were given away whole; ``labels`` gets each point's centroid."""
    k = len(centroids)
    counts, sums, whole = np.zeros(k, dtype=np.int64), np.zeros((k, centroids.shape[1]), dtype=np.int64), 0
    # Of equal centroids the first is nearest to all.
    left = np.zeros((1, k), dtype=bool)
    left[0, np.unique(centroids, axis=0, return_index=True)[1]] = True
    at = np.array([0])
    while len(at):
        exact = squares(balls.centre[at], centroids)
        root = np.where(left, np.sqrt(exact.astype(np.float64)), np.inf)
        near = root.min(axis=1)
        slack = (near + balls.radius[at]) * 1e-9 + 1e-9
        left = left & (root <= (near + 2 * balls.radius[at] + slack)[:, None])
        # A ball without extent is a point: the exact distance decides, ties go to the smaller number.
        point = np.flatnonzero(balls.radius[at] == 0)
        if len(point):
            best = np.where(left[point], exact[point], np.iinfo(np.int64).max).argmin(axis=1)
            # the centre is floored, so a ball of several points of no extent has its centre on them
            left[point] = False
            left[point, best] = True
        one = left.sum(axis=1) == 1
        for i in np.flatnonzero(one):
            ball, c = at[i], int(left[i].argmax())
            counts[c] += balls.hi[ball] - balls.lo[ball]
            sums[c] += balls.total[ball]
            whole += 1
            if labels is not None:
                labels[balls.lo[ball] : balls.hi[ball]] = c
        for i in np.flatnonzero(~one & (balls.child[at] == 0)):
            a, b, among = balls.lo[at[i]], balls.hi[at[i]], np.flatnonzero(left[i])
            own = balls.points[a:b]
            best = among[squares(own, centroids[among]).argmin(axis=1)]
            counts += np.bincount(best, minlength=k)
            np.add.at(sums, best, own)
            if labels is not None:
                labels[a:b] = best
        go = np.flatnonzero(~one & (balls.child[at] > 0))
        at, left = np.concatenate([balls.child[at[go]], balls.child[at[go]] + 1]), np.concatenate([left[go], left[go]])
    return counts, sums, whole


FIELDS = ("lo", "hi", "child", "centre", "radius", "total")
TREES = "ids array<bigint>, points binary, " + ", ".join(f"{f} binary" for f in FIELDS)


def grow_trees(points: DataFrame, dims: int = DIMS) -> DataFrame:
    """One row for each tree, of the vectors that a task reads together."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def tree() -> pa.RecordBatch:
            ids, vectors = pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held])
            held.clear()
            balls, order = build(vectors)
            cells = [balls.points.astype("<i4").tobytes()] + [getattr(balls, f).astype("<f8" if f == "radius" else "<i8").tobytes() for f in FIELDS]
            ordered = ids.take(pa.array(order))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ordered)], pa.int32()), ordered), *[pa.array([c], pa.binary()) for c in cells]], ["ids", "points", *FIELDS])

        for batch in batches:
            n = batch.num_rows
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            at = 0
            while at < n:
                take = min(n - at, TREE - sum(len(x) for _, x in held))
                held.append((batch.column(0).slice(at, take), v[at : at + take]))
                at += take
                if sum(len(x) for _, x in held) == TREE:
                    yield tree()
        if held:
            yield tree()

    return bounded(points).mapInArrow(of, TREES)


def trees_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Balls]]:
    cells = {f: batch.column(batch.schema.get_field_index(f)) for f in ("ids", "points", *FIELDS)}
    for k in range(batch.num_rows):
        read = lambda f, kind: np.frombuffer(cells[f][k].as_py(), dtype=kind)
        flat = {f: read(f, "<f8" if f == "radius" else "<i8") for f in FIELDS}
        flat |= {f: flat[f].reshape(-1, dims) for f in ("centre", "total")}
        yield cells["ids"][k].values, Balls(read("points", "<i4").reshape(-1, dims), **flat)


def round_sums(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Number of each centroid's vectors, and their sums."""
    k, dims = centroids.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            for _, balls in trees_of(batch, dims):
                n, s, _ = assign(balls, centroids)
                counts += n
                sums += s
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = bounded(trees).mapInArrow(of, "cluster int, n bigint, sums array<bigint>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "x"))
    rows = cells.groupBy("cluster", "dim").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()  # k times dims rows
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    for r in rows:
        counts[r["cluster"]] = int(r["n"])
        sums[r["cluster"]][r["dim"]] = int(r["x"])
    return counts, sums


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector."""
    dims = centroids.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, balls in trees_of(batch, dims):
                labels = np.zeros(len(balls.points), dtype=np.int64)
                assign(balls, centroids, labels)
                away = ((balls.points.astype(np.int64) - centroids[labels]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(labels, pa.int32()), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"])

    return bounded(trees).mapInArrow(of, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of each kept vector, and the centroids."""
    points = kept(vectors, dims, scale)
    centroids = first_centroids(points, k, seed)
    trees = cut(grow_trees(points, dims))
    for _ in range(rounds if len(centroids) else 0):
        counts, sums = round_sums(trees, centroids)
        centroids = np.array([[s // n for s in row] if n else list(old) for n, row, old in zip(counts, sums, centroids)], dtype=np.int64)
    return assigned(trees, centroids if len(centroids) else np.zeros((1, dims), dtype=np.int64)), centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = cut(rows)  # summed, then read again
    each = {r["cluster"]: int(r["x"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}  # one row for each centroid
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    facts = [(c, fits(each.get(c, 0)), fits(sum(each.values())), digest(v)) for c, v in enumerate(centroids.tolist())]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql() -> str:
    """The rounds written out, on vectors as lists of integers."""
    floors = f"list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))"
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT)))"
    parts = [
        f"WITH points AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {floors} AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM points ORDER BY h, v LIMIT {K}))",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, vec_id, v, min(s).cluster AS cluster, min(s).distance AS distance FROM (SELECT p.r, p.vec_id, p.v, {{'distance': CAST({distance} AS BIGINT), 'cluster': c.cluster}} AS s FROM points p CROSS JOIN c{k} c) GROUP BY r, vec_id, v)")
        if k < ROUNDS:
            sums = f"SELECT cluster, list(m ORDER BY i) AS v FROM (SELECT cluster, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{k} CROSS JOIN range(1, {DIMS + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster"
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN ({sums}) m ON m.cluster = c.cluster)")
    last = f"SELECT a.vec_id, a.cluster, a.distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.cluster"
    return ",\n".join(parts) + "\n" + last


OP13_SQL = _op13_sql()
