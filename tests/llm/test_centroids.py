"""Centroids against plain Python integers; trees against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from riftscan.llm import centroids, queries


def plain(rows, k=40, rounds=5, dims=64):
    points = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda p: (p[0] is None, hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1])
    c = [list(v) for _, v in sorted(points, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in points]
    for _ in range(rounds):
        own = near()
        for j in range(len(c)):
            held = [v for (_, v), o in zip(points, own) if o == j]
            if held:
                c[j] = [sum(x) // len(held) for x in zip(*held)]
    own = near()
    away = [far(v, c[o]) for (_, v), o in zip(points, own)]
    inertia = [sum(d for d, o in zip(away, own) if o == j) for j in range(len(c))]
    name = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, o, d, inertia[o], sum(away), name[o]) for (i, _), o, d in zip(points, own, away)), key=repr)


def result(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_op13(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(queries.QUERIES["op13_centroids"](spark, sf)) == plain(rows)


def write(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<float>, ids string, cluster int, points int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_op13_odd(spark, tmp_path):
    """Nulls, wrong lengths, numbers that are none, copies, ties, null and repeated ids, large and small values, clashing columns."""
    r = random.Random(3)
    v = lambda a=1.0: [r.uniform(-a, a) for _ in range(64)]
    one = v()
    rows = [(1, None), (2, []), (3, v()[:63]), (4, v() + [0.0]), (5, [None] + v()[1:]), (6, [float("nan")] + v()[1:]), (7, [float("inf")] + v()[1:]), (8, [-float("inf")] + v()[1:])]
    rows += [(100 + k, v()) for k in range(50)] + [(200 + k, one) for k in range(60)] + [(300, v()), (300, v()), (300, one), (None, v()), (None, one)]
    rows += [(400 + k, [0.0] * 32 + [float(k % 2)] * 32) for k in range(20)] + [(500, v(1000.0)), (501, v(30000.0)), (502, [-0.001] * 64)]
    assert result(centroids.op13_centroids(spark, write(spark, tmp_path, rows))) == plain([(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in rows])


@pytest.mark.parametrize("n", [0, 1, 3])
def test_op13_few(spark, tmp_path, n):
    rows = [(k, [float(k)] * 64) for k in range(n)] + [(9, None)]
    assert result(centroids.op13_centroids(spark, write(spark, tmp_path, rows))) == plain(rows)


def test_op13_beyond(spark, tmp_path):
    """Components whose squares fit in no long are not kept; sums that fit in none are null."""
    rows = [(1, [1e30] * 64), (2, [524287.0] * 64), (3, [-524287.0] * 64), (4, [0.5] * 64)] + [(10 + k, [500000.0 * (-1) ** k] * 64) for k in range(60)]
    got = result(centroids.op13_centroids(spark, write(spark, tmp_path, rows)))
    assert {g[0] for g in got} == {i for i, _ in rows} - {1}
    assert result(centroids.op13_centroids(spark, write(spark, tmp_path / "b", rows[1:4]))) == plain(rows[1:4])


@pytest.mark.parametrize("seed, scale, copies", [(0, 300, 0), (1, 5, 0), (2, 300, 900), (3, 1 << 25, 10), (4, 1, 300)])
def test_ball_tree(seed, scale, copies):
    """Filtering gives each vector to its nearest centroid, ties to the smaller number; clustered vectors go as whole balls."""
    r = np.random.default_rng(seed)
    heart = r.integers(-scale, scale + 1, (9, 8))
    x = np.concatenate([heart[k % 9] + r.integers(-max(1, scale // 50), max(1, scale // 50) + 1, (150, 8)) for k in range(9)] + [np.repeat(heart[:1], copies, axis=0)])
    c = np.concatenate([heart, heart[:3], x[:5]])
    balls, order = centroids.build(x, leaf=8)
    assert sorted(order.tolist()) == list(range(len(x))) and (balls.points == x[order]).all()
    for a, b, m, radius, total in zip(balls.lo, balls.hi, balls.centre, balls.radius, balls.total):
        own = balls.points[a:b]
        assert (own.sum(axis=0) == total).all() and (np.sqrt(((own - m).astype(float) ** 2).sum(axis=1)) <= radius).all()
    labels = np.zeros(len(x), dtype=np.int64)
    counts, sums, whole = centroids.assign(balls, c, labels)
    want = ((balls.points[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert labels.tolist() == [min(range(len(c)), key=lambda j: (row[j], j)) for row in want]
    assert counts.tolist() == np.bincount(labels, minlength=len(c)).tolist()
    assert all((sums[j] == balls.points[labels == j].sum(axis=0)).all() for j in range(len(c)))
    assert whole > 0
