"""The commit queries read every commit of the table."""

import random
import time

import pytest
from pyspark.sql import functions as F

from riftscan.errors import ScanError
from riftscan.functions.lineage import cut
from riftscan.operators import commits
from riftscan.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, operator", [("commits_ahead", "commits_ahead"), ("unique_commits", "unique_commits"), ("merge_base", "merge_bases")])
def test_whole_table(spark, monkeypatch, name, operator):
    given, real = [], getattr(commits, operator)
    monkeypatch.setattr(commits, operator, lambda edges, *tips, **more: given.append(edges) or real(edges, *tips, **more))
    catalog.QUERIES[name](spark, SF)
    keys = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {r.child for r in given[0].collect()} == {k for k in keys if k > 1}


@pytest.mark.parametrize("a, b", [(1995, 1870), (1999, 1998)])
def test_reachable(spark, a, b):
    """What tips at the far end reach is what following every parent gives."""
    edges = catalog.commit_edges(spark, SF)[0]
    parents = {}
    for r in edges.collect():
        parents.setdefault(r.child, []).append(r.parent)
    sides = []
    for tip in (a, b):
        seen, todo = {tip}, [tip]
        while todo:
            new = [p for p in parents.get(todo.pop(), ()) if p not in seen]
            seen.update(new)
            todo += new
        sides.append(seen)
    x, y = sides
    assert tuple(commits.commits_ahead(edges, a, b).first()) == (len(x - y), len(y - x), bool(x - y) and bool(y - x))
    assert {r.node for r in commits.unique_commits(edges, b, a).collect()} == x - y
    assert {r.node for r in commits.merge_bases(edges, a, b).collect()} == (x & y) - {p for c in x & y for p in parents.get(c, ())}


def plain(edges, tip):
    parents = {}
    for c, p in edges:
        parents.setdefault(c, []).append(p)
    seen, todo = {tip}, [tip]
    while todo:
        new = [p for p in parents.get(todo.pop(), ()) if p is not None and p not in seen]
        seen.update(new)
        todo += new
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_random_history(spark, seed):
    """Forks, merges, several roots, a commit without edges, and an index that is kept and used again."""
    r = random.Random(seed)
    rows = [(k, p) for k in range(1, 150) for p in {k - 1 if r.random() < 0.7 else r.randrange(k) for _ in range(r.choice([0, 1, 1, 2, 3]))}] + [(0, None)]
    edges = spark.createDataFrame(rows, "child int, parent int")
    index = cut(commits.chain_index(edges))
    places = index.collect()
    assert len({(x.chain, x.pos) for x in places}) == len(places) == len({n for e in rows for n in e if n is not None})
    tips = [149, 100, 37, 0, 999]
    got = commits.reachable(edges, commits.tips_of(edges, *tips), index).collect()
    assert len(got) == len(set(got))
    for t in tips:
        assert {x.node for x in got if x.tip == t} == plain(rows, t)


def test_long_history(spark):
    """A linear history of 100,000 commits, named at random, takes seconds; one of ten times the depth little more."""
    took = {}
    for n in (10_000, 100_000):
        rows = spark.range(1, n).select(F.xxhash64("id").alias("child"), F.xxhash64(F.col("id") - 1).alias("parent"))
        edges = cut(rows)
        tip, mid = (edges.sparkSession.range(1).select(F.xxhash64(F.lit(k).cast("bigint"))).first()[0] for k in (n - 1, n // 2))
        began = time.time()
        assert tuple(commits.commits_ahead(edges, tip, mid).first()) == (n - 1 - n // 2, 0, False)
        took[n] = time.time() - began
    assert took[100_000] < 4 * took[10_000] + 5


def test_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child int, parent int")
    with pytest.raises(ScanError):
        commits.chain_index(edges)
