"""Paged adjacency against plain lists."""

import random
from collections import Counter

from pyspark.sql import functions as F

from riftscan.operators import adjacency, semantic

CALLS = "ref string, called_function string, caller_file string, line int, extra string"


def formatted(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def random_calls(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("AB"), rng.choice(["hot", "hot", "hot", "f", "g"]), f"s{rng.randrange(9)}.js", rng.randrange(40), "x") for _ in range(n)]


def test_pages(spark):
    rows = random_calls(1500, 1) + [("A", None, "s", 1, ""), ("A", "f", None, 1, ""), ("A", "f", "s", None, "")]
    got = {(r["called_function"], r["page"]): r for r in adjacency.call_pages(spark.createDataFrame(rows, CALLS).repartition(7), page=10).collect()}
    want = {}
    for _, f, file, line, _ in rows:
        if None not in (f, file, line):
            want.setdefault(f, Counter())[(file, line)] += 1
    assert sum(len(c) > 300 for c in want.values()) >= 1
    n = 0
    for f, c in want.items():
        order = sorted(c)
        for p in range(0, len(order), 10):
            r, part = got[(f, p // 10)], order[p : p + 10]
            n += 1
            assert [tuple(s) for s in r["sites"]] == [(*k, c[k]) for k in part]
            assert (r["first_file"], r["first_line"]) == part[0] and (r["last_file"], r["last_line"]) == part[-1]
            assert (r["n_sites"], r["n_calls"]) == (len(part), sum(c[k] for k in part))
    assert n == len(got)


def test_empty(spark):
    assert adjacency.call_pages(spark.createDataFrame([], CALLS)).collect() == []


def test_large_function(spark):
    """A function with very many callers: no row above the bound, and no task with all of its sites."""
    calls = spark.range(0, 200_000, 1, 8).select(F.lit("hot").alias("called_function"), F.concat(F.lit("f"), F.col("id") % 1000).alias("caller_file"), (F.col("id") / 1000).cast("int").alias("line"))
    pages = adjacency.call_pages(calls)
    assert pages.agg(F.max("n_sites"), F.sum("n_sites"), F.count("*")).first()[:] == (adjacency.PAGE, 200_000, -(-200_000 // adjacency.PAGE))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts ranges of few bytes together
    try:
        ranges = calls.repartitionByRange("called_function", "caller_file", "line").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in ranges) < 200_000 * 0.6


def test_stored_lookup(spark, tmp_path):
    rows = random_calls(800, 2)
    calls = spark.createDataFrame(rows, CALLS)
    path = str(tmp_path / "graph")
    adjacency.write_graph(adjacency.call_pages(calls, page=8), path)
    found = adjacency.lookup(spark, path, "hot", "s4.js")
    plan = formatted(found)
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(called_function,hot)" in plan and "LessThanOrEqual(first_file,s4.js)" in plan
    got = {(r["caller_file"], r["line"]) for r in adjacency.sites(found).where("caller_file = 's4.js'").collect()}
    assert got == {(file, line) for _, f, file, line, _ in rows if f == "hot" and file == "s4.js"}
    assert found.count() < adjacency.lookup(spark, path, "hot").count()
    assert adjacency.lookup(spark, path, "nowhere").count() == 0
    stored = adjacency.directory(spark.read.parquet(path))
    assert "sites:array" not in formatted(stored).split("ReadSchema")[1]


def test_stale_as_lists(spark):
    """The same conflicts as with whole lists, repeated sites and equal lists of both branches included."""
    calls = random_calls(300, 3) + [(ref, "same", "z.js", k, "") for ref in "AB" for k in range(30)] + [("A", "same", "z.js", 3, "")] * 2 + [("B", "same", "z.js", 3, "")] * 2
    signatures = [(ref, "s1.js", name, p, 0) for name in ("hot", "f", "same") for ref, p in (("base", ["a"]), ("A", ["a", "b"]), ("B", ["a", "c"]))] + [(ref, "s1.js", "g", ["a"], 0) for ref in ("base", "A", "B")]
    changes = semantic.signature_changes(spark.createDataFrame(signatures, "ref string, file string, name string, params array<string>, seq int"))
    frame = spark.createDataFrame(calls, CALLS)
    want = semantic.semantic_conflicts(changes, frame)
    pages = adjacency.call_pages(frame, ("ref", "called_function"), 7)
    got = adjacency.stale_conflicts(changes, pages)
    key = ("scope", "branch", "name", "file", "old_params", "new_params")
    lists = {str([r[k] for k in key]): sorted(map(tuple, r["sites"])) for r in want.collect()}
    heads = {str([r[k] for k in key]): r["n_calls"] for r in got.collect()}
    assert {k: len(v) for k, v in lists.items()} == heads
    assert sum("same" in k for k in heads) == 2  # of two equal ones, in each scope, the first pass
    listed = {}
    for r in adjacency.stale_pages(got, changes, pages).collect():
        assert len(r["sites"]) <= 7
        listed.setdefault((r["scope"], r["branch"], r["name"], r["file"]), []).extend((s["caller_file"], s["line"]) for s in r["sites"] for _ in range(s["times"]))
    assert {k: sorted(v) for k, v in listed.items()} == {(r["scope"], r["branch"], r["name"], r["file"]): sorted(map(tuple, r["sites"])) for r in want.collect()}
