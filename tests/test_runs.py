"""Measured runs: observed counts against counted ones, refused rows, and time of the run itself."""

import time

from pyspark.sql import functions as F

from riftscan.plans import analysis, runs

LINES = "file string, line int, content string, extra string"
ROWS = [
    ("a.js", 1, "eval(code)", "x"),
    ("a.js", 2, None, "x"),
    (None, 3, "eval(code)", "x"),
    ("", 4, None, "x"),
    ("b.js", 5, "eval(\0)", "x"),
    ("b.js", None, 'token = "ghp_' + "a1B2" * 9 + '"', "x"),
    ("b.js", 7, "", "x"),
    ("b.js", 7, "", "x"),
]


def test_security_run(spark, tmp_path):
    lines = spark.createDataFrame(ROWS, LINES)
    risks, refused, metrics = runs.security_run(lines, str(tmp_path))
    assert sorted(map(str, refused.select("file", "line", "outcome").collect())) == sorted(
        [f"Row(file={f!r}, line={n}, outcome={o!r})" for f, n, o in [("a.js", 2, "no content"), (None, 3, "no file"), ("", 4, "no file"), ("b.js", 5, "binary content")]]
    )
    good = spark.createDataFrame([r for k, r in enumerate(ROWS) if k in (0, 5, 6, 7)], LINES).drop("extra")
    want = analysis.security_risks(good)
    assert sorted(map(str, risks.collect())) == sorted(map(str, want.collect())) and risks.count() > 0
    counts = {(r["step"], r["outcome"]): r["n_rows"] for r in metrics.collect()}
    assert counts == {("lines", "accepted"): 4, ("lines", "no file"): 2, ("lines", "no content"): 1, ("lines", "binary content"): 1, ("risks", "written"): risks.count()}
    n = risks.count()
    again = runs.security_run(lines, str(tmp_path))  # a repeated run leaves the same tables, written anew
    assert again[0].count() == n and again[1].count() == 4


def test_empty(spark, tmp_path):
    risks, refused, metrics = runs.security_run(spark.createDataFrame([], LINES), str(tmp_path))
    assert risks.count() == refused.count() == 0 and {r["n_rows"] for r in metrics.collect()} == {0}


def test_clock_runs_with_the_rows(spark, tmp_path):
    """Making the plan takes no time on the clock; what a task takes does."""

    def slow(batches):
        for b in batches:
            time.sleep(0.7)
            yield b

    run = runs.Run(spark, str(tmp_path))
    rows = spark.range(0, 4, 1, 1).mapInArrow(slow, "id bigint")
    time.sleep(0.8)
    assert run.keep("slow", rows).count() == 4
    run.keep("plain", spark.range(5))
    took = {r["step"]: r["ms"] for r in run.metrics().collect()}
    assert took["slow"] >= 700 and {r["step"]: r["n_rows"] for r in run.metrics().collect()} == {"slow": 4, "plain": 5}


def test_first_reason_holds(spark):
    rows = spark.createDataFrame([(1, None), (None, 1), (None, None)], "a int, b int")
    got = runs.judged(rows, {"no a": F.col("a").isNull(), "b is one": F.col("b") == 1}).collect()
    assert [r["outcome"] for r in got] == ["accepted", "no a", "no a"]
