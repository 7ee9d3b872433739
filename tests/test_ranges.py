"""Overlaps of ranges of any length against all pairs; rows of long ranges."""

import random

from pyspark.sql import functions as F

from riftscan.operators import ranges

SCHEMA = "file string, start_line int, line_count int, end_line int, change_type string"


def plain(a, b):
    out = []
    for f, s, n, e, _ in a:
        for g, t, m, h, _ in b:
            last, other = (s if n == 0 else e), (t if m == 0 else h)
            gap = min(abs(last - t), abs(other - s))
            low, high = max(s, t), min(last, other)
            level = "HIGH" if low <= high else "MEDIUM" if gap == 0 else "LOW" if gap <= 5 else "SAFE"
            if f == g and level != "SAFE":
                out.append((f, s, n, t, m, level, max(0, high - low + 1)))
    return sorted(out)


def test_any_length(spark):
    r = random.Random(5)

    def made(n, longest):
        out = []
        for _ in range(n):
            start, count = r.randint(0, 40_000), r.choice([0, 1, 3, r.randint(0, longest)])
            out.append((f"f{r.randrange(3)}", start, count, start + max(0, count - 1), "modified"))
        return out

    for longest in (40, 400, 40_000, 30_000_000):
        a, b = made(120, longest), made(120, longest)
        got = ranges.overlaps(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
        assert sorted(tuple(x) for x in got.select("file", "a_start_line", "a_line_count", "b_start_line", "b_line_count", "level", "shared_lines").collect()) == plain(a, b)


def test_bins(spark):
    """Bins of a range fill its blocks exactly, and are at most a hundred for ten million lines."""
    r = random.Random(6)
    spans = [(a, a + r.choice([0, 1, 7, 8, 63, 500, 156_250, 1 << 24])) for a in [r.randrange(-2, 1 << 20) for _ in range(60)]]
    rows = spark.createDataFrame(spans, "a bigint, b bigint").select("a", "b", ranges.bins(F.col("a"), F.col("b")).alias("bins")).collect()
    for x in rows:
        held = sorted((y.bin << (3 * y.level), (y.bin + 1) << (3 * y.level)) for y in x.bins)
        assert held[0][0] == x.a and held[-1][1] == x.b + 1 and all(p[1] == q[0] for p, q in zip(held, held[1:]))
        assert len(held) <= 100
