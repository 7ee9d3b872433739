"""Renames against all pairs in plain Python, taken one by one in order."""

import random
from collections import Counter

from riftscan.operators import renames


def lines(spark, files):
    rows = [(p, i + 1, x) for p, xs in files.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "path string, line int, content string")


def by_hand(old, new, least):
    """Scores of pairs of contents, and how many copies are given to one another."""
    def classes(files):
        out = {}
        for p, xs in files.items():
            out.setdefault(tuple(xs), []).append(p)
        return out

    a, b, pairs = classes(old), classes(new), []
    for x, ps in a.items():
        for y, qs in b.items():
            shared = sum((len(c.encode()) + 1) * n for c, n in (Counter(x) & Counter(y)).items())
            size = max(sum(len(c.encode()) + 1 for c in z) for z in (x, y))
            if 100 * shared >= least * size:
                pairs.append((-1 if x == y else 100 - 100 * shared // size, min(ps), min(qs), x, y))
    room = {("a", x): len(ps) for x, ps in a.items()} | {("b", y): len(qs) for y, qs in b.items()}
    out = Counter()
    for rank, _, _, x, y in sorted(pairs):
        n = min(room["a", x], room["b", y])
        room["a", x] -= n
        room["b", y] -= n
        if n:
            out[x, y, min(100, 100 - rank)] = n
    return out


def check(spark, old, new, least):
    got = renames.renames(lines(spark, old), lines(spark, new), least).collect()
    assert len({r.old_path for r in got}) == len({r.new_path for r in got}) == len(got)
    assert Counter((tuple(old[r.old_path]), tuple(new[r.new_path]), r.score) for r in got) == by_hand(old, new, least)
    return got


def test_random_files(spark):
    r = random.Random(3)
    words = ["}", "", "return x;", "é" * 5] + [f"line {k} {'y' * (k % 17)}" for k in range(60)]
    bases = [[r.choice(words) for _ in range(r.randrange(1, 25))] for _ in range(12)]

    def edited(xs):
        xs = list(xs)
        for _ in range(r.choice((0, 0, 1, 2))):
            xs[r.randrange(len(xs))] = r.choice(words)
        return xs

    old = {f"old/{k:03}": edited(r.choice(bases)) for k in range(60)}
    new = {f"new/{k:03}": edited(r.choice(bases)) for k in range(60)}
    assert check(spark, old, new, 70)


def test_copies_moves_and_order(spark):
    same, turned = ["a", "b", "c"], ["c", "b", "a"]
    old = {f"o{k}": same for k in range(5)} | {"t": turned, "e": [""]}
    new = {f"n{k}": same for k in range(3)} | {"u": turned, "v": turned, "f": [""], "z": ["nothing", "shared"]}
    got = check(spark, old, new, 90)
    # three copies and the turned file find their equals, one of the other copies the second turned file
    assert sorted(r.score for r in got) == [100] * 6
    assert not renames.renames(lines(spark, {}), lines(spark, new)).collect()
    odd = lines(spark, old).selectExpr("*", "1 AS rep", "2 AS chunk", "3 AS size")
    assert renames.renames(odd, lines(spark, new)).count() == 6
