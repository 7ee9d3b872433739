"""Line diffs give the second version back; merges agree with a plain diff3 over the same changes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from riftscan.functions import scans
from riftscan.functions.lineage import cut
from riftscan.operators import linediff

SCHEMA = "file string, line int, content string"


def table(spark, files):
    return spark.createDataFrame([(f, k, x) for f, lines in files.items() for k, x in enumerate(lines, 1)], SCHEMA)


def edited(r, lines, alphabet, rate=0.15):
    out = []
    for x in lines:
        what = r.random()
        if what < rate / 3:
            continue
        out.append(r.choice(alphabet) if what < 2 * rate / 3 else x)
        if what > 1 - rate / 3:
            out.append(r.choice(alphabet))
    if r.random() < 0.3 and len(out) > 4:  # a block moves
        a, b = sorted(r.sample(range(len(out)), 2))
        out = out[:a] + out[b:] + out[a:b]
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j], row[j + 1]))
    return row[-1]


def files_of(seed):
    """Files of few and of many different lines, odd ones among them."""
    r = random.Random(seed)
    old, new = {}, {}
    for k in range(40):
        alphabet = [f"line {i}" for i in range(r.choice([1, 2, 5, 40, 400]))] + [""]
        lines = [r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 9, 40, 90]))]
        old[f"f{k}"], new[f"f{k}"] = lines, edited(r, lines, [*alphabet, "new"], r.choice([0, 0.05, 0.3, 0.9]))
    old |= {"gone": ["a", "b"], "nulls": ["a", None, "b", None], "turned": list("abcdefgh"), "same": ["x"] * 50}
    new |= {"made": ["c"], "nulls": ["a", None, None, "b", "-"], "turned": list("hgfedcba"), "same": ["x"] * 52}
    return old, new


@pytest.mark.parametrize("small", [0, 30, linediff.SMALL])
def test_changes(spark, small):
    old, new = files_of(small)
    a, b = table(spark, old), table(spark, new)
    kept = cut(linediff.changes(a, b, small=small))
    found = kept.collect()
    made = {(r.file, r.line): r.content for r in linediff.applied(a, b, kept).collect()}
    assert made == {(f, k): x for f, lines in new.items() for k, x in enumerate(lines, 1)}
    for f in {*old, *new}:
        x, y = old.get(f, []), new.get(f, [])
        own = sorted(tuple(r)[1:] for r in found if r.file == f)
        at = (1, 1)
        same = 0
        for os, oc, ns, nc in own:  # in order, apart from each other, with equal lines in between
            assert os - at[0] == ns - at[1] and x[at[0] - 1 : os - 1] == y[at[1] - 1 : ns - 1] and (os > at[0] or at == (1, 1)) and oc + nc > 0
            same += os - at[0]
            at = (os + oc, ns + nc)
        assert x[at[0] - 1 :] == y[at[1] - 1 :]
        same += len(x) - at[0] + 1
        longest = lcs(x, y)
        assert same == longest if small == linediff.SMALL else same >= (longest + 3) // 4  # anchors may miss some of the longest, never all


def test_long_file(spark):
    """A file of 100,000 lines takes time near proportion, also if its lines repeat."""
    r = random.Random(1)
    took = {}
    for n in (10_000, 100_000):
        lines = [f"v{r.randrange(n // 20)}" if k % 3 else "}" for k in range(n)]
        changed = edited(r, lines, ["new", "}"], 0.02)
        a, b = table(spark, {"f": lines}).cache(), table(spark, {"f": changed}).cache()
        a.count(), b.count()
        began = time.time()
        found = cut(linediff.changes(a, b))
        assert linediff.applied(a, b, found).join(b, ["file", "line", "content"]).count() == len(changed)
        took[n] = time.time() - began
    assert took[100_000] < 6 * took[10_000]


def test_gaps_stay_whole(spark):
    """What is scanned gap by gap has an exchange of its own: that of a join by the same keys may be read by mapper (seen at sf0.1)."""
    rows = spark.createDataFrame([("f", 0, 0, 0, 1, b"a"), ("f", 0, 0, 1, 1, b"a")], "file string, ga bigint, gb bigint, side int, line bigint, h binary")
    gap = ["file", "ga", "gb"]
    joined = rows.join(rows.groupBy(*gap).count().where("count > 0"), gap).select(*rows.columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = linediff.scanned(joined, ["file"], ["side", "line"], linediff.compared)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("MapInArrow") < plan.index("REPARTITION_BY_COL") < plan.index("SortMergeJoin")


@pytest.mark.parametrize("seed", range(5))
def test_rising(seed):
    r = random.Random(seed)
    runs, a = [], 0
    places = list(range(9))
    r.shuffle(places)
    for k in places:
        runs.append((a, 100 * k, r.randint(1, 9)))
        a += 10
    best = max((sum(n for _, _, n in s) for m in range(1 << 9) if (s := [x for k, x in enumerate(runs) if m >> k & 1]) and all(p[1] < q[1] for p, q in zip(s, s[1:]))), default=0)
    got = linediff.rising(runs)
    assert sum(n for _, _, n in got) == best and all(p[1] < q[1] for p, q in zip(got, got[1:]))


def test_hunks(spark):
    """Ranges as the headers of a unified diff give them."""
    old = [f"l{k}" for k in range(1, 41)]
    new = list(old)
    new[9] = "changed"  # line 10
    new[14:15] = []  # line 15 goes: one hunk with the first, 4 lines between
    new += ["at the end"]
    a, b = table(spark, {"f": old, "gone": ["x", "y"], "top": ["1", "2"]}), table(spark, {"f": new, "made": ["x"], "top": ["0", "1", "2"]})
    found = linediff.changes(a, b)
    lengths = spark.createDataFrame([("f", 40, 40), ("gone", 2, 0), ("made", 0, 1), ("top", 2, 3)], "file string, na long, nb long")
    got = {tuple(r) for r in linediff.hunks(found, lengths).collect()}
    assert got == {("f", 7, 11, 17, "modified"), ("f", 37, 4, 40, "added"), ("gone", 1, 0, 1, "removed"), ("made", 1, 1, 1, "added"), ("top", 1, 3, 3, "added")}


def plain_merge(base, a, b, ca, cb):
    """Chunks of a diff3 over given changes, one by one."""
    every = sorted([(os, oc, ns, nc, "a") for os, oc, ns, nc in ca] + [(os, oc, ns, nc, "b") for os, oc, ns, nc in cb])
    chunks = []
    for c in every:
        if chunks and c[0] <= chunks[-1]["end"]:
            chunks[-1]["end"] = max(chunks[-1]["end"], c[0] + c[1])
            chunks[-1]["all"].append(c)
        else:
            chunks.append({"start": c[0], "end": c[0] + c[1], "all": [c]})

    def side(text, own, start, end):
        out, at = [], start
        for os, oc, ns, nc, _ in own:
            out += base[at - 1 : os - 1] + text[ns - 1 : ns - 1 + nc]
            at = os + oc
        return out + base[at - 1 : end - 1]

    for c in chunks:
        own = {s: [x for x in c["all"] if x[4] == s] for s in "ab"}
        same = all(own.values()) and side(a, own["a"], c["start"], c["end"]) == side(b, own["b"], c["start"], c["end"])
        yield c["start"], c["end"] - c["start"], "a" if not own["b"] else "b" if not own["a"] else "same" if same else "conflict"


def test_merge(spark):
    r = random.Random(4)
    base, a, b = {}, {}, {}
    for k in range(50):
        alphabet = [f"l{i}" for i in range(r.choice([3, 300]))]
        lines = [r.choice(alphabet) for _ in range(r.choice([0, 3, 30]))]
        base[f"f{k}"] = lines
        a[f"f{k}"], b[f"f{k}"] = edited(r, lines, ["x", "y"], 0.2), edited(r, lines, ["x", "y"], 0.2)
        if k % 9 == 0:
            b[f"f{k}"] = list(a[f"f{k}"])
    base |= {"del_mod": ["1", "2"], "del_del": ["1"], "touch": ["1", "2", "3"], "apart": ["1", "2", "3"]}
    a |= {"both_add": ["q"], "both_same": ["q"], "touch": ["x", "2", "3"], "apart": ["x", "2", "3"]}
    b |= {"del_mod": ["1", "z"], "both_add": ["r"], "both_same": ["q"], "touch": ["1", "x", "3"], "apart": ["1", "2", "x"]}
    tables = [table(spark, x) for x in (base, a, b)]
    got = linediff.merge_chunks(*tables)
    changes = [[tuple(r) for r in linediff.changes(tables[0], t).collect()] for t in tables[1:]]
    want = set()
    for f in {*base, *a, *b}:
        own = [[c[1:] for c in x if c[0] == f] for x in changes]
        want |= {(f, *c) for c in plain_merge(base.get(f, []), a.get(f, []), b.get(f, []), *own)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    conflicts = {r.file for r in linediff.conflicting_files(got).collect()}
    assert {"del_mod", "both_add", "touch"} <= conflicts and not {"del_del", "both_same", "apart"} & conflicts


def test_scans(spark):
    r = random.Random(2)
    rows = [(f"g{k % 3}", k, r.choice([None, None, k])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, p int, v int")
    got = {(x.g, x.p): x.c for x in scans.carried(df, ["g"], "p", F.col("v"), "c", segment=7).collect()}
    sums = {(x.g, x.p): x.c for x in scans.running_sum(df, ["g"], "p", F.coalesce("v", F.lit(0)).cast("bigint"), "c", segment=7).collect()}
    for g in ("g0", "g1", "g2"):
        last, total = None, 0
        for x, p, v in rows:
            if x == g:
                last, total = v if v is not None else last, total + (v or 0)
                assert got[g, p] == last and sums[g, p] == total


@pytest.mark.parametrize("seed", range(30))
def test_shortest(seed):
    r = random.Random(seed)
    x, y = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
    runs = linediff.shortest(x, y)
    assert sum(n for _, _, n in runs) == lcs(x, y)
    assert all(x[i : i + n] == y[j : j + n] and n > 0 for i, j, n in runs)
    assert all(i + n <= k and j + n <= m for (i, j, n), (k, m, _) in zip(runs, runs[1:]))
