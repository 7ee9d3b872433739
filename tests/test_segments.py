"""A diff cut into segments gives the rows of a plain reading from top to bottom."""

import random
import re

from pyspark.sql import functions as F

from riftscan.operators import diff
from riftscan.sources import gitrepo

PIECES = [
    "diff --git a/x.js b/x.js", "diff --git a/y.py b/z.py", "+++ b/x.js", "+++ b/q", "+++ /dev/null", "--- a/x.js", "@@ -1,2 +7,3 @@ f", "@@ -3 +40 @@", "@@  -1 +5  @@", "@@ odd",
    "+one", "+two", "+", " ctx", " more", "", "-gone", "\\ No newline at end of file", "index 1..2", "+++ other", "Binary files a/x and b/x differ", "GIT binary patch",
]


def replay(raw):
    """(file, line, content, seq) by the rules of one reader with a state."""
    out, name, number = [], None, 0
    named = seen = False
    for seq, line in enumerate(raw.split("\n")):
        head = re.match(r"diff --git a/(.*) b/(.*)$", line)
        if head:
            name, number, named, seen = head.group(2), 0, True, False
        elif line.startswith("+++ b/"):
            name, number, named, seen = line[6:], 0, True, False
        elif line.startswith("+++ /dev/null"):
            name, named, seen = None, False, False
        elif line.startswith("--- "):
            pass
        elif re.match(r"@@\s+-\d+(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@", line):
            number = int(re.match(r"@@\s+-\d+(?:,\d+)?\s+\+(\d+)", line).group(1))
        elif line.startswith((*diff.METADATA, "+++ ")):
            pass
        elif line.startswith("+"):
            if not named and not seen:
                number, seen = 1, True
            out.append((name if named else "unknown_file", number, line[1:], seq))
            number += 1
        elif not line.startswith(("-", "\\")) and (named or seen):
            number += 1
    return out


def ranges_by_hand(raw):
    """Paths and ranges of each section, in plain Python."""
    found, section = {}, None
    sections = []
    for seq, line in enumerate(raw.split("\n")):
        if line.startswith("diff --git "):
            m = re.match(r"diff --git a/.+ b/(.+)$", line)
            section = {"path": m.group(1).strip() if m else "", "lines": [], "binary": False}
            sections.append(section)
        elif section is not None:
            section["lines"].append((seq, line))
            section["binary"] |= "Binary files" in line or "GIT binary patch" in line
    for s in sections:
        if s["path"] in ("", "/dev/null"):
            continue
        ranges = found.setdefault(s["path"], [])
        if s["binary"]:
            ranges.clear()
            continue
        hunk = None
        for seq, line in s["lines"]:
            if line.startswith("@@"):
                m = re.match(diff.HUNK, line)
                hunk = {"seq": seq, "start": int(m.group(3)), "n": int(m.group(4) or 1), "plus": False, "minus": False} if m else None
                if hunk:
                    ranges.append(hunk)
                    line = re.sub(diff.HUNK, "", line)
            if hunk:
                hunk["plus"] |= line.startswith("+") and not line.startswith("+++")
                hunk["minus"] |= line.startswith("-") and not line.startswith("---")
    out = set()
    for path, ranges in found.items():
        for h in ranges:
            kind = "removed" if h["n"] == 0 or (h["minus"] and not h["plus"]) else "added" if h["plus"] and not h["minus"] else "modified"
            out.add((path, h["seq"], h["start"], h["n"], kind))
        if not ranges:
            out.add((path, None, None, None, None))
    return out


def texts():
    r = random.Random(5)
    return ["\n".join(r.choice(PIECES) for _ in range(r.choice((0, 1, 5, 30, 90)))) for _ in range(120)] + ["+a\n+b", "﻿diff --git a/x b/x\n@@ -1 +1 @@\n+a"]


def test_random_diffs(spark):
    raws = texts()
    df = spark.createDataFrame(list(enumerate(raws)), "diff_id int, raw string")
    want = sorted((i, *row) for i, raw in enumerate(raws) for row in replay(raw))
    for segment in (1, 3, 1 << 16):
        got = sorted((x.diff_id, x.file, x.line, x.content, x.seq) for x in diff.added_lines(df, segment).collect())
        assert got == want
    expected = sorted(((i, *row) for i, raw in enumerate(raws) for row in ranges_by_hand(raw.removeprefix("﻿"))), key=str)
    for segment in (2, 1 << 16):
        ranges = diff.changed_ranges(df, segment).collect()
        assert sorted(((x.diff_id, x.path, x.seq, x.start_line, x.line_count, x.change_type) for x in ranges), key=str) == expected


def test_large_file_in_blocks(spark, tmp_path):
    r = random.Random(6)
    (tmp_path / "in").mkdir()
    text = "\n".join(r.choice(PIECES) + ("x" * r.randrange(40) if r.random() < 0.3 else "") for _ in range(20_000)) + "\n"
    (tmp_path / "in" / "a.diff").write_text(text)
    (tmp_path / "in" / "b.diff").write_text("+one\r\n+two")
    (tmp_path / "in" / "c.diff").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        lines = gitrepo.read_diff_lines(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 8
        rows = diff.added_lines_of(lines, 1000).withColumn("diff_id", F.regexp_extract("diff_id", r"[^/]+$", 0)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [("a.diff", *x) for x in replay(text)] + [("b.diff", "unknown_file", 1, "one\r", 0), ("b.diff", "unknown_file", 2, "two", 1)]
    assert sorted(tuple(x[c] for c in ("diff_id", "file", "line", "content", "seq")) for x in rows) == sorted(want)
