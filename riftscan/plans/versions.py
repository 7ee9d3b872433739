"""Queries over versions of the documents' lines: diffs, hunks and three-way merges.

The documents' lines are the base. Two branches delete, replace and insert
lines by rules on document and line number; in every fifth document both do
the same. Lines are numbered in their text where a query's SQL tells the
changes by key, since a diff of lines that are all different is the only one;
lines as they are, repeated ones included, are compared by what the changes
make of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.operators import linediff
from riftscan.plans.registry import query

#: Of each branch: which lines are deleted, replaced, and followed by a new one; and its mark.
RULES = {
    "a": ("(line * 7 + doc_id) % 13 = 5", "(line + doc_id) % 11 = 3", "(line + 2 * doc_id) % 17 = 7", "'A'"),
    "b": (
        "CASE WHEN doc_id % 5 = 0 THEN (line * 7 + doc_id) % 13 = 5 ELSE (line * 5 + doc_id) % 13 = 4 END",
        "CASE WHEN doc_id % 5 = 0 THEN (line + doc_id) % 11 = 3 ELSE (line + 3 * doc_id) % 11 = 3 END",
        "CASE WHEN doc_id % 5 = 0 THEN (line + 2 * doc_id) % 17 = 7 ELSE (line + doc_id) % 19 = 7 END",
        "CASE WHEN doc_id % 5 = 0 THEN 'A' ELSE 'B' END",
    ),
}


def lines_of(s: SparkSession, d: str, lines: str) -> DataFrame:
    """file, line, content of an array of lines of each document."""
    documents = s.read.parquet(f"{d}/documents.parquet").where("text is not null")
    rows = documents.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.expr(lines)).alias("line", "content"))
    return rows.select("file", (F.col("line") + 1).alias("line"), "content")


def content_of(numbered: bool) -> str:
    return "concat(CAST(i AS STRING), ': ', x)" if numbered else "x"


def base_lines(s: SparkSession, d: str, numbered: bool) -> DataFrame:
    return lines_of(s, d, f"transform(split(text, '\n'), (x, i) -> {content_of(numbered)})")


def version(s: SparkSession, d: str, branch: str, numbered: bool) -> DataFrame:
    """file, line, content of a branch's version, made inside each document's row."""
    deleted, replaced, followed, mark = (re.sub(r"\bline\b", "(i + 1)", rule) for rule in RULES[branch])
    content = content_of(numbered)
    kept = f"CASE WHEN NOT ({deleted}) THEN CASE WHEN {replaced} THEN concat('edit ', {mark}, ' ', {content}) ELSE {content} END END"
    added = f"CASE WHEN {followed} THEN concat('new ', {mark}, ' ', CAST(i + 1 AS STRING)) END"
    return lines_of(s, d, f"flatten(transform(split(text, '\n'), (x, i) -> filter(array({kept}, {added}), y -> y IS NOT NULL)))")


def versions_sql(numbered: bool) -> str:
    content = "concat(CAST(line - 1 AS VARCHAR), ': ', content)" if numbered else "content"
    parts = [
        "WITH raw AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL)",
        f"base AS MATERIALIZED (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, line, {content} AS content FROM raw)",
    ]
    for b, (deleted, replaced, followed, mark) in RULES.items():
        parts.append(
            f"{b} AS MATERIALIZED (SELECT file, old, part, same, content, row_number() OVER (PARTITION BY file ORDER BY old, part) AS line FROM (SELECT file, line AS old, 0 AS part, NOT ({replaced}) AS same, CASE WHEN {replaced} THEN concat('edit ', {mark}, ' ', content) ELSE content END AS content FROM base WHERE NOT ({deleted})"
            f" UNION ALL SELECT file, line, 1, false, concat('new ', {mark}, ' ', CAST(line AS VARCHAR)) FROM base WHERE {followed}))"
        )
        parts.append(
            f"kept_{b} AS (SELECT file, old, line FROM {b} WHERE same UNION ALL SELECT x.file, n + 1, coalesce(m, 0) + 1 FROM (SELECT file, max(line) AS n FROM base GROUP BY file) x LEFT JOIN (SELECT file, max(line) AS m FROM {b} GROUP BY file) y ON y.file = x.file)"
        )
        parts.append(
            f"changes_{b} AS MATERIALIZED (SELECT file, os AS old_start, old - os AS old_count, ns AS new_start, line - ns AS new_count FROM (SELECT *, coalesce(lag(old) OVER w, 0) + 1 AS os, coalesce(lag(line) OVER w, 0) + 1 AS ns FROM kept_{b} WINDOW w AS (PARTITION BY file ORDER BY old)) WHERE old > os OR line > ns)"
        )
    return ",\n".join(parts)


BIG = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("old_start", "old_count", "new_start", "new_count"))


@query(versions_sql(True) + f"\nSELECT file, {BIG} FROM changes_a")
def line_changes(s: SparkSession, d: str) -> DataFrame:
    base = base_lines(s, d, True)
    return linediff.changes(base, version(s, d, "a", True))


HUNKS_SQL = """,
ends AS (SELECT x.file, na, coalesce(nb, 0) AS nb FROM (SELECT file, max(line) AS na FROM base GROUP BY file) x LEFT JOIN (SELECT file, max(line) AS nb FROM a GROUP BY file) y ON y.file = x.file),
opened AS (SELECT *, CASE WHEN old_start - lag(old_start + old_count) OVER w <= 6 THEN 0 ELSE 1 END AS opens FROM changes_a WINDOW w AS (PARTITION BY file ORDER BY old_start, new_start)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY old_start, new_start) AS hunk FROM opened),
h AS (SELECT n.file, hunk, max(nb) AS nb, min(new_start) - least(3, min(old_start) - 1) AS first, least(max(new_start + new_count) - 1 + 3, max(nb)) AS last, max(new_count) > 0 AS plus, max(old_count) > 0 AS minus FROM numbered n JOIN ends e ON e.file = n.file GROUP BY n.file, hunk)
SELECT file, CAST(CASE WHEN last < first THEN greatest(1, first - 1) ELSE first END AS INTEGER) AS start_line, CAST(last - first + 1 AS INTEGER) AS line_count, CAST(CASE WHEN last < first THEN greatest(1, first - 1) ELSE last END AS INTEGER) AS end_line,
 CASE WHEN last < first THEN 'removed' WHEN plus AND minus THEN 'modified' WHEN plus THEN 'added' ELSE 'removed' END AS change_type FROM h"""


@query(versions_sql(True) + HUNKS_SQL)
def line_hunks(s: SparkSession, d: str) -> DataFrame:
    base = base_lines(s, d, True)
    new = version(s, d, "a", True)
    lengths = base.groupBy("file").agg(F.count("*").alias("na")).join(new.groupBy("file").agg(F.count("*").alias("nb")), "file", "left").select("file", "na", F.coalesce("nb", F.lit(0)).alias("nb"))
    return linediff.hunks(linediff.changes(base, new), lengths)


@query(versions_sql(False) + "\nSELECT file, count(*) AS n_lines, md5(string_agg(content, chr(10) ORDER BY line)) AS text_md5 FROM a GROUP BY file")
def line_diff_applied(s: SparkSession, d: str) -> DataFrame:
    """What the changes between lines as they are, repeated ones included, make of the base: the branch's text."""
    base = base_lines(s, d, False)
    new = version(s, d, "a", False)
    made = linediff.applied(base, new, linediff.changes(base, new))
    texts = made.groupBy("file").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("line", "content"))).alias("all"))
    return texts.select("file", "n_lines", F.md5(F.array_join(F.transform("all", lambda x: x["content"]), "\n")).alias("text_md5"))


MERGE_SQL = """,
both_sides AS (SELECT 'a' AS side, * FROM changes_a UNION ALL SELECT 'b', * FROM changes_b),
opened AS (SELECT *, CASE WHEN old_start <= max(old_start + old_count) OVER (PARTITION BY file ORDER BY old_start, old_count, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM both_sides),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY old_start, old_count, side ROWS UNBOUNDED PRECEDING) AS island FROM opened),
chunks AS (SELECT file, island, min(old_start) AS s, max(old_start + old_count) AS e, bool_or(side = 'a') AS in_a, bool_or(side = 'b') AS in_b FROM numbered GROUP BY file, island),
made AS (SELECT c.file, c.island, 'a' AS side, list(content ORDER BY line) AS text FROM chunks c JOIN a x ON x.file = c.file AND x.old + x.part >= c.s AND x.old < c.e GROUP BY ALL
 UNION ALL SELECT c.file, c.island, 'b', list(content ORDER BY line) FROM chunks c JOIN b x ON x.file = c.file AND x.old + x.part >= c.s AND x.old < c.e GROUP BY ALL)
SELECT c.file, CAST(s AS BIGINT) AS base_start, CAST(e - s AS BIGINT) AS base_count, CASE WHEN NOT in_b THEN 'a' WHEN NOT in_a THEN 'b' WHEN x.text IS NOT DISTINCT FROM y.text THEN 'same' ELSE 'conflict' END AS status
FROM chunks c LEFT JOIN made x ON x.file = c.file AND x.island = c.island AND x.side = 'a' LEFT JOIN made y ON y.file = c.file AND y.island = c.island AND y.side = 'b'"""


@query(versions_sql(True) + MERGE_SQL)
def merge_chunks(s: SparkSession, d: str) -> DataFrame:
    base = base_lines(s, d, True)
    return linediff.merge_chunks(base, version(s, d, "a", True), version(s, d, "b", True))


@query(f"SELECT DISTINCT file FROM ({versions_sql(True)}{MERGE_SQL}) WHERE status = 'conflict'")
def merge_conflicts(s: SparkSession, d: str) -> DataFrame:
    return linediff.conflicting_files(merge_chunks(s, d))
