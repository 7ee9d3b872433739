"""Queries over moved files: renames between versions of the documents' lines, and similar files among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.operators import renames
from riftscan.plans.registry import query


def document_lines(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return rows.withColumn("line", F.col("line") + 1)


#: Every document's file is deleted and added under another path; some lines of it are edited, by document and line.
EDITED = "doc_id % 3 > 0 AND (line * 7 + doc_id) % (6 + doc_id % 37) = 0"
LINES_SQL = "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL"


@query(
    f"""WITH lines AS ({LINES_SQL}), marked AS (SELECT doc_id, strlen(concat(doc_id, ':', line, ' ', content)) + 1 AS size, strlen(concat('edit ', doc_id, ':', line)) + 1 AS edit_size, {EDITED} AS edited FROM lines),
files AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS old_size, CAST(sum(CASE WHEN edited THEN edit_size ELSE size END) AS BIGINT) AS new_size, CAST(sum(CASE WHEN edited THEN 0 ELSE size END) AS BIGINT) AS shared FROM marked GROUP BY doc_id)
SELECT concat('src/', doc_id, '.txt') AS old_path, concat('lib/', doc_id, '.txt') AS new_path, CAST(100 * shared // greatest(old_size, new_size) AS INTEGER) AS score FROM files WHERE 100 * shared >= 90 * greatest(old_size, new_size)"""
)
def renamed_files(s: SparkSession, d: str) -> DataFrame:
    """Lines carry document and number, so that each file's only partner is its own edited version."""
    lines = document_lines(s, d).withColumn("content", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("content")))
    edit = F.concat(F.lit("edit "), F.col("doc_id").cast("string"), F.lit(":"), F.col("line").cast("string"))
    old = lines.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "line", "content")
    new = lines.select(F.concat(F.lit("lib/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "line", F.when(F.expr(EDITED), edit).otherwise(F.col("content")).alias("content"))
    return renames.renames(old, new)


# The pairs in plain form: all lines of both sides are joined, and contents compared as wholes.
SIMILAR_SQL = f"""WITH lines AS ({LINES_SQL}), texts AS (SELECT doc_id % 2 AS side, text, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS rep, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2),
chunks AS (SELECT side, rep, copies, u AS content, CAST(count(*) * (strlen(u) + 1) AS BIGINT) AS weight FROM (SELECT side, rep, copies, unnest(string_split(text, chr(10))) AS u FROM texts) GROUP BY side, rep, copies, u),
sizes AS (SELECT side, rep, copies, sum(weight) AS size FROM chunks GROUP BY side, rep, copies),
shared AS (SELECT a.rep AS old_rep, b.rep AS new_rep, sum(least(a.weight, b.weight)) AS shared FROM chunks a JOIN chunks b ON a.content = b.content AND a.side = 0 AND b.side = 1 GROUP BY 1, 2)
SELECT old_rep, new_rep, a.copies AS old_copies, b.copies AS new_copies, CAST(100 * shared // greatest(a.size, b.size) AS INTEGER) AS score
FROM shared JOIN sizes a ON a.rep = old_rep AND a.side = 0 JOIN sizes b ON b.rep = new_rep AND b.side = 1 WHERE 100 * shared >= 60 * greatest(a.size, b.size)"""


@query(SIMILAR_SQL)
def similar_files(s: SparkSession, d: str) -> DataFrame:
    """Documents with even ids against those with odd ones, as they are: pairs of different contents, at 60 percent."""
    lines = document_lines(s, d).select(F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "line", "content")
    old, new = (lines.where(F.col("doc_id") % 2 == side).drop("doc_id") for side in (0, 1))
    of_old, of_new = (renames.content_classes(x)[1] for x in (old, new))
    pairs = renames.similar_classes(old, new, of_old, of_new, 60)
    return pairs.join(of_old.select(F.col("rep").alias("old_rep"), F.col("copies").alias("old_copies")), "old_rep").join(of_new.select(F.col("rep").alias("new_rep"), F.col("copies").alias("new_copies")), "new_rep").select(
        "old_rep", "new_rep", "old_copies", "new_copies", "score"
    )
