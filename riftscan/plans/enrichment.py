"""A query over the ways that risks are explained: every document is an analysis, each of its lines a risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.operators import report
from riftscan.operators.findings import PENDING
from riftscan.plans.moves import LINES_SQL, document_lines
from riftscan.plans.registry import query

PATHS_SQL = f"""WITH lines AS ({LINES_SQL}), risks AS (SELECT CAST(doc_id AS VARCHAR) AS analysis_id, concat('r', line) AS id, doc_id, line, CASE WHEN line % 4 = 3 THEN 'kept' ELSE '{PENDING}' END AS old,
 doc_id % 3 = 0 AS has_service, doc_id % 2 = 0 AS has_key, (doc_id + line) % 29 <> 0 AS answered FROM lines),
whole AS (SELECT analysis_id, bool_and(answered) AS complete, doc_id % 5 > 0 AS direct FROM risks GROUP BY analysis_id, doc_id)
SELECT analysis_id, id,
 CASE WHEN complete AND (has_service OR NOT has_key) THEN 'service' WHEN NOT has_key THEN 'none' WHEN NOT direct THEN 'direct failed' ELSE 'direct' END AS path,
 CASE WHEN complete AND (has_service OR NOT has_key) THEN concat('said ', line) WHEN NOT has_key THEN CASE WHEN has_service THEN '{report.NO_SERVICE[0]}' ELSE '{report.NOTHING_SET[0]}' END
  WHEN NOT direct THEN CASE WHEN old = 'kept' THEN 'kept' ELSE '{report.NO_KEY_ANSWER[0]}' END WHEN line % 2 = 1 THEN concat('direct ', line) ELSE old END AS explanation,
 CASE WHEN complete AND (has_service OR NOT has_key) THEN '{report.FOLLOW_TEXT}' WHEN NOT has_key THEN '{report.NOTHING_SET[1]}'
  WHEN NOT direct THEN CASE WHEN old = 'kept' THEN 'kept' ELSE '{report.NO_KEY_ANSWER[1]}' END WHEN line % 2 = 1 THEN 'fix' ELSE old END AS recommendation
FROM risks JOIN whole USING (analysis_id)"""


@query(PATHS_SQL)
def enrichment_paths(s: SparkSession, d: str) -> DataFrame:
    doc, line = F.col("doc_id"), F.col("line")
    old = F.when(line % 4 == 3, "kept").otherwise(PENDING)
    keys = [doc.cast("string").alias("analysis_id"), F.concat(F.lit("r"), line.cast("string")).alias("id")]
    lines = document_lines(s, d)
    risks = lines.select(*keys, old.alias("explanation"), old.alias("recommendation"))
    settings = s.read.parquet(f"{d}/documents.parquet").select(keys[0], (doc % 3 == 0).alias("has_service"), (doc % 2 == 0).alias("has_key")).distinct()
    service = lines.select(*keys, F.when((doc + line) % 29 != 0, F.concat(F.lit("said "), line.cast("string"))).alias("explanation"))
    direct = lines.where(doc % 5 > 0).select(*keys, F.when(line % 2 == 1, F.concat(F.lit("direct "), line.cast("string"))).otherwise("").alias("explanation"), F.when(line % 2 == 1, "fix").otherwise("").alias("recommendation"), F.lit(0).alias("seq"))
    return report.enrich_by_path(risks, settings, service, direct).select("analysis_id", "id", "path", "explanation", "recommendation")
