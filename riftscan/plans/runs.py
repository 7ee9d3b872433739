"""What a run read, refused and wrote, and how long it took.

Rows that a step cannot take are not dropped in silence: the step writes all
rows once, in folders by outcome, and goes on with the accepted ones. Counts are
observed on the plan that writes, so that they cost no pass of their own, and
the clock runs while the rows are written, not while the plan is made.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riftscan.plans import analysis
from riftscan.plans.registry import query

ACCEPTED = "accepted"


def judged(rows: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``outcome``: the first reason that holds, else accepted. A reason that is null doesn't hold."""
    outcome = F.lit(ACCEPTED)
    for name, holds in reversed(reasons.items()):
        outcome = F.when(holds, name).otherwise(outcome)
    return rows.withColumn("outcome", outcome)


def line_reasons() -> dict[str, Column]:
    """Why a line (file, line, content) is not scanned."""
    return {
        "no file": F.col("file").isNull() | (F.col("file") == ""),
        "no content": F.col("content").isNull(),
        "binary content": F.contains("content", F.lit("\0")),
    }


def outcomes(rows: DataFrame) -> DataFrame:
    """outcome, n_rows, n_files of judged lines."""
    return rows.groupBy("outcome").agg(F.count("*").alias("n_rows"), F.countDistinct("file").alias("n_files"))


class Run:
    """A run whose steps write tables under ``path``; each step leaves its counts and time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.steps = spark, path, []

    def place(self, name: str) -> str:
        return f"{self.path}/{name}"

    def timed(self, step: str, rows: DataFrame, counts: Mapping[str, Column], by: tuple[str, ...] = ()) -> None:
        seen = Observation(f"riftscan {step}")
        watched = rows.observe(seen, *[c.alias(name) for name, c in counts.items()])
        began = time.monotonic()
        watched.write.mode("overwrite").partitionBy(*by).parquet(self.place(step))
        took = int(1000 * (time.monotonic() - began))
        self.steps += [(step, name, int(n), took) for name, n in seen.get.items()]

    def admit(self, step: str, rows: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
        """The accepted rows, as written. The refused ones are in the same table, by outcome."""
        names = [ACCEPTED, *reasons]
        self.timed(step, judged(rows, reasons), {n: F.count_if(F.col("outcome") == n) for n in names}, ("outcome",))
        return self.outcome(step, rows).where(F.col("outcome") == ACCEPTED).drop("outcome")

    def outcome(self, step: str, rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return self.spark.read.schema(f"{schema}, outcome string").parquet(self.place(step))

    def keep(self, step: str, rows: DataFrame) -> DataFrame:
        """``rows`` written and read again."""
        self.timed(step, rows, {"written": F.count(F.lit(1))})
        return self.spark.read.schema(rows.schema).parquet(self.place(step))

    def metrics(self) -> DataFrame:
        """step, outcome, n_rows, ms: a row for each count of each step, as few as the steps have names."""
        return self.spark.createDataFrame(self.steps, "step string, outcome string, n_rows bigint, ms bigint")


def security_run(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Risks of added lines (file, line, content), the refused lines with their outcome, and the metrics; all but the last are tables under ``path``."""
    run = Run(lines.sparkSession, path)
    rows = lines.select("file", "line", "content")
    accepted = run.admit("lines", rows, line_reasons())
    risks = run.keep("risks", analysis.security_risks(accepted))
    return risks, run.outcome("lines", rows).where(F.col("outcome") != ACCEPTED), run.metrics()


#: Lines of documents with faults by document and line.
FAULTY_SQL = """WITH lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM documents WHERE text IS NOT NULL),
judged AS (SELECT concat('d', doc_id) AS file, line, CASE WHEN doc_id % 17 IN (3, 5) THEN 'no file' WHEN (line + doc_id) % 7 = 0 THEN 'no content' WHEN (line * 3 + doc_id) % 11 = 0 THEN 'binary content' ELSE 'accepted' END AS outcome, doc_id % 17 AS k FROM lines)"""


def faulty_lines(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    line, doc = F.col("at") + 1, F.col("doc_id")
    file = F.when(doc % 17 == 3, F.lit("")).when(doc % 17 != 5, F.concat(F.lit("d"), doc.cast("string")))
    content = F.when((line + doc) % 7 == 0, F.lit(None)).when((line * 3 + doc) % 11 == 0, F.concat("content", F.lit("\0"))).otherwise(F.col("content"))
    return rows.select(file.alias("file"), line.cast("int").alias("line"), content.alias("content"))


@query(FAULTY_SQL + " SELECT outcome, count(*) AS n_rows, count(DISTINCT CASE k WHEN 5 THEN NULL WHEN 3 THEN '' ELSE file END) AS n_files FROM judged GROUP BY 1")
def line_outcomes(s: SparkSession, d: str) -> DataFrame:
    return outcomes(judged(faulty_lines(s, d), line_reasons()))


@query(FAULTY_SQL + " SELECT CASE k WHEN 5 THEN NULL WHEN 3 THEN '' ELSE file END AS file, line, outcome FROM judged WHERE outcome <> 'accepted'")
def rejected_lines(s: SparkSession, d: str) -> DataFrame:
    return judged(faulty_lines(s, d), line_reasons()).where(F.col("outcome") != ACCEPTED).select("file", "line", "outcome")
