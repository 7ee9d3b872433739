"""Two-phase output that a repeated batch does not write twice.

A batch's rows of a phase are a folder of their own, named by phase and batch
and overwritten as a whole; that they are complete is one row in a ledger,
written after them. A batch that was stopped in between is done again from the
first phase without an entry, and readers see only what the ledger has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHASES = ("raw", "enriched")
ENTRY = "n_rows bigint, written timestamp"


def place(path: str, what: str, phase: str, batch: int) -> str:
    return f"{path}/{what}/phase={phase}/batch={batch}"


def entered(spark: SparkSession, path: str, phase: str, batch: int) -> bool:
    """Whether the ledger says that the batch's rows of the phase are complete."""
    try:
        return not spark.read.schema(ENTRY).parquet(place(path, "ledger", phase, batch)).isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def write_phase(rows: DataFrame, path: str, phase: str, batch: int) -> None:
    spark, folder = rows.sparkSession, place(path, "rows", phase, batch)
    rows.write.mode("overwrite").parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    entry = written.agg(F.count("*").alias("n_rows")).select("n_rows", F.current_timestamp().alias("written"))
    entry.coalesce(1).write.mode("overwrite").parquet(place(path, "ledger", phase, batch))


def two_phase_table(path: str, enrich: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: raw rows at once, then the enriched ones, made from the raw ones as written."""

    def of(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not entered(spark, path, "raw", number):
            write_phase(batch, path, "raw", number)
        if not entered(spark, path, "enriched", number):
            raw = spark.read.schema(batch.schema).parquet(place(path, "rows", "raw", number))
            write_phase(enrich(raw), path, "enriched", number)

    return of


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """phase, batch, n_rows, written of what is complete."""
    return spark.read.schema(f"{ENTRY}, phase string, batch bigint").parquet(f"{path}/ledger")


def phase_rows(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """All complete rows of a phase, with their batch."""
    rows = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", "true").parquet(f"{path}/rows/phase={phase}").withColumn("batch", F.col("batch").cast("bigint"))
    return rows.join(ledger(spark, path), ["phase", "batch"], "left_semi").drop("phase")
