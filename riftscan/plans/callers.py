"""Queries over a paged call graph: every line of a document calls the function that its first word names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.operators import adjacency, semantic
from riftscan.plans.moves import LINES_SQL, document_lines
from riftscan.plans.registry import query

#: Sites in a page of these queries.
PAGE = 64
CALLS_SQL = f"""WITH lines AS ({LINES_SQL}), calls AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS ref, concat('src/', doc_id, '.js') AS caller_file, line, regexp_extract(content, '[A-Za-z]+') AS called_function FROM lines)"""


def document_calls(s: SparkSession, d: str) -> DataFrame:
    name = F.regexp_extract("content", "[A-Za-z]+", 0)
    calls = document_lines(s, d).select(F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("ref"), F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("caller_file"), "line", name.alias("called_function"))
    return calls.where("called_function <> ''")


def shown(sites: str) -> Column:
    return F.array_join(F.transform(sites, lambda x: F.concat(x["caller_file"], F.lit(":"), x["line"].cast("string"))), "|")


@query(
    CALLS_SQL
    + f""", n AS (SELECT *, (row_number() OVER (PARTITION BY called_function ORDER BY caller_file, line) - 1) // {PAGE} AS page FROM calls WHERE called_function <> '')
SELECT called_function, CAST(page AS BIGINT) AS page, min(caller_file) AS first_file, arg_min(line, (caller_file, line)) AS first_line, max(caller_file) AS last_file, arg_max(line, (caller_file, line)) AS last_line, count(*) AS n_sites, count(*) AS n_calls,
 string_agg(concat(caller_file, ':', line), '|' ORDER BY caller_file, line) AS sites FROM n GROUP BY 1, 2"""
)
def call_pages(s: SparkSession, d: str) -> DataFrame:
    return adjacency.call_pages(document_calls(s, d), page=PAGE).withColumn("sites", shown("sites"))


def name_changes(calls: DataFrame) -> DataFrame:
    """Every called function is defined in the least file that calls it, and changed on A, B or both by the length of its name."""
    names = calls.groupBy(F.col("called_function").alias("name")).agg(F.min("caller_file").alias("file"))
    sides = F.array(
        F.struct(F.lit("base").alias("ref"), F.lit("a").alias("params")),
        F.struct(F.lit("A").alias("ref"), F.when(F.length("name") % 2 == 0, "a,b").otherwise("a").alias("params")),
        F.struct(F.lit("B").alias("ref"), F.when(F.length("name") % 3 == 0, "a,c").otherwise("a").alias("params")),
    )
    rows = names.select("name", "file", F.explode(sides).alias("side")).select("side.ref", "file", "name", F.split("side.params", ",").alias("params"), F.lit(0).alias("seq"))
    return semantic.signature_changes(rows)


@query(
    CALLS_SQL
    + """, named AS (SELECT called_function AS name, min(caller_file) AS file FROM calls WHERE called_function <> '' GROUP BY 1),
changed AS (SELECT 'A' AS branch, name, file, 'a,b' AS new_params FROM named WHERE length(name) % 2 = 0 UNION ALL SELECT 'B', name, file, 'a,c' FROM named WHERE length(name) % 3 = 0)
SELECT CASE WHEN branch <> ref THEN 'cross-branch' ELSE 'intra-branch' END AS scope, branch, name, file, 'a' AS old_params, new_params, count(*) AS n_calls FROM changed JOIN calls ON called_function = name WHERE branch <> ref OR caller_file <> file GROUP BY ALL"""
)
def stale_callers(s: SparkSession, d: str) -> DataFrame:
    calls = document_calls(s, d)
    pages = adjacency.call_pages(calls, ("ref", "called_function"))
    found = adjacency.stale_conflicts(name_changes(calls), pages)
    return found.drop("digest").withColumns({c: F.array_join(c, ",") for c in ("old_params", "new_params")})
