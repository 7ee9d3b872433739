"""Queries over the git source, on a repository made from ``nation``; their SQL follows from its keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.operators import commits, diff
from riftscan.plans import analysis
from riftscan.plans.gitfixture import repository
from riftscan.plans.registry import query
from riftscan.sources import gitrepo

A, B = "feature", "other"
N_SQL = "WITH n AS (SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name, concat('src/n', CAST(n_nationkey AS STRING), '.js') AS path, concat('moved/n', CAST(n_nationkey AS STRING), '.js') AS moved, concat('src/a', CAST(n_nationkey AS STRING), '.js') AS added FROM nation)"
RANGES_SQL = N_SQL + """, ranges AS (SELECT 'feature' AS branch, path, 3 AS start_line, 7 AS line_count, 9 AS end_line, 'modified' AS change_type FROM n WHERE k % 5 = 0
 UNION ALL SELECT 'feature', path, 1, 0, 1, 'removed' FROM n WHERE k % 5 = 1 UNION ALL SELECT 'feature', added, 1, 3, 3, 'added' FROM n WHERE k % 5 = 3
 UNION ALL SELECT 'other', path, 3, 7, 9, 'modified' FROM n WHERE k % 4 = 0 UNION ALL SELECT 'other', path, 9, 4, 12, 'modified' FROM n WHERE k % 4 = 1)"""


def load(s: SparkSession, d: str, table: str, **options: str) -> DataFrame:
    return gitrepo.load(s, repository(s, d), table, **options)


@query("""SELECT name, short_name, is_remote, is_current, 40 AS sha_chars FROM (SELECT concat('refs/heads/', b) AS name, b AS short_name, false AS is_remote, b = 'feature' AS is_current
 FROM (SELECT 'main' AS b UNION ALL SELECT 'feature' UNION ALL SELECT 'other' UNION ALL SELECT concat('region/', replace(r_name, ' ', '-')) FROM region) UNION ALL SELECT 'refs/remotes/origin/main', 'origin/main', true, false)""")
def git_refs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "refs").select("name", "short_name", "is_remote", "is_current", F.length("sha").alias("sha_chars"))


@query("SELECT 'main' AS asked, true AS is_branch, true AS same_as_main UNION ALL SELECT 'origin/main', true, true UNION ALL SELECT 'feature', true, false UNION ALL SELECT 'nowhere', false, false")
def git_branch_names(s: SparkSession, d: str) -> DataFrame:
    refs = load(s, d, "refs")
    asked = ("main", "origin/main", A, "nowhere")
    return s.createDataFrame([(b, commits.branch_exists(refs, b), commits.branches_are_identical(refs, "main", b)) for b in asked], "asked string, is_branch boolean, same_as_main boolean")


@query("SELECT message, 'Ada' AS author, 'ada@x.org' AS email, CAST(1704164645 AS BIGINT) AS at, true AS is_short FROM (SELECT 'all nations' AS message UNION ALL SELECT 'lines of feature' UNION ALL SELECT 'files of feature')")
def git_commits(s: SparkSession, d: str) -> DataFrame:
    found = load(s, d, "commits", ref=A)
    return found.select("message", "author", "email", F.unix_seconds(F.to_timestamp("date")).alias("at"), F.startswith("sha", "short_sha").alias("is_short"))


@query("SELECT CAST(2 AS BIGINT) AS ahead_a, CAST(1 AS BIGINT) AS ahead_b, true AS diverged, 'all nations' AS base, true AS same_base")
def git_divergence(s: SparkSession, d: str) -> DataFrame:
    """Commits ahead and the merge base by the edges table, and whether git names the same base."""
    refs, edges = load(s, d, "refs"), load(s, d, "edges")
    a, b = (commits.resolve_ref(refs, name)[1] for name in (A, B))
    base = commits.merge_bases(edges, a, b).join(load(s, d, "commits", ref=A), F.col("node") == F.col("sha"))
    return commits.commits_ahead(edges, a, b).join(base.select(F.col("message").alias("base"), (F.col("sha") == gitrepo.merge_base(repository(s, d), A, B)).alias("same_base")))


def both_sides(s: SparkSession, d: str, part: int) -> DataFrame:
    root = repository(s, d)
    base = gitrepo.merge_base(root, A, B)
    a, b = (analysis.changes(s, root, base, name)[part].withColumn("branch", F.lit(name)) for name in (A, B))
    return a.unionByName(b)


@query(N_SQL + """ SELECT branch, path, old_path, status, CAST(additions AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions, false AS is_binary FROM (SELECT 'feature' AS branch, path, CAST(NULL AS VARCHAR) AS old_path, CASE k % 5 WHEN 0 THEN 'modified' ELSE 'deleted' END AS status, 0 AS additions FROM n WHERE k % 5 < 2
 UNION ALL SELECT 'feature', moved, path, 'renamed', 0 FROM n WHERE k % 5 = 2 UNION ALL SELECT 'feature', added, NULL, 'added', 3 FROM n WHERE k % 5 = 3 UNION ALL SELECT 'other', path, NULL, 'modified', 0 FROM n WHERE k % 4 < 2)""")
def git_changed_files(s: SparkSession, d: str) -> DataFrame:
    return both_sides(s, d, 1)


@query(RANGES_SQL + " SELECT * FROM ranges")
def git_changed_ranges(s: SparkSession, d: str) -> DataFrame:
    return both_sides(s, d, 2)


@query(N_SQL + """, kept AS (SELECT CASE WHEN k % 5 = 2 THEN moved ELSE path END AS path, string_agg(CASE WHEN i = 6 AND k % 5 = 0 THEN concat('feature ', CAST(k AS STRING)) ELSE concat('row ', CAST(i AS STRING), ' of ', name) END, chr(10) ORDER BY i) AS body FROM n CROSS JOIN (SELECT unnest(range(1, 13)) AS i) WHERE k % 5 <> 1 GROUP BY ALL)
 SELECT path, md5(concat(body, chr(10))) AS source_md5 FROM kept UNION ALL SELECT added, md5(concat('one ', name, chr(10), 'two ', name, chr(10), 'eval(v', CAST(k AS STRING), ')', chr(10))) FROM n WHERE k % 5 = 3""")
def git_sources(s: SparkSession, d: str) -> DataFrame:
    """Every tracked file of the branch with its content."""
    tracked = load(s, d, "tree", ref=A).select("path")
    return load(s, d, "files", ref=A).join(tracked, "path", "left_semi").select("path", F.md5("source").alias("source_md5"))


@query(N_SQL + " SELECT path AS file FROM n WHERE (k % 5 = 0 AND k % 4 = 0) OR (k % 5 = 1 AND k % 4 < 2)")
def git_merge_conflicts(s: SparkSession, d: str) -> DataFrame:
    return diff.conflicting_paths(load(s, d, "merge_tree", base=A, ref=B)).select("file")


@query(N_SQL + """ SELECT path AS file, CASE WHEN k % 5 = 0 THEN 'HIGH' WHEN k % 4 = 0 THEN 'LOW' WHEN k % 4 = 1 THEN 'SAFE' ELSE 'HIGH' END AS overlap_level, k % 5 = 1 AND k % 4 < 2 OR k % 5 = 0 AND k % 4 = 0 AS has_conflict,
 CAST(CASE WHEN k % 5 = 0 AND k % 4 = 0 THEN 0.95 WHEN k % 4 < 2 THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence FROM n WHERE k % 5 = 1 OR (k % 5 = 0 AND k % 4 < 2)""")
def git_candidates(s: SparkSession, d: str) -> DataFrame:
    """The whole analysis of two branches: files that overlap, conflict or were deleted."""
    return analysis.analyze_branches(s, repository(s, d), A, B).candidates.select("file", "overlap_level", "has_conflict", "confidence")


@query(N_SQL + " SELECT 'other' AS branch, path AS file, CASE WHEN k % 5 = 0 THEN 'HIGH_RISK' ELSE 'LOW_RISK' END AS risk, CASE WHEN k % 5 = 0 THEN 60 ELSE 10 END AS score FROM n WHERE k % 5 < 2 AND k % 4 < 2")
def git_sweep(s: SparkSession, d: str) -> DataFrame:
    return analysis.sweep_branches(s, repository(s, d)).select("branch", "file", "risk", "score")


@query(N_SQL + " SELECT added AS file, 3 AS line, 'unsafe_eval' AS category, 'high' AS risk_level FROM n WHERE k % 5 = 3")
def git_diff_security(s: SparkSession, d: str) -> DataFrame:
    """Security risks of the lines that the branch adds."""
    return analysis.analyze_security(both_sides(s, d, 0).where(F.col("branch") == A)).select("file", "line", "category", "risk_level")


@query(N_SQL + """ SELECT false AS is_clean, string_agg(path, '|' ORDER BY path) FILTER (WHERE k % 5 = 4 AND k % 2 = 0) AS staged, string_agg(path, '|' ORDER BY path) FILTER (WHERE k % 5 = 4 AND k % 2 = 1) AS modified,
 string_agg(concat('untracked', CAST(k AS STRING), '.txt'), '|' ORDER BY concat('untracked', CAST(k AS STRING), '.txt')) FILTER (WHERE k % 6 = 0) AS untracked FROM n""")
def git_status(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "status").select("is_clean", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("staged", "modified", "untracked")])
