"""Whole analyses: of added lines, of two branches of a repository, of all its branches.

Each is one lazy plan over the sources; nothing is gathered but the few names
and counts that decide what to read (references, the merge base).
"""

from __future__ import annotations

import time
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.errors import ScanError
from riftscan.functions import text
from riftscan.operators import commits, diff, findings, ranges, report, rules, score, secrets, semantic
from riftscan.sources import gitrepo, jsparse

MAIN = "main"


def merged_risks(lines: DataFrame) -> DataFrame:
    """Merged risks of added lines (file, line, content), in no order; secrets are masked in all of them."""
    shown = text.truncate(text.trim_all(secrets.masked()))
    found = findings.all_findings(secrets.scan_secrets(lines), rules.scan_injections(lines, snippet=shown))
    return findings.merge_findings(found, ([r[0] for r in secrets.RULES], [r.category for r in rules.INJECTION_RULES]))


def security_risks(lines: DataFrame) -> DataFrame:
    """``merged_risks``, most severe first."""
    return findings.ranked(merged_risks(lines))


def analyze_security(diffs: DataFrame) -> DataFrame:
    """Risks of unified diffs (diff_id, raw), with ids, in the common shape."""
    return findings.adapt_security(findings.with_ids(security_risks(diff.added_lines(diffs))))


class BranchPair(NamedTuple):
    files: DataFrame
    ranges_a: DataFrame
    ranges_b: DataFrame
    candidates: DataFrame
    conflicts: DataFrame  # semantic
    risk: DataFrame
    diffs_a: DataFrame
    facts: dict[str, object]


def changes(spark: SparkSession, path: str, base: str, ref: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diff text, changed files and changed ranges of ``ref`` against ``base``."""
    raw = gitrepo.load(spark, path, "diff", base=base, ref=ref)
    status = diff.name_status(gitrepo.load(spark, path, "name_status", base=base, ref=ref)).drop("diff_id", "seq")
    found = diff.changed_ranges(raw).where("start_line is not null").drop("diff_id", "seq")
    return raw, ranges.branch_files(status, found), found


def sources(spark: SparkSession, path: str, changed: DataFrame, refs: dict[str, str]) -> DataFrame:
    """ref, file, source of the JavaScript files that changed or are tracked on either branch, on the base and both branches."""
    tracked = reduce(DataFrame.union, [gitrepo.load(spark, path, "tree", ref=refs[r]).select("path") for r in ("A", "B")])
    wanted = changed.where(text.is_js_path(F.col("path"))).select("path").union(tracked.where(text.has_js_suffix(F.col("path")))).distinct()
    read = [gitrepo.load(spark, path, "files", ref=sha).withColumn("ref", F.lit(name)) for name, sha in refs.items()]
    return reduce(DataFrame.unionByName, read).join(wanted, "path", "left_semi").select("ref", F.col("path").alias("file"), "source")


def semantic_conflicts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Stale callers in sources (ref, file, source). Each source is parsed once for each of the two tables."""
    jsparse.register(spark)
    signatures = spark.sql("SELECT s.ref, s.file, f.name, f.params, f.seq FROM {s} s, LATERAL js_signatures(s.source) f", s=files)
    calls = spark.sql("SELECT s.ref, s.file AS caller_file, f.called_function, f.line FROM {s} s, LATERAL js_call_sites(s.source) f", s=files.where("ref <> 'base'"))
    known = files.where("ref = 'base' and source <> ''").select("file")
    return semantic.semantic_conflicts(semantic.signature_changes(signatures, known), calls)


def analyze_branches(spark: SparkSession, path: str, a: str | None = None, b: str | None = None) -> BranchPair:
    """Everything about two branches; ``a`` is the current branch and ``b`` main unless named."""
    began = time.time()
    repo = gitrepo.open_repository(path)
    refs = gitrepo.load(spark, path, "refs")
    current = refs.where("is_current").first()
    if a is None and current is None:
        raise ScanError("UNSUPPORTED_REPO_STATE", "no current branch: the head is detached")
    names = {"A": a or current["short_name"], "B": b or MAIN}
    shas = {side: commits.resolve_ref(refs, name)[1] for side, name in names.items()}
    base = gitrepo.merge_base(repo["root"], shas["A"], shas["B"])
    edges = gitrepo.load(spark, path, "edges")
    ahead = {side: commits.unique_commits(edges, base, sha).count() for side, sha in shas.items()}
    raw_a, files_a, ranges_a = changes(spark, path, base, shas["A"])
    _, files_b, ranges_b = changes(spark, path, base, shas["B"])
    files = ranges.merge_branch_files(files_a, files_b, ranges_a, ranges_b)
    hits = diff.conflicting_paths(gitrepo.load(spark, path, "merge_tree", base=shas["A"], ref=shas["B"]))
    by_file = [r.withColumnRenamed("path", "file") for r in (ranges_a, ranges_b)]
    candidates = ranges.conflict_candidates(files, *by_file, hits)
    stale = semantic_conflicts(spark, sources(spark, path, files, {"base": base, **shas}).persist())
    risk = score.repo_risk(candidates, files, ahead["A"], ahead["B"])
    facts = {"root": repo["root"], "git_version": repo["version"], "branches": names, "shas": shas, "merge_base": base, "ahead_a": ahead["A"], "ahead_b": ahead["B"], "diverged": ahead["A"] > 0 and ahead["B"] > 0, "planned_ms": int(1000 * (time.time() - began))}
    return BranchPair(files, *by_file, candidates, stale, risk, raw_a, facts)


def branch_risks(pair: BranchPair, security: bool = True) -> DataFrame:
    """All risks of a pair: overlaps and merge conflicts, stale callers, and what branch A's added lines hold."""
    parts = [report.conflict_risks(pair.candidates), report.semantic_risks(pair.conflicts)]
    if security:
        parts.append(analyze_security(pair.diffs_a))
    return report.all_risks(*parts)


def git_result(pair: BranchPair) -> DataFrame:
    """One row: repository, branches, commits, files, conflicts, stale callers and the risk, nested."""
    f = pair.facts
    gathered = lambda df, name, key: df.agg(F.sort_array(F.collect_list(F.struct(key, F.struct("*").alias("row")))).alias("x")).select(F.transform("x", lambda e: e["row"]).alias(name))
    head = pair.risk.select(
        F.struct(F.lit(f["root"]).alias("root"), F.lit(f["git_version"]).alias("gitVersion")).alias("repository"),
        F.struct(*[F.struct(F.lit(f["branches"][s]).alias("name"), F.lit(f["shas"][s]).alias("headCommit")).alias(f"branch{s}") for s in "AB"]).alias("branches"),
        F.lit(f["merge_base"]).alias("mergeBase"),
        F.struct(F.lit(f["ahead_a"]).alias("commitsAheadA"), F.lit(f["ahead_b"]).alias("commitsAheadB"), F.lit(f["diverged"]).alias("diverged")).alias("commits"),
        F.struct("score", "level", "factors").alias("risk"),
    )
    for df, name, key in ((pair.files, "files", "path"), (pair.candidates, "conflicts", "file"), (pair.conflicts, "semanticConflicts", "sites_key")):
        head = head.join(gathered(df, name, key))  # one row each
    return head


def sweep_branches(spark: SparkSession, path: str, main: str = MAIN) -> DataFrame:
    """Predicted conflicts of the current branch with every other branch, with alerts, in one plan."""
    refs = gitrepo.load(spark, path, "refs")
    now = refs.where("is_current").first()
    empty = spark.createDataFrame([], "branch string, file string, risk string, score int, level string, message string")
    if now is None:
        return empty
    current, tip = now["short_name"], commits.resolve_ref(refs, main)[1]
    others = ranges.other_branches(refs.where("not is_remote"), refs.where("is_remote"), current, main).select(F.col("short_name").alias("asked"))
    asked = others.union(spark.createDataFrame([(current,)], "asked string"))
    known = commits.resolve_refs(refs, asked).where("sha is not null").orderBy("asked").collect()  # names and commits of branches
    both = gitrepo.load(spark, path, "branch_diffs", ref=tip, branches="\n".join(f"{r['asked']}\t{r['sha']}" for r in known))
    keys = ["branch", "file"]
    files = diff.name_status(both.select(F.col("branch").alias("diff_id"), F.col("name_status").alias("raw"))).select(F.col("diff_id").alias("branch"), F.col("path").alias("file"))
    found = diff.changed_ranges(both.select(F.col("branch").alias("diff_id"), "raw")).where("start_line is not null").drop("seq").withColumnsRenamed({"diff_id": "branch", "path": "file"})
    own = F.col("branch") == current
    theirs = files.where(~own).distinct()
    beside = lambda mine: mine.where(own).drop("branch").join(theirs, "file")  # noqa: E731  # each file of this branch beside the branches that changed it
    return ranges.alerts(ranges.predict_conflicts(beside(found).select(*keys, *[c for c in found.columns if c not in keys]), found.where(~own), beside(files).select(*keys), theirs, tuple(keys)), current)
