"""All queries of the engine's own operators, with the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.functions import text
from riftscan.functions.levels import health_color, overlap_label
from riftscan.operators import commits, diff, findings, ranges, report, rules, score, secrets, semantic
from riftscan.plans import analysis, callers, enrichment, gitqueries, moves, runs, versions  # noqa: F401  registers their queries
from riftscan.plans.fixtures import view, with_views
from riftscan.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from riftscan.sources import jsparse
from riftscan.streaming import events as ev


def rendered(lines: DataFrame, key: str, order: str, value: str, separator: str = "\n") -> DataFrame:
    """diff_id, raw: the texts of a key joined in order."""
    joined = lines.groupBy(F.col(key).alias("diff_id")).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("all"))
    return joined.select("diff_id", F.array_join(F.transform("all", lambda x: x[value]), separator).alias("raw"))


def diffs(s: SparkSession, d: str) -> DataFrame:
    """One diff for each file of the derived code lines; every 13th file is binary."""
    body = rendered(view(s, d, "hunks"), "file", "line", "hunk")
    path = F.col("diff_id")
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 1..2 100644\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"))
    return body.select("diff_id", F.concat(head, F.when(path.rlike(r"f(0|13|26|39)\."), F.concat(F.lit("Binary files a/"), path, F.lit(" differ\n"))).otherwise(""), "raw").alias("raw"))


DIFFS_SQL = r""", bodies AS (SELECT file AS diff_id, string_agg(hunk, chr(10) ORDER BY line) AS raw FROM hunks GROUP BY file),
diffs AS (SELECT diff_id, concat('diff --git a/', diff_id, ' b/', diff_id, chr(10), 'index 1..2 100644', chr(10), '--- a/', diff_id, chr(10), '+++ b/', diff_id, chr(10),
  CASE WHEN regexp_matches(diff_id, 'f(0|13|26|39)\.') THEN concat('Binary files a/', diff_id, ' differ', chr(10)) ELSE '' END, raw) AS raw FROM bodies),
lines AS (SELECT diff_id, unnest(string_split(raw, chr(10))) AS line, unnest(range(len(string_split(raw, chr(10))))) AS pos FROM diffs)"""


@query(with_views(DIFFS_SQL + r""", kinds AS (SELECT *, CASE
  WHEN regexp_matches(line, '^diff --git a/(.*) b/(.*)$') THEN 'file' WHEN starts_with(line, '+++ b/') THEN 'path' WHEN starts_with(line, '+++ /dev/null') THEN 'none' WHEN starts_with(line, '--- ') THEN 'skip'
  WHEN regexp_matches(line, '^@@\s+-\d+(?:,\d+)?\s+\+(\d+)(?:,\d+)?\s+@@') THEN 'hunk'
  WHEN regexp_matches(line, '^(index |new file mode|deleted file mode|old mode|new mode|similarity index|rename from|rename to|Binary files)') THEN 'skip'
  WHEN starts_with(line, '+++ ') THEN 'skip' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') OR starts_with(line, '\') THEN 'skip' ELSE 'context' END AS kind FROM lines),
pieces AS (SELECT *, CASE WHEN kind IN ('file', 'path') THEN 0 WHEN kind = 'hunk' THEN CAST(regexp_extract(line, '^@@\s+-\d+(?:,\d+)?\s+\+(\d+)', 1) AS BIGINT) END AS base,
  CASE WHEN kind = 'file' THEN regexp_extract(line, '^diff --git a/(.*) b/(.*)$', 2) WHEN kind = 'path' THEN substr(line, 7) END AS named FROM kinds),
numbered AS (SELECT *, count(base) OVER (PARTITION BY diff_id ORDER BY pos) AS piece, last_value(named IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY pos) AS file FROM pieces)
SELECT diff_id, file, CAST(n AS INTEGER) AS line, content, pos AS seq FROM (SELECT diff_id, file, kind, pos, substr(line, 2) AS content,
  first_value(base) OVER w + coalesce(sum(CASE WHEN kind IN ('add', 'context') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id, piece ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
  FROM numbered WINDOW w AS (PARTITION BY diff_id, piece ORDER BY pos)) WHERE kind = 'add'""", "hunks"))
def added_lines_from_diff(s: SparkSession, d: str) -> DataFrame:
    return diff.added_lines(diffs(s, d)).withColumn("seq", F.col("seq").cast("bigint"))


@query(with_views(DIFFS_SQL + r""", marked AS (SELECT *, bool_or(contains(line, 'Binary files') AND NOT starts_with(line, 'diff --git ')) OVER (PARTITION BY diff_id) AS is_binary,
  sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY pos) AS hunk FROM lines),
h AS (SELECT diff_id, hunk, min(pos) AS seq, arg_min(line, pos) AS head, bool_or(starts_with(line, '+') AND NOT starts_with(line, '+++')) AS plus, bool_or(starts_with(line, '-') AND NOT starts_with(line, '---')) AS minus
  FROM marked WHERE NOT is_binary AND hunk > 0 GROUP BY diff_id, hunk),
n AS (SELECT *, CAST(regexp_extract(head, '^@@ -\d+(?:,\d+)? \+(\d+)', 1) AS INTEGER) AS first, coalesce(TRY_CAST(nullif(regexp_extract(head, '^@@ -\d+(?:,\d+)? \+\d+,(\d+) @@', 1), '') AS INTEGER), 1) AS cnt FROM h)
SELECT p.diff_id AS diff_id, p.diff_id AS path, seq, CASE WHEN cnt = 0 THEN greatest(1, first) ELSE first END AS start_line, cnt AS line_count, CASE WHEN cnt = 0 THEN greatest(1, first) ELSE first + cnt - 1 END AS end_line,
  CASE WHEN seq IS NULL THEN NULL WHEN cnt = 0 THEN 'removed' WHEN plus AND minus THEN 'modified' WHEN plus THEN 'added' WHEN minus THEN 'removed' ELSE 'modified' END AS change_type
FROM (SELECT DISTINCT diff_id FROM diffs) p LEFT JOIN n ON n.diff_id = p.diff_id""", "hunks"))
def diff_sections_and_hunks(s: SparkSession, d: str) -> DataFrame:
    return diff.changed_ranges(diffs(s, d)).withColumn("seq", F.col("seq").cast("bigint"))


@query(with_views(r"""SELECT diff_id, CASE WHEN code LIKE 'R%' OR code LIKE 'C%' THEN parts[3] ELSE parts[2] END AS path, CASE WHEN code LIKE 'R%' OR code LIKE 'C%' THEN parts[2] END AS old_path,
  CASE WHEN code LIKE 'R%' THEN 'renamed' WHEN code LIKE 'C%' THEN 'copied' WHEN code = 'A' THEN 'added' WHEN code = 'M' THEN 'modified' WHEN code = 'D' THEN 'deleted' ELSE 'unknown' END AS status, false AS is_binary
FROM (SELECT diff_id, regexp_split_to_array(text, '\t+') AS parts, upper(regexp_split_to_array(text, '\t+')[1]) AS code FROM status_lines)
WHERE len(parts) >= 2 AND (NOT (code LIKE 'R%' OR code LIKE 'C%') OR len(parts) >= 3)""", "status_lines"))
def name_status(s: SparkSession, d: str) -> DataFrame:
    return diff.name_status(rendered(view(s, d, "status_lines"), "diff_id", "pos", "text")).drop("seq")


@query(with_views(r"""SELECT DISTINCT diff_id, trim(text, chr(32) || chr(13)) AS file FROM merge_lines WHERE trim(text, chr(32) || chr(13)) <> '' AND NOT regexp_matches(text, '^[0-9a-f]{40}$') AND NOT starts_with(text, 'fatal:') AND NOT contains(text, 'failed with exit code')""", "merge_lines"))
def merge_tree_paths(s: SparkSession, d: str) -> DataFrame:
    return diff.conflicting_paths(rendered(view(s, d, "merge_lines"), "diff_id", "pos", "text"))


FINDING_COLUMNS = ("file", "line", "category", "snippet", "rule_name", "confidence", "suggested_level")
LOOKAHEAD = ("Unsafe eval()", "Unsafe Function() Constructor", "Unsanitized innerHTML Assignment")


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rule_sql(rule: rules.Rule) -> str:
    flags = "i" if rule.pattern.startswith("(?i)") else ""
    held = f"regexp_matches(content, {sql_text(rule.pattern.removeprefix('(?i)'))}, '{flags or 'c'}')"
    if rule.unless:
        held += f" AND NOT regexp_matches(content, {sql_text(rule.unless.removeprefix('(?i)'))}, '{'i' if rule.unless.startswith('(?i)') else 'c'}')"
    shown = "CASE WHEN length(trim(content)) <= 120 THEN trim(content) ELSE substr(trim(content), 1, 117) || '...' END"
    return f"SELECT file, line, '{rule.category}' AS category, {shown} AS snippet, {sql_text(rule.name)} AS rule_name, '{rule.confidence}' AS confidence, '{rule.level}' AS suggested_level FROM code_lines WHERE NOT starts_with(trim(content), '//') AND NOT starts_with(trim(content), '*') AND NOT starts_with(trim(content), '#') AND trim(content) <> '' AND {held}"


@query(with_views(" UNION ALL ".join(rule_sql(r) for r in rules.INJECTION_RULES if r.name not in LOOKAHEAD), "code_lines"))
def injection_findings(s: SparkSession, d: str) -> DataFrame:
    found = rules.scan_injections(view(s, d, "code_lines"))
    return found.where(~F.col("rule_name").isin(*LOOKAHEAD)).select(*FINDING_COLUMNS)


# On these lines, which hold one call each, the look-ahead rules come to: an argument that starts like a name.
LOOKAHEAD_SQL = " UNION ALL ".join(
    f"SELECT file, line, {sql_text(r.name)} AS rule_name FROM code_lines WHERE NOT starts_with(content, '//') AND regexp_matches(content, {sql_text(p)})"
    for r, p in zip([r for r in rules.INJECTION_RULES if r.name in LOOKAHEAD], (r"\beval\s*\(\s*\w+", r"new\s+Function\s*\(\s*\w+", r"\.innerHTML\s*=\s*\w"))
)


@query(with_views(LOOKAHEAD_SQL, "code_lines"))
def injection_lookahead(s: SparkSession, d: str) -> DataFrame:
    return rules.scan_injections(view(s, d, "code_lines")).where(F.col("rule_name").isin(*LOOKAHEAD)).select("file", "line", "rule_name")


# What each kind of line comes to is written out: no pattern is shared with the rules.
LITERALS_SQL = "SELECT file, line, CASE WHEN kind IN (3, 4) THEN 'Unsafe eval()' WHEN kind IN (8, 9) THEN 'Unsafe Function() Constructor' ELSE 'Unsanitized innerHTML Assignment' END AS rule_name, CASE WHEN kind IN (12, 14) THEN 'medium' ELSE 'high' END AS suggested_level FROM literal_lines WHERE kind IN (3, 4, 8, 9, 12, 14)"


@query(with_views(LITERALS_SQL, "literal_lines"))
def injection_literals(s: SparkSession, d: str) -> DataFrame:
    return rules.scan_injections(view(s, d, "literal_lines")).select("file", "line", "rule_name", "suggested_level")


@query(with_views("""SELECT file, line, array_to_string(list(content) OVER (PARTITION BY file ORDER BY line, content ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), chr(10)) AS surrounding FROM code_lines""", "code_lines"))
def surrounding_lines(s: SparkSession, d: str) -> DataFrame:
    return diff.surrounding(view(s, d, "code_lines")).select("file", "line", F.array_join("surrounding", "\n").alias("surrounding"))


ENTROPY_SQL = "(SELECT -sum(c / n * log2(c / n)) FROM (SELECT CAST(count(*) AS DOUBLE) AS c, CAST(length(v) AS DOUBLE) AS n FROM (SELECT unnest(string_split(v, '')) AS ch) GROUP BY ch))"
SECRETS_SQL = r""", all_lines AS (SELECT row_number() OVER () AS nth, * FROM (SELECT file, line, content FROM code_lines UNION ALL SELECT 'doc.txt', CAST(doc_id AS INTEGER), unnest(string_split(text, chr(10))) FROM documents)),
generic AS (SELECT nth, unnest(regexp_extract_all(content, '((?i:api_?key|apikey|secret|token|passw(?:or)?d|auth|credential)[A-Za-z0-9_]*\s*[:=]\s*["''])([A-Za-z0-9+/=_.-]{16,})["'']', 2)) AS v FROM all_lines),
letters AS (SELECT DISTINCT v, unnest(string_split(v, '')) AS ch FROM generic),
entropy AS (SELECT v, abs(-sum(p * log2(p))) AS bits FROM (SELECT v, CAST(length(v) - length(replace(v, ch, '')) AS DOUBLE) / length(v) AS p FROM letters) GROUP BY v),
real AS (SELECT DISTINCT nth FROM generic JOIN entropy USING (v) WHERE bits >= 3.5 AND NOT regexp_matches(v, 'your[-_]|change[-_ ]?me|example|placeholder|dummy|sample|xxxx|<[^>]+>|todo|replace', 'i')),
found AS (SELECT file, line, content, 'AWS Access Key ID' AS rule_name, 'high' AS confidence FROM all_lines WHERE regexp_matches(content, 'AKIA[0-9A-Z]{16}')
 UNION ALL SELECT file, line, content, 'Generic API Key or Token', 'medium' FROM all_lines JOIN real USING (nth) WHERE NOT regexp_matches(content, 'AKIA[0-9A-Z]{16}'))"""


@query(with_views(SECRETS_SQL + " SELECT file, line, rule_name, confidence FROM found", "code_lines"))
def secret_findings(s: SparkSession, d: str) -> DataFrame:
    documents = s.read.parquet(f"{d}/documents.parquet").select(F.lit("doc.txt").alias("file"), F.col("doc_id").cast("int").alias("line"), F.explode(F.split("text", "\n")).alias("content"))
    lines = view(s, d, "code_lines").select("file", "line", "content").unionByName(documents)
    return secrets.scan_secrets(lines).select("file", "line", "rule_name", "confidence")


BITS_SQL = "list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -((length({v}) - length(replace({v}, c, ''))) / length({v})) * log2((length({v}) - length(replace({v}, c, ''))) / length({v}))))"
# Rule and masked line of each kind, written out; only for generic and loose values does the measure of randomness decide.
MASKED_SQL = f""", kinds AS (SELECT *, CASE WHEN kind IN (0, 17, 22, 26) THEN 'AWS Access Key ID' WHEN kind IN (1, 23) THEN 'AWS Secret Access Key' WHEN kind IN (2, 18) THEN 'Private Key' WHEN kind = 3 THEN 'GitHub Token' WHEN kind IN (4, 19, 25) THEN 'Database Connection String'
  WHEN kind = 5 THEN 'Slack Token' WHEN kind = 6 THEN 'JSON Web Token' WHEN kind IN (7, 20, 21) THEN '.env Secret' WHEN kind IN (8, 24) THEN 'Generic API Key or Token' WHEN kind IN (9, 16) THEN 'High-Entropy String' END AS rule_name,
  CASE kind WHEN 0 THEN 'const id = "#";' WHEN 1 THEN 'aws_secret_access_key = "#"' WHEN 2 THEN '#' WHEN 3 THEN 'token = "#"' WHEN 4 THEN 'url = "postgres://admin:#@db.local:5432/x"' WHEN 5 THEN 'slack("#")' WHEN 6 THEN 'jwt #'
   WHEN 7 THEN 'DB_PASSWORD=#' WHEN 8 THEN 'password: "#"' WHEN 9 THEN 'call("#")' WHEN 16 THEN 'key = "sk-#"' WHEN 17 THEN 'a("#"); token = "#"' WHEN 18 THEN 'k = "#' WHEN 19 THEN 'url = "postgres://admin:#@db.local:5432/x"' WHEN 20 THEN 'DB_PASSWORD="#"'
   WHEN 21 THEN 'export API_TOKEN=#' WHEN 22 THEN 'a("#"); token = "#";' WHEN 23 THEN 'aws_secret_access_key = #' WHEN 24 THEN 'const apiKey = `#`;' WHEN 25 THEN 'url = "mysql://root:#@db.local/x"' WHEN 26 THEN 'a("#", {{ "password": ''#' END AS shown,
  CASE WHEN kind IN (8, 24) THEN {BITS_SQL.format(v="h")} WHEN kind = 9 THEN {BITS_SQL.format(v="substr(content, 7, 64)")} WHEN kind = 16 THEN {BITS_SQL.format(v="substr(content, 8, 67)")} END AS bits FROM secret_lines)
SELECT file, line, rule_name, CASE WHEN kind IN (8, 24) THEN 'medium' WHEN kind IN (9, 16) THEN 'low' ELSE 'high' END AS confidence, CASE WHEN kind IN (8, 24) THEN 'high' WHEN kind IN (9, 16) THEN 'medium' ELSE 'critical' END AS suggested_level,
  replace(shown, '#', '***REDACTED***') AS redacted_preview, false AS leaks FROM kinds WHERE rule_name IS NOT NULL AND CASE WHEN kind IN (8, 24) THEN bits >= 3.5 WHEN kind IN (9, 16) THEN bits > 4 ELSE true END"""


@query(with_views(MASKED_SQL, "secret_lines"))
def secret_masking(s: SparkSession, d: str) -> DataFrame:
    """Findings with what they show; ``leaks`` tells whether any of their fields holds a piece of the line's values."""
    found = secrets.scan_secrets(view(s, d, "secret_lines"))
    values = [F.md5(F.concat(F.lit(p), F.col("line").cast("string"))) for p in ("", "g")]
    everything = F.lower(F.concat_ws(" ", *[c for c, t in found.dtypes if t == "string"]))
    leaks = [F.contains(everything, F.substring(v, k, 6)) for v in values for k in (1, 3, 11, 27)]
    return found.select("file", "line", "rule_name", "confidence", "suggested_level", "redacted_preview", F.greatest(*leaks).alias("leaks"))


@query(r"""WITH words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE length(w) >= 12), letters AS (SELECT w, unnest(string_split(w, '')) AS ch FROM words),
p AS (SELECT w, ch, CAST(count(*) AS DOUBLE) / any_value(length(w)) AS p FROM letters GROUP BY w, ch) SELECT w AS word, round(abs(-sum(p * log2(p))), 6) AS bits FROM p GROUP BY w""")
def entropy(s: SparkSession, d: str) -> DataFrame:
    words = s.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", r"\s+")).alias("word")).where("length(word) >= 12").distinct()
    return words.select("word", F.round(text.shannon_entropy(F.col("word")), 6).alias("bits"))


def risks_of(s: SparkSession, d: str) -> DataFrame:
    return analysis.security_risks(view(s, d, "code_lines"))


LEVELS_SQL = "CASE WHEN category = 'hardcoded_secret' THEN CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END WHEN category IN ('sql_injection', 'command_injection', 'unsafe_eval') THEN CASE WHEN confidence IN ('high', 'medium') THEN 2 ELSE 1 END ELSE CASE WHEN confidence = 'high' THEN 2 ELSE 1 END END"
RISKS_SQL = (
    r""", secret AS (SELECT file, line, 'hardcoded_secret' AS category, rule_name, confidence, 0 AS scanner, 0 AS pos FROM (SELECT file, line, 'AWS Access Key ID' AS rule_name, 'high' AS confidence FROM code_lines WHERE regexp_matches(content, 'AKIA[0-9A-Z]{16}')
 UNION ALL SELECT file, line, 'Generic API Key or Token', 'medium' FROM code_lines WHERE starts_with(content, 'const apiKey = "') AND (SELECT abs(-sum(p * log2(p))) FROM (SELECT CAST(count(*) AS DOUBLE) / 32 AS p FROM (SELECT unnest(string_split(substr(content, 17, 32), '')) AS ch) GROUP BY ch)) >= 3.5)),
injected AS ("""
    + " UNION ALL ".join(f"SELECT file, line, category, rule_name, confidence, 1 AS scanner, {k} AS pos FROM ({rule_sql(r)})" for k, r in enumerate(rules.INJECTION_RULES) if r.name not in LOOKAHEAD)
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT file, line, '{r.category}' AS category, {sql_text(r.name)} AS rule_name, '{r.confidence}' AS confidence, 1 AS scanner, {k} AS pos FROM code_lines WHERE NOT starts_with(content, '//') AND regexp_matches(content, {sql_text(p)})"
        for (k, r), p in zip([(k, r) for k, r in enumerate(rules.INJECTION_RULES) if r.name in LOOKAHEAD], (r"\beval\s*\(\s*\w+", r"new\s+Function\s*\(\s*\w+", r"\.innerHTML\s*=\s*\w"))
    )
    + f"""), findings AS (SELECT *, {LEVELS_SQL} AS lvl, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS sure FROM (SELECT * FROM secret UNION ALL SELECT * FROM injected)),
risks AS (SELECT file, line, arg_min(category, scanner * 100 + pos) AS category, CASE max(lvl) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level,
 string_agg(rule_name, '; ' ORDER BY scanner, pos) AS rule_matched, CASE max(sure) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM findings GROUP BY file, line)"""
)


@query(with_views(RISKS_SQL + " SELECT 'security_risk' AS type, category, file, line, risk_level, rule_matched, confidence FROM risks", "code_lines"))
def security_risks(s: SparkSession, d: str) -> DataFrame:
    return risks_of(s, d).select("type", "category", "file", "line", "risk_level", "rule_matched", "confidence")


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = view(s, d, "branch_ranges")
    return r.where("branch = 'A'").drop("branch"), r.where("branch = 'B'").drop("branch")


def merged_files(s: SparkSession, d: str) -> DataFrame:
    a, b = sides(s, d)
    a, b = a.withColumnRenamed("file", "path"), b.withColumnRenamed("file", "path")
    files = view(s, d, "branch_files")
    side = lambda name, rs: ranges.branch_files(files.where(F.col("side") == name).drop("side"), rs)
    return ranges.merge_branch_files(side("A", a), side("B", b), a, b)


FILES_SQL = """, sums AS (SELECT branch AS side, file AS path, count(*) AS n, sum(CASE WHEN change_type = 'added' THEN line_count ELSE 0 END) AS additions, sum(CASE WHEN change_type = 'removed' THEN line_count ELSE 0 END) AS deletions FROM branch_ranges GROUP BY branch, file),
f AS (SELECT branch_files.*, coalesce(n, 0) AS n, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions FROM branch_files LEFT JOIN sums USING (side, path)),
files AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.old_path, b.old_path) AS old_path, coalesce(a.status, b.status) AS status, CAST(coalesce(a.additions, b.additions) AS BIGINT) AS additions, CAST(coalesce(a.deletions, b.deletions) AS BIGINT) AS deletions, coalesce(a.is_binary, b.is_binary) AS is_binary,
 CAST(coalesce(a.n, 0) AS BIGINT) AS n_changes_a, CAST(coalesce(b.n, 0) AS BIGINT) AS n_changes_b FROM (SELECT * FROM f WHERE side = 'A') a FULL JOIN (SELECT * FROM f WHERE side = 'B') b ON a.path = b.path)"""


@query(with_views(FILES_SQL + " SELECT * FROM files", "branch_ranges", "branch_files"))
def merge_branch_files(s: SparkSession, d: str) -> DataFrame:
    return merged_files(s, d)


PAIRS_SQL = """, r AS MATERIALIZED (SELECT *, CASE WHEN line_count = 0 THEN start_line ELSE end_line END AS last FROM branch_ranges),
pairs AS (SELECT * FROM (SELECT a.file AS file, a.start_line AS a_start_line, a.line_count AS a_line_count, a.end_line AS a_end_line, a.change_type AS a_change_type, b.start_line AS b_start_line, b.line_count AS b_line_count, b.end_line AS b_end_line, b.change_type AS b_change_type,
 CASE WHEN greatest(a.start_line, b.start_line) <= least(a.last, b.last) THEN 'HIGH' WHEN least(abs(a.last - b.start_line), abs(b.last - a.start_line)) = 0 THEN 'MEDIUM' WHEN least(abs(a.last - b.start_line), abs(b.last - a.start_line)) <= 5 THEN 'LOW' ELSE 'SAFE' END AS level,
 CASE WHEN greatest(a.start_line, b.start_line) <= least(a.last, b.last) THEN least(a.last, b.last) - greatest(a.start_line, b.start_line) + 1 ELSE 0 END AS shared_lines
 FROM (SELECT * FROM r WHERE branch = 'A') a JOIN (SELECT * FROM r WHERE branch = 'B') b ON a.file = b.file) WHERE level <> 'SAFE'),
worst AS (SELECT file, CASE max(CASE level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS n_pairs,
 (array_agg(b_start_line ORDER BY a_start_line, a_end_line, b_start_line, b_end_line))[1] AS first_b_line FROM pairs GROUP BY file)"""


@query(with_views(PAIRS_SQL + " SELECT * FROM pairs", "branch_ranges"))
def range_overlap(s: SparkSession, d: str) -> DataFrame:
    return ranges.overlaps(*sides(s, d))


@query(with_views(PAIRS_SQL + " SELECT file, level, n_pairs, first_b_line, CASE level WHEN 'HIGH' THEN 'Direct line overlap — likely textual conflict' WHEN 'MEDIUM' THEN 'Adjacent changes — potential interaction' ELSE 'Nearby changes — low interaction risk' END AS label FROM worst", "branch_ranges"))
def worst_overlap(s: SparkSession, d: str) -> DataFrame:
    return ranges.worst_levels(ranges.overlaps(*sides(s, d))).withColumn("label", overlap_label(F.col("level")))


def candidates_of(s: SparkSession, d: str) -> DataFrame:
    a, b = sides(s, d)
    files = view(s, d, "branch_files")
    side = lambda name: files.where(F.col("side") == name).drop("side")
    # candidates read no additions and deletions, so these are not summed here, and of the numbers of changes only whether there are any
    changed = lambda rs: rs.select(F.col("file").alias("path")).distinct()
    merged = ranges.merge_branch_files(side("A"), side("B"), changed(a), changed(b))
    return ranges.conflict_candidates(merged, a, b, view(s, d, "conflicts"))


CANDIDATES_SQL = (
    FILES_SQL
    + PAIRS_SQL
    + """, c AS (SELECT files.*, conflicts.file IS NOT NULL AS hit, coalesce(worst.level, 'SAFE') AS lvl, coalesce(worst.n_pairs, 0) AS n_pairs, first_b_line, n_changes_a > 0 AND n_changes_b > 0 AS two FROM files LEFT JOIN conflicts ON conflicts.file = path LEFT JOIN worst ON worst.file = path),
candidates AS (SELECT path AS file, CASE WHEN two THEN lvl ELSE 'HIGH' END AS overlap_level, hit AS has_conflict, NOT two OR hit OR lvl = 'HIGH' AS predicted,
 CAST(CASE WHEN NOT two THEN CASE WHEN hit THEN 0.95 ELSE 0.7 END WHEN hit AND lvl = 'HIGH' THEN 0.95 WHEN hit OR lvl = 'HIGH' THEN 0.8 WHEN lvl = 'MEDIUM' THEN 0.55 ELSE 0.3 END AS DOUBLE) AS confidence,
 CAST(CASE WHEN two THEN n_pairs ELSE 0 END AS BIGINT) AS n_pairs, CASE WHEN two THEN first_b_line END AS first_b_line FROM c WHERE n_changes_a + n_changes_b > 0 AND CASE WHEN two THEN lvl <> 'SAFE' OR hit ELSE status = 'deleted' OR hit END)"""
)
CANDIDATE_VIEWS = ("branch_ranges", "branch_files", "conflicts")


@query(with_views(CANDIDATES_SQL + " SELECT * FROM candidates", *CANDIDATE_VIEWS))
def conflict_candidates(s: SparkSession, d: str) -> DataFrame:
    return candidates_of(s, d)


@query(with_views(PAIRS_SQL + " SELECT s.file, CASE WHEN level = 'HIGH' THEN 'HIGH_RISK' ELSE 'LOW_RISK' END AS risk, CASE WHEN level = 'HIGH' THEN 60 ELSE 10 END AS score, CASE WHEN level = 'HIGH' THEN 'HIGH' ELSE 'LOW' END AS level FROM (SELECT file FROM r WHERE branch = 'A' INTERSECT SELECT file FROM r WHERE branch = 'B') s LEFT JOIN worst USING (file)", "branch_ranges"))
def predict_conflicts(s: SparkSession, d: str) -> DataFrame:
    a, b = sides(s, d)
    return ranges.predict_conflicts(a, b, a.select("file"), b.select("file"))


@query(with_views(""", r AS (SELECT *, CASE WHEN line_count = 0 THEN start_line ELSE end_line END AS last, concat('b', CAST(start_line % 3 AS STRING)) AS other FROM branch_ranges),
pairs AS (SELECT b.other AS branch, b.file AS file, max(CASE WHEN greatest(a.start_line, b.start_line) <= least(a.last, b.last) THEN 1 ELSE 0 END) AS high FROM r a JOIN r b ON a.file = b.file AND a.branch = 'A' AND b.branch = 'B' GROUP BY b.other, b.file)
SELECT branch, file, CASE WHEN high = 1 THEN 'HIGH_RISK' ELSE 'LOW_RISK' END AS risk, CASE WHEN high = 1 THEN 60 ELSE 10 END AS score,
 concat('Proactive Alert: ''', file, ''' on your branch ''work'' will conflict with already-pushed branch ''', branch, ''' (', CASE WHEN high = 1 THEN 'HIGH_RISK' ELSE 'LOW_RISK' END, ')') AS message FROM pairs""", "branch_ranges"))
def cross_branch_sweep(s: SparkSession, d: str) -> DataFrame:
    a, b = sides(s, d)
    b = b.withColumn("branch", F.concat(F.lit("b"), (F.col("start_line") % 3).cast("string")))
    local = s.createDataFrame([("work",), ("main",), ("b0",)], "short_name string")
    remote = s.createDataFrame([("b1",), ("b2",), ("origin/HEAD",), ("origin/work",), ("origin/main",)], "short_name string")
    others = ranges.other_branches(local, remote, "work").withColumnRenamed("short_name", "branch")
    b = b.join(F.broadcast(others), "branch", "left_semi")  # a handful of branch names
    keys = ("branch", "file")
    a = a.join(b.select(*keys).distinct(), "file")  # each file beside the branches that changed it
    found = ranges.predict_conflicts(a, b, a.select(*keys), b.select(*keys), keys)
    return ranges.alerts(found, "work").select("branch", "file", "risk", "score", "message")


@query(with_views(CANDIDATES_SQL + """ SELECT file, CAST(least(100, CASE overlap_level WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 5 ELSE 0 END + CASE WHEN has_conflict THEN 30 ELSE 0 END + CASE WHEN n_pairs > 2 THEN 15 WHEN n_pairs > 1 THEN 8 ELSE 0 END) AS INTEGER) AS score,
 concat_ws('; ', CASE overlap_level WHEN 'HIGH' THEN 'Direct modification overlap on same lines' WHEN 'MEDIUM' THEN 'Adjacent modifications — may interact during merge' WHEN 'LOW' THEN 'Nearby modifications within 5 lines' END, CASE WHEN has_conflict THEN 'Git merge-tree predicts an actual merge conflict' END,
 CASE WHEN n_pairs > 2 THEN concat('Multiple overlapping hunks (', CAST(n_pairs AS STRING), ')') WHEN n_pairs > 1 THEN 'Two overlapping hunks' END) AS factors FROM candidates""", *CANDIDATE_VIEWS))
def file_scores(s: SparkSession, d: str) -> DataFrame:
    return ranges.file_scores(candidates_of(s, d))


@query(with_views(CANDIDATES_SQL + """, x AS (SELECT bool_or(overlap_level = 'HIGH') AS high, bool_or(overlap_level = 'MEDIUM') AS med, bool_or(has_conflict) AS conf, count(*) FILTER (WHERE overlap_level IN ('HIGH', 'MEDIUM')) AS touching, sum(n_pairs) AS pairs, bool_or(file IN (SELECT path FROM files WHERE is_binary)) AS bin FROM candidates),
y AS (SELECT bool_or(status = 'deleted' AND n_changes_a + n_changes_b > 0) AS del FROM files),
z AS (SELECT *, CASE WHEN high THEN 35 ELSE 0 END + CASE WHEN conf THEN 25 ELSE 0 END + CASE WHEN touching > 1 THEN 15 ELSE 0 END + CASE WHEN med AND NOT high THEN 10 ELSE 0 END + CASE WHEN del THEN 10 ELSE 0 END + CASE WHEN bin THEN 5 ELSE 0 END + 5 + CASE WHEN pairs > 5 THEN 15 WHEN pairs > 2 THEN 8 ELSE 0 END AS total FROM x, y)
SELECT CAST(least(total, 100) AS INTEGER) AS score, CASE WHEN least(total, 100) >= 80 THEN 'CRITICAL' WHEN total >= 50 THEN 'HIGH' WHEN total >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level,
 concat_ws('; ', CASE WHEN high THEN 'Direct modification overlap on same lines' END, CASE WHEN conf THEN 'Git merge-tree predicts an actual merge conflict' END, CASE WHEN touching > 1 THEN 'Multiple files with overlapping changes' END, CASE WHEN med AND NOT high THEN 'Adjacent modifications — potential merge interaction' END,
 CASE WHEN del THEN 'File deleted on one branch while modified on another' END, CASE WHEN bin THEN 'Binary file involved in conflicting change' END, 'Moderately diverged branches', CASE WHEN pairs > 5 THEN concat('High number of overlapping hunk pairs (', CAST(pairs AS BIGINT), ')') WHEN pairs > 2 THEN concat('Multiple overlapping hunk pairs (', CAST(pairs AS BIGINT), ')') END) AS factors FROM z""", *CANDIDATE_VIEWS))
def repo_risk_score(s: SparkSession, d: str) -> DataFrame:
    return score.repo_risk(candidates_of(s, d), merged_files(s, d), 3, 1)


def signature_rows(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "signatures").withColumn("params", F.split("params", ",")).withColumn("seq", F.lit(0))


CHANGES_SQL = """, known AS (SELECT DISTINCT file FROM signatures WHERE ref = 'base'), br AS (SELECT 'A' AS branch UNION ALL SELECT 'B'),
o AS (SELECT branch, file, name, params FROM signatures, br WHERE ref = 'base'), n AS (SELECT ref AS branch, file, name, params FROM signatures WHERE ref <> 'base'),
changes AS (SELECT branch, file, name, coalesce(o.params, '') AS old_params, coalesce(n.params, '') AS new_params, CASE WHEN n.params IS NULL THEN 'function_removed' WHEN o.params IS NULL THEN 'function_added' ELSE 'signature_change' END AS change_type
 FROM o FULL JOIN n USING (branch, file, name) WHERE file IN (SELECT file FROM known) AND (o.params IS NULL OR n.params IS NULL OR o.params <> n.params))"""


def changes_of(s: SparkSession, d: str) -> DataFrame:
    return semantic.signature_changes(signature_rows(s, d))


@query(with_views(CHANGES_SQL + " SELECT * FROM changes", "signatures"))
def signature_diff(s: SparkSession, d: str) -> DataFrame:
    return changes_of(s, d).withColumns({c: F.array_join(c, ",") for c in ("old_params", "new_params")})


CONFLICTS_SQL = (
    CHANGES_SQL
    + """, found AS (SELECT CASE WHEN branch <> ref THEN 'cross-branch' ELSE 'intra-branch' END AS scope, branch, name, file, old_params, new_params, count(*) AS n_sites, string_agg(concat(caller_file, ':', CAST(line AS STRING)), '|' ORDER BY concat(caller_file, ':', CAST(line AS STRING))) AS sites,
 string_agg(caller_file, ',' ORDER BY caller_file, line) AS callers, list(DISTINCT caller_file) AS files FROM changes JOIN call_sites ON called_function = name WHERE change_type = 'signature_change' AND (branch <> ref OR caller_file <> file) GROUP BY ALL),
conflicts2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, name, file, sites ORDER BY branch) AS nth FROM found) WHERE nth = 1)"""
)


@query(with_views(CONFLICTS_SQL + " SELECT scope, branch, name, file, old_params, new_params, n_sites, sites FROM conflicts2", "signatures", "call_sites"))
def semantic_conflicts(s: SparkSession, d: str) -> DataFrame:
    found = semantic.semantic_conflicts(changes_of(s, d), view(s, d, "call_sites"))
    return found.select("scope", "branch", "name", "file", F.array_join("old_params", ",").alias("old_params"), F.array_join("new_params", ",").alias("new_params"), F.size("sites").cast("bigint").alias("n_sites"), F.col("sites_key").alias("sites"))


@query(with_views(CHANGES_SQL + """, k AS (SELECT *, CASE WHEN new_params = '' THEN 0 ELSE len(string_split(new_params, ',')) END AS nn, CASE WHEN old_params = '' THEN 0 ELSE len(string_split(old_params, ',')) END AS no FROM changes), sites AS (SELECT called_function AS name, count(*) AS n FROM call_sites GROUP BY 1)
SELECT branch, file, name, true AS is_break, CASE WHEN nn > no THEN concat('Function ''', name, ''' requires at least ', CAST(nn AS STRING), ' argument(s) (new signature: ', replace(new_params, ',', ', '), '), but old callers provide fewer arguments.')
 WHEN change_type = 'function_removed' THEN concat('Function ''', name, ''' was removed from ', file, ', but call sites still reference it.') ELSE concat('Function ''', name, ''' signature changed from (', replace(old_params, ',', ', '), ') to (', replace(new_params, ',', ', '), ').') END AS reason,
 CAST(nn AS INTEGER) AS min_args, CAST(nn AS INTEGER) AS max_args, CAST(coalesce(n, 0) AS BIGINT) AS n_sites FROM k LEFT JOIN sites USING (name)""", "signatures", "call_sites"))
def signature_break(s: SparkSession, d: str) -> DataFrame:
    return semantic.signature_breaks(changes_of(s, d), view(s, d, "call_sites"))


@query(with_views("SELECT called_function, count(*) AS n_sites, string_agg(concat(caller_file, ':', CAST(line AS STRING)), '|' ORDER BY caller_file, line) AS sites FROM call_sites GROUP BY called_function", "call_sites"))
def call_graph(s: SparkSession, d: str) -> DataFrame:
    graph = semantic.call_graph(view(s, d, "call_sites"))
    return graph.select("called_function", F.size("sites").cast("bigint").alias("n_sites"), F.array_join(F.transform("sites", lambda x: F.concat(x["caller_file"], F.lit(":"), x["line"].cast("string"))), "|").alias("sites"))


def js_sources(s: SparkSession, d: str) -> DataFrame:
    """Sources of every ref, rendered from the derived signatures and call sites."""
    functions = view(s, d, "signatures").select("ref", "file", F.lit(0).alias("part"), F.col("name").alias("key"), F.format_string("function %s(%s) { return 1; }", F.col("name"), F.col("params")).alias("text"))
    calls = view(s, d, "call_sites").select("ref", F.col("caller_file").alias("file"), F.lit(1).alias("part"), F.concat("called_function", F.col("line").cast("string")).alias("key"), F.format_string("obj.%s(1, 2); // %d", F.col("called_function"), F.col("line")).alias("text"))
    rows = functions.unionByName(calls).groupBy("ref", "file").agg(F.sort_array(F.collect_list(F.struct("part", "key", "text"))).alias("all"))
    return rows.select("ref", "file", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("source")).where(text.is_js_path(F.col("file")) & text.has_js_suffix(F.col("file")))


@query(with_views("SELECT ref, file, name, params FROM signatures", "signatures"))
def js_signatures(s: SparkSession, d: str) -> DataFrame:
    jsparse.register(s)
    found = s.sql("SELECT s.ref, s.file, f.* FROM {src} s, LATERAL js_signatures(s.source) f", src=js_sources(s, d))
    return found.select("ref", "file", "name", F.array_join("params", ",").alias("params"))


CALL_LINES_SQL = """, functions AS (SELECT ref, file, count(*) AS n FROM signatures GROUP BY ref, file)
SELECT c.ref, caller_file AS file, called_function, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY c.ref, caller_file ORDER BY concat(called_function, CAST(line AS STRING))) AS INTEGER) AS line FROM call_sites c LEFT JOIN functions f ON f.file = caller_file AND f.ref = c.ref"""


@query(with_views(CALL_LINES_SQL, "call_sites", "signatures"))
def js_call_sites(s: SparkSession, d: str) -> DataFrame:
    """Call sites with their lines in the rendered sources, where calls follow the functions."""
    jsparse.register(s)
    return s.sql("SELECT s.ref, s.file, f.* FROM {src} s, LATERAL js_call_sites(s.source) f", src=js_sources(s, d))


def all_risks(s: SparkSession, d: str) -> DataFrame:
    security = analysis.merged_risks(view(s, d, "code_lines")).withColumn("id", F.concat(F.lit("security_"), "file", F.lit("_"), F.col("line").cast("string")))
    found = semantic.semantic_conflicts(changes_of(s, d), view(s, d, "call_sites"))
    return report.all_risks(report.conflict_risks(candidates_of(s, d)), report.semantic_risks(found), findings.adapt_security(security))


REPORT_SQL = (
    CANDIDATES_SQL
    + CONFLICTS_SQL
    + RISKS_SQL
    + """, report AS (SELECT 0 AS part, concat('git_', file, '_', overlap_level) AS id, 'semantic_conflict' AS type, CASE overlap_level WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' ELSE 'low' END AS risk_level, file, coalesce(first_b_line, 1) AS line, 'N/A (Line Overlap)' AS function_name, CAST(NULL AS STRING) AS category, CASE WHEN has_conflict THEN 'git_merge_conflict' ELSE 'line_overlap' END AS change_type, file AS affected_files, 'Pending AI response...' AS explanation, 'Pending AI response...' AS recommendation FROM candidates
 UNION ALL SELECT 1, concat_ws('_', 'semantic', scope, name, file), 'semantic_conflict', 'high', file, 1, name, NULL, CASE WHEN scope = 'intra-branch' THEN 'intra_branch_signature_change' ELSE 'signature_change' END, callers,
 concat('Function "', name, '" signature changed from (', replace(old_params, ',', ', '), ') to (', replace(new_params, ',', ', '), CASE WHEN scope = 'intra-branch' THEN ') on this branch, but ' ELSE ') on one branch, but ' END, CAST(n_sites AS STRING), ' call site(s) ', CASE WHEN scope = 'intra-branch' THEN 'IN THE SAME BRANCH still use the old signature. This will cause a runtime error.' ELSE 'on the other branch still use the old signature. This will cause a runtime error after merge.' END),
 concat('Update all call sites in ', array_to_string(list_sort(files), ', '), ' to use the new signature.') FROM conflicts2
 UNION ALL SELECT 2, concat('security_', file, '_', CAST(line AS STRING)), 'security_risk', risk_level, file, line, NULL, category, NULL, NULL, 'Pending AI response...', 'Pending AI response...' FROM risks)"""
)
REPORT_VIEWS = (*CANDIDATE_VIEWS, "signatures", "call_sites", "code_lines")


@query(with_views(REPORT_SQL + " SELECT * FROM report", *REPORT_VIEWS))
def risk_report(s: SparkSession, d: str) -> DataFrame:
    return all_risks(s, d).drop("redacted_preview").withColumn("affected_files", F.array_join("affected_files", ","))


@query(with_views(REPORT_SQL + """, h AS (SELECT file, greatest(0, 100 - sum(CASE risk_level WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 5 ELSE 1 END)) AS score FROM report GROUP BY file)
SELECT file, CAST(score AS BIGINT) AS score, CASE WHEN score >= 75 THEN '#2ed573' WHEN score >= 50 THEN '#ffa502' WHEN score >= 25 THEN '#ff6348' ELSE '#ff4757' END AS color FROM h""", *REPORT_VIEWS))
def health_score(s: SparkSession, d: str) -> DataFrame:
    """The health of each file, by all its risks."""
    return score.health(all_risks(s, d), ("file",))


@query(with_views(REPORT_SQL + """ SELECT l.risk_level AS risk_level, count(report.id) AS n, 100.0 * count(report.id) / (SELECT count(*) FROM report) AS pct FROM (SELECT 'critical' AS risk_level UNION ALL SELECT 'high' UNION ALL SELECT 'medium' UNION ALL SELECT 'low') l LEFT JOIN report ON report.risk_level = l.risk_level GROUP BY 1""", *REPORT_VIEWS))
def severity_breakdown(s: SparkSession, d: str) -> DataFrame:
    return score.severity_breakdown(all_risks(s, d))


@query(with_views(REPORT_SQL + " SELECT risk_level, count(*) AS n FROM report GROUP BY 1", *REPORT_VIEWS))
def severity_summary(s: SparkSession, d: str) -> DataFrame:
    return score.severity_summary(all_risks(s, d))


@query(with_views(REPORT_SQL + """ SELECT row_number() OVER (ORDER BY w DESC, n DESC, part, id) AS rank, id, file, risk_level FROM (SELECT *, CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS w, coalesce(len(string_split(affected_files, ',')), 1) AS n FROM report) ORDER BY w DESC, n DESC, part, id LIMIT 3""", *REPORT_VIEWS))
def best_fix_top3(s: SparkSession, d: str) -> DataFrame:
    rows = all_risks(s, d).select("id", "file", "risk_level", F.when(F.col("affected_files").isNotNull(), F.size("affected_files")).alias("n_files"), F.struct("part", "id").alias("seq"))
    return score.best_fixes(rows).select(F.col("rank").cast("bigint").alias("rank"), "id", "file", "risk_level")


@query(with_views(RISKS_SQL + """, ids AS (SELECT concat('security_', file, '_', CAST(line AS STRING)) AS id, line FROM risks)
SELECT id, CASE WHEN line % 3 = 0 THEN concat('new ', id) ELSE 'Pending AI response...' END AS explanation, CASE WHEN line % 3 = 0 THEN 'fix' ELSE 'Pending AI response...' END AS recommendation, line % 3 <> 0 AS pending FROM ids""", "code_lines"))
def enriched_risks(s: SparkSession, d: str) -> DataFrame:
    security = risks_of(s, d).withColumn("id", F.concat(F.lit("security_"), "file", F.lit("_"), F.col("line").cast("string")))
    risks = findings.adapt_security(security)
    item = lambda text_, fix: F.concat(F.lit('{"id":"'), "id", F.lit('","explanation":"'), text_, F.lit(f'","recommendation":"{fix}"}}'))
    answer = F.concat(F.lit("```json\n["), item(F.lit("old"), "fix"), F.lit(","), item(F.when(F.col("line") % 3 == 0, F.concat(F.lit("new "), "id")).otherwise(""), "fix"), F.lit("]\n```"))
    answers = security.where("line % 3 = 0").select(answer.alias("raw"))
    found = report.enrich(risks, report.parse_enrichments(answers))
    return found.select("id", "explanation", "recommendation", report.is_pending(F.col("explanation")).alias("pending"))


@query(with_views(REPORT_SQL + """ SELECT file, id AS code, CASE WHEN risk_level IN ('critical', 'high') THEN 'Error' WHEN risk_level = 'medium' THEN 'Warning' ELSE 'Information' END AS severity, CAST(greatest(0, line - 1) AS INTEGER) AS line0,
 concat('[riftscan] ', CASE WHEN type = 'semantic_conflict' THEN coalesce(function_name, type) ELSE coalesce(category, type) END, ' — ', explanation) AS message FROM report WHERE file IN (SELECT file FROM call_sites_files)""".replace("call_sites_files", "(SELECT caller_file AS file FROM call_sites UNION SELECT file FROM code_lines WHERE line % 2 = 0)"), *REPORT_VIEWS))
def diagnostics(s: SparkSession, d: str) -> DataFrame:
    files = view(s, d, "call_sites").select(F.col("caller_file").alias("file")).union(view(s, d, "code_lines").where("line % 2 = 0").select("file"))
    return report.diagnostics(all_risks(s, d), files)


@query(with_views(REPORT_SQL + " SELECT id, risk_level, file, line, category FROM report WHERE type = 'security_risk'", *REPORT_VIEWS))
def security_posture(s: SparkSession, d: str) -> DataFrame:
    return report.security_posture(all_risks(s, d)).select("id", "risk_level", "file", "line", "category")


@query(with_views(PAIRS_SQL + """, o AS (SELECT file, row_number() OVER w AS nth, concat('A ', CAST(a_start_line AS STRING), '-', CAST(a_end_line AS STRING), ' / B ', CAST(b_start_line AS STRING), '-', CAST(b_end_line AS STRING)) AS t FROM pairs WINDOW w AS (PARTITION BY file ORDER BY a_start_line, a_end_line, b_start_line, b_end_line))
SELECT file, string_agg(t, '; ' ORDER BY nth) FILTER (WHERE nth <= 3) AS shown, CAST(greatest(0, count(*) - 3) AS INTEGER) AS more FROM o GROUP BY file""", "branch_ranges"))
def first_overlaps(s: SparkSession, d: str) -> DataFrame:
    return report.first_pairs(ranges.overlaps(*sides(s, d)))


@query(with_views("SELECT device_id, event_id, prior < 20 AS admitted, CAST(greatest(0, 20 - least(20, prior + success)) AS BIGINT) AS remaining FROM (SELECT *, coalesce(sum(success) OVER (PARTITION BY device_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM device_events)", "device_events"))
def device_quota(s: SparkSession, d: str) -> DataFrame:
    return ev.quota(view(s, d, "device_events")).select("device_id", "event_id", "admitted", "remaining")


@query(with_views("SELECT device_id, CAST(least(20, sum(success)) AS BIGINT) AS used FROM device_events GROUP BY device_id", "device_events"))
def device_usage(s: SparkSession, d: str) -> DataFrame:
    return ev.usage(view(s, d, "device_events"))


@query(with_views(", g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY device_id ORDER BY ts) + INTERVAL 2 SECOND THEN 1 WHEN lag(ts) OVER (PARTITION BY device_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS opens FROM device_events), n AS (SELECT *, sum(opens) OVER (PARTITION BY device_id ORDER BY ts) AS burst FROM g) SELECT device_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started_us, CAST(epoch_us(max(ts) + INTERVAL 2 SECOND) AS BIGINT) AS fires_us, count(*) AS n_events FROM n GROUP BY device_id, burst", "device_events"))
def debounced_scans(s: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return ev.debounced(view(s, d, "device_events")).select("device_id", us("started").alias("started_us"), us("fires").alias("fires_us"), "n_events")


@query(with_views("SELECT device_id AS key, arg_max(event_id, event_id) AS value, max(event_id) AS seq FROM device_events WHERE event_id <= device_id * 40 GROUP BY device_id", "device_events"))
def latest_before_ready(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "device_events")
    updates = rows.select(F.col("device_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    ready = rows.select(F.col("device_id").alias("key"), (F.col("device_id") * 40).alias("ready_seq")).distinct()
    return ev.latest(updates, ready)


def commit_edges(s: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """child, parent over all of part, and two tips: the last key and the one 25 before it."""
    last = s.read.parquet(f"{d}/part.parquet").agg(F.max("p_partkey")).first()[0]
    return view(s, d, "commit_edges"), int(last), int(last) - 25


REACH_SQL = ", tips AS (SELECT CAST(max(p_partkey) AS INT) AS a, CAST(max(p_partkey) - 25 AS INT) AS b FROM part), reach AS (SELECT a AS tip, a AS node FROM tips UNION SELECT b, b FROM tips UNION SELECT reach.tip, e.parent FROM reach JOIN commit_edges e ON e.child = reach.node), a AS (SELECT node FROM reach WHERE tip = (SELECT a FROM tips)), b AS (SELECT node FROM reach WHERE tip = (SELECT b FROM tips))"


@query(with_views(REACH_SQL + " SELECT (SELECT count(*) FROM (SELECT node FROM a EXCEPT SELECT node FROM b)) AS ahead_a, (SELECT count(*) FROM (SELECT node FROM b EXCEPT SELECT node FROM a)) AS ahead_b, (SELECT count(*) FROM (SELECT node FROM a EXCEPT SELECT node FROM b)) > 0 AND (SELECT count(*) FROM (SELECT node FROM b EXCEPT SELECT node FROM a)) > 0 AS diverged", "commit_edges", recursive=True))
def commits_ahead(s: SparkSession, d: str) -> DataFrame:
    return commits.commits_ahead(*commit_edges(s, d))


@query(with_views(REACH_SQL + " SELECT node FROM a WHERE node NOT IN (SELECT node FROM b) AND node NOT IN (SELECT child FROM commit_edges GROUP BY child HAVING count(*) > 1)", "commit_edges", recursive=True))
def unique_commits(s: SparkSession, d: str) -> DataFrame:
    edges, a, b = commit_edges(s, d)
    return commits.unique_commits(edges, b, a, merges=False)


@query(with_views(REACH_SQL + ", c AS (SELECT node FROM a INTERSECT SELECT node FROM b) SELECT node FROM c WHERE node NOT IN (SELECT parent FROM commit_edges JOIN c ON c.node = child)", "commit_edges", recursive=True))
def merge_base(s: SparkSession, d: str) -> DataFrame:
    return commits.merge_bases(*commit_edges(s, d))


REFS_SQL = "refs AS (SELECT concat(CASE n_nationkey % 3 WHEN 0 THEN 'refs/heads/' WHEN 1 THEN 'refs/remotes/' ELSE '' END, n_name) AS name, md5(n_name) AS sha FROM nation UNION ALL SELECT concat('refs/remotes/', n_name), md5(concat('r', n_name)) FROM nation WHERE n_nationkey % 3 = 0)"


@query("WITH " + REFS_SQL + ", asked AS (SELECT n_name AS asked FROM nation UNION ALL SELECT 'nowhere'), hits AS (SELECT asked, name, sha, CASE WHEN name = concat('refs/heads/', asked) THEN 0 WHEN name = concat('refs/remotes/', asked) THEN 1 ELSE 2 END AS p FROM asked JOIN refs ON name IN (concat('refs/heads/', asked), concat('refs/remotes/', asked), asked)) SELECT asked.asked AS asked, arg_min(name, p) AS ref, arg_min(sha, p) AS sha FROM asked LEFT JOIN hits ON hits.asked = asked.asked GROUP BY 1")
def resolve_ref(s: SparkSession, d: str) -> DataFrame:
    nation = s.read.parquet(f"{d}/nation.parquet")
    k, name = F.col("n_nationkey") % 3, F.col("n_name")
    refs = nation.select(F.concat(F.when(k == 0, "refs/heads/").when(k == 1, "refs/remotes/").otherwise(""), name).alias("name"), F.md5(name).alias("sha"))
    refs = refs.unionByName(nation.where(k == 0).select(F.concat(F.lit("refs/remotes/"), name).alias("name"), F.md5(F.concat(F.lit("r"), name)).alias("sha")))
    names = nation.select(name.alias("asked")).union(s.createDataFrame([("nowhere",)], "asked string"))
    return commits.resolve_refs(refs, names)


def customer_refs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    customers = s.read.parquet(f"{d}/customer.parquet")
    place = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'refs/heads/' WHEN 1 THEN 'refs/remotes/' WHEN 2 THEN '' ELSE 'refs/tags/' END")
    return customers.select(F.concat(place, "c_name").alias("name"), F.md5("c_mktsegment").alias("sha")), customers


@query("SELECT c_name AS asked, c_custkey % 4 <> 3 AS found FROM customer")
def branch_exists(s: SparkSession, d: str) -> DataFrame:
    """Names of heads, remotes and whole references are found, those of tags are not."""
    refs, customers = customer_refs(s, d)
    return commits.branches_exist(refs, customers.select(F.col("c_name").alias("asked")))


@query("SELECT x.c_name AS a, y.c_name AS b, coalesce(x.c_custkey % 4 <> 3 AND y.c_custkey % 4 <> 3 AND x.c_mktsegment = y.c_mktsegment, false) AS identical FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1")
def identical_branches(s: SparkSession, d: str) -> DataFrame:
    refs, customers = customer_refs(s, d)
    after = customers.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("b"))
    return commits.identical_branches(refs, customers.select("c_custkey", F.col("c_name").alias("a")).join(after, "c_custkey").select("a", "b"))


@query("SELECT md5(c_name) AS sha, substr(md5(c_name), 1, 7) AS short_sha, c_name AS author, concat(c_name, '@x.org') AS email, '2024-01-01T00:00:00Z' AS date, c_mktsegment AS message FROM customer")
def commit_info(s: SparkSession, d: str) -> DataFrame:
    nul = F.lit("\0")
    name = F.col("c_name")
    raw = F.concat(F.md5(name), nul, F.substring(F.md5(name), 1, 7), nul, name, nul, name, F.lit("@x.org"), nul, F.lit("2024-01-01T00:00:00Z"), nul, "c_mktsegment", F.lit("\n"))
    return s.read.parquet(f"{d}/customer.parquet").select(text.commit_record(raw).alias("c")).select("c.*")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('2.', CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING)) ELSE concat('hg ', CAST(p_size AS STRING)) END AS version, count(*) AS n FROM part GROUP BY 1")
def git_version(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("git version 2."), size, F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(" (x)"))).otherwise(F.concat(F.lit("hg "), size))
    return s.read.parquet(f"{d}/part.parquet").groupBy(text.git_version(raw).alias("version")).agg(F.count("*").alias("n"))


@query("SELECT s AS score, CASE WHEN s >= 75 THEN '#2ed573' WHEN s >= 50 THEN '#ffa502' WHEN s >= 25 THEN '#ff6348' ELSE '#ff4757' END AS color FROM (SELECT DISTINCT CAST(p_partkey % 101 AS INTEGER) AS s FROM part)")
def health_colors(s: SparkSession, d: str) -> DataFrame:
    scores = s.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 101).cast("int").alias("score")).distinct()
    return scores.withColumn("color", health_color(F.col("score")))
