"""Risks of all kinds in one shape, their enrichment, and the tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftscan.functions.levels import RISK, diagnostic_severity, ordinal
from riftscan.functions.text import or_else
from riftscan.operators.findings import PENDING

COLUMNS = ("id", "type", "risk_level", "file", "line", "function_name", "category", "change_type", "redacted_preview", "affected_files", "explanation", "recommendation")


# Texts of the risks, and of answers that are not there yet or failed.
NO_FUNCTION = "N/A (Line Overlap)"
WITHIN_TEXT = 'Function "%s" signature changed from (%s) to (%s) on this branch, but %d call site(s) IN THE SAME BRANCH still use the old signature. This will cause a runtime error.'
ACROSS_TEXT = 'Function "%s" signature changed from (%s) to (%s) on one branch, but %d call site(s) on the other branch still use the old signature. This will cause a runtime error after merge.'
UPDATE_TEXT = "Update all call sites in %s to use the new signature."
PENDING_START = "Pending AI response"
ERROR_WORDS = ("unavailable", "skipped", "Verify")
# What is shown where no explanation came: by whether a service was named, or only a key, or neither.
FOLLOW_TEXT = "Follow the fix that the explanation gives."
NO_SERVICE = ("Explanation unavailable: see that the named service answers and that its free scans are not used up.", "Start the service and scan again.")
NOTHING_SET = ("Explanation unavailable: start a local service or set a key.", "Start the service and scan again.")
NO_KEY_ANSWER = ("Explanation unavailable: verify the key.", "Check the key or the network.")


def conflict_risks(candidates: DataFrame) -> DataFrame:
    """A risk for each conflict candidate."""
    level = F.col("overlap_level")
    return candidates.select(
        F.concat(F.lit("git_"), "file", F.lit("_"), level).alias("id"),
        F.lit("semantic_conflict").alias("type"),
        F.when(level == "HIGH", "high").when(level == "MEDIUM", "medium").otherwise("low").alias("risk_level"),
        "file",
        F.coalesce("first_b_line", F.lit(1)).cast("int").alias("line"),
        F.lit(NO_FUNCTION).alias("function_name"),
        F.lit(None).cast("string").alias("category"),
        F.when(F.col("has_conflict"), "git_merge_conflict").otherwise("line_overlap").alias("change_type"),
        F.lit(None).cast("string").alias("redacted_preview"),
        F.array("file").alias("affected_files"),
        F.lit(PENDING).alias("explanation"),
        F.lit(PENDING).alias("recommendation"),
    )


def semantic_risks(conflicts: DataFrame) -> DataFrame:
    """A risk for each semantic conflict."""
    old, new = F.array_join("old_params", ", "), F.array_join("new_params", ", ")
    callers = F.transform("sites", lambda s: s["caller_file"])
    within = F.col("scope") == "intra-branch"
    n = F.size("sites")
    text = F.when(
        within,
        F.format_string(WITHIN_TEXT, F.col("name"), old, new, n),
    ).otherwise(F.format_string(ACROSS_TEXT, F.col("name"), old, new, n))
    return conflicts.select(
        F.concat_ws("_", F.lit("semantic"), "scope", "name", "file").alias("id"),
        F.lit("semantic_conflict").alias("type"),
        F.lit("high").alias("risk_level"),
        "file",
        F.lit(1).alias("line"),
        F.col("name").alias("function_name"),
        F.lit(None).cast("string").alias("category"),
        F.when(within, "intra_branch_signature_change").otherwise("signature_change").alias("change_type"),
        F.lit(None).cast("string").alias("redacted_preview"),
        callers.alias("affected_files"),
        text.alias("explanation"),
        F.format_string(UPDATE_TEXT, F.array_join(F.array_distinct(callers), ", ")).alias("recommendation"),
    )


def all_risks(*parts: DataFrame) -> DataFrame:
    """Union of risks in the common shape, in the order of the parts."""
    out = None
    for k, part in enumerate(parts):
        rows = part.select(*COLUMNS, F.lit(k).alias("part"))
        out = rows if out is None else out.unionByName(rows)
    return out


def nest(risks: DataFrame) -> DataFrame:
    """The nested shape that leaves the engine."""
    return risks.select(
        "id",
        "type",
        F.col("risk_level").alias("riskLevel"),
        F.struct("file", "line").alias("location"),
        F.struct(F.col("function_name").alias("functionName"), F.col("change_type").alias("changeType"), F.col("affected_files").alias("affectedFiles"), "category", F.col("redacted_preview").alias("redactedPreview")).alias("details"),
        F.struct("explanation", "recommendation").alias("ai_context"),
    )


def analysis_result(risks: DataFrame, analysis_id: str, timestamp: str) -> DataFrame:
    """One row with all risks; id and clock are the caller's. For a result that leaves as one message."""
    return nest(risks).agg(F.collect_list(F.struct("*")).alias("risks")).select(F.lit(analysis_id).alias("analysis_id"), F.lit(timestamp).alias("timestamp"), "risks")


def by_severity(risks: DataFrame, position: str) -> DataFrame:
    return risks.orderBy(F.desc(ordinal(F.col("risk_level"), RISK)), position)


def enrich(risks: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Explanations by id: the last of equal ids wins, empty texts leave what was there."""
    last = enrichments.groupBy("id").agg(F.max_by(F.struct("explanation", "recommendation"), "seq").alias("new"))
    joined = risks.join(last, "id", "left")
    fields = {c: or_else(F.col(f"new.{c}"), F.col(c)) for c in ("explanation", "recommendation")}
    return joined.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in risks.columns])


def enrich_by_path(risks: DataFrame, settings: DataFrame, service: DataFrame, direct: DataFrame) -> DataFrame:
    """``risks`` (analysis_id, id, explanation, recommendation, ...) with what either path explains, and the ``path`` of their analysis.

    ``settings``: analysis_id, has_service, has_key. ``service``: analysis_id,
    id, explanation, an answer for each risk. ``direct``: analysis_id, id,
    explanation, recommendation, seq, the answers to one request. A service is
    asked where one is named or there is no key, and counts for all risks of an
    analysis or for none: one risk without an answer is enough to leave it
    ('service' otherwise). Then the key's answers are taken by id, as in
    ``enrich`` ('direct'); where there are none at all, only texts that are
    still pending say so ('direct failed'). Without a key all texts of the
    analysis say so ('none').

    Defined results: an answer with a null text is none; of several the greatest
    text is taken; an analysis without settings has neither service nor key;
    answers for unknown analyses or ids are ignored, as are null ids among
    them, and a risk with a null id is one without an answer.
    """
    said = service.where("explanation is not null").groupBy("analysis_id", "id").agg(F.max("explanation").alias("said"))
    last = direct.where("id is not null").groupBy("analysis_id", "id").agg(F.max_by(F.struct("explanation", "recommendation"), "seq").alias("new"))
    asked = risks.join(said, ["analysis_id", "id"], "left").join(last, ["analysis_id", "id"], "left")
    unanswered = risks.join(said, ["analysis_id", "id"], "left_anti").select("analysis_id").distinct().withColumn("unanswered", F.lit(True))
    answered = direct.select("analysis_id").distinct().withColumn("answered", F.lit(True))
    known = settings.select("analysis_id", "has_service", "has_key").join(unanswered, "analysis_id", "full").join(answered, "analysis_id", "full")
    # Keyed by an expression, so that a large analysis is shuffled anew for this join and can be split.
    rows = asked.join(known.withColumn("of", F.concat("analysis_id", F.lit(""))).drop("analysis_id"), F.col("analysis_id") == F.col("of"), "left")
    has_service, has_key = (F.coalesce(c, F.lit(False)) for c in ("has_service", "has_key"))
    path = (
        F.when((has_service | ~has_key) & F.col("unanswered").isNull(), "service")
        .when(~has_key, "none")
        .when(F.col("answered").isNull(), "direct failed")
        .otherwise("direct")
    )
    pending = F.startswith(F.coalesce("explanation", F.lit("")), F.lit(PENDING_START))

    def text(c: str, k: int) -> Column:
        from_service = F.col("said") if k == 0 else F.lit(FOLLOW_TEXT)
        none = F.when(has_service, NO_SERVICE[k]).otherwise(NOTHING_SET[k])
        failed = F.when(pending, NO_KEY_ANSWER[k]).otherwise(F.col(c))
        by = path
        return F.when(by == "service", from_service).when(by == "direct", or_else(F.col(f"new.{c}"), F.col(c))).when(by == "direct failed", failed).otherwise(none).alias(c)

    fields = {c: text(c, k) for k, c in enumerate(("explanation", "recommendation"))}
    return rows.select(*[fields.get(c, F.col(c)) for c in risks.columns], path.alias("path"))


def parse_enrichments(responses: DataFrame) -> DataFrame:
    """id, explanation, recommendation, seq from a model's answers (``raw``, maybe in code fences); an answer that is no array gives no rows."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace("raw", r"(?i)\A```(?:json)?\s*", ""), r"\s*```\s*\z", ""))
    items = F.from_json(clean, "array<struct<id:string,explanation:string,recommendation:string>>")
    rows = responses.where(F.startswith(clean, F.lit("["))).select(F.posexplode(items).alias("seq", "x"))
    empty = F.lit("")
    return rows.select(*[F.coalesce(F.col(f"x.{c}"), empty).alias(c) for c in ("id", "explanation", "recommendation")], "seq")


def is_pending(text: Column) -> Column:
    return text.isNull() | (text == "") | F.startswith(text, F.lit(PENDING_START))


def is_error_text(text: Column) -> Column:
    out = F.lit(False)
    for w in ERROR_WORDS:
        out = out | F.contains(text, F.lit(w))
    return out


def diagnostics(risks: DataFrame, files: DataFrame, tag: str = "riftscan") -> DataFrame:
    """file, code, severity, line0, message of each risk whose file exists."""
    title = F.coalesce(F.when(F.col("type") == "semantic_conflict", F.col("function_name")).otherwise(F.col("category")), F.col("type"))
    # The distinct files of a task are few beside its risks: looked up in memory, neither side is sorted by paths.
    shown = risks.join(files.select("file").distinct().hint("shuffle_hash"), "file", "left_semi")
    return shown.select(
        "file",
        F.col("id").alias("code"),
        diagnostic_severity(F.col("risk_level")).alias("severity"),
        F.greatest(F.lit(0), F.col("line") - 1).cast("int").alias("line0"),
        F.concat(F.lit(f"[{tag}] "), title, F.lit(" — "), "explanation").alias("message"),
    )


def diagnostics_by_file(rows: DataFrame) -> DataFrame:
    """One row for each file, its diagnostics by line and code."""
    return rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line0", "code", "severity", "message"))).alias("diagnostics"))


def prompts(risks: DataFrame) -> DataFrame:
    """id and the request text to have a risk explained."""
    row = F.struct("id", "type", F.col("risk_level").alias("riskLevel"), "file", "line", F.struct("function_name", "category", "change_type", "affected_files").alias("details"))
    ask = "Explain the following risk, found in a code change, in two or three sentences: what it is, and how it could cause a fault or an incident. Then give one concrete fix.\n\nRisk:\n"
    return risks.select("id", F.concat(F.lit(ask), F.to_json(row)).alias("prompt"))


def security_posture(risks: DataFrame) -> DataFrame:
    return risks.where("type = 'security_risk'")


def first_pairs(pairs: DataFrame, k: int = 3) -> DataFrame:
    """file, the first ``k`` overlapping pairs as text, and how many more there are."""
    order = ["a_start_line", "a_end_line", "b_start_line", "b_end_line"]
    text = F.format_string("A %d-%d / B %d-%d", *order)
    # Only the first of each task's pairs of a file are shuffled, and counts: no list of all pairs is made.
    first = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("nth") <= k)
    shown = first.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("nth", text.alias("text")))).alias("all"))
    counts = pairs.groupBy("file").agg(F.count("*").alias("n"))
    return shown.join(counts, "file").select("file", F.array_join(F.transform("all", lambda x: x["text"]), "; ").alias("shown"), F.greatest(F.lit(0), F.col("n") - k).cast("int").alias("more"))
