"""The registered queries: every operator over whole tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.catalogue import AI_PATH, RULES, SECRET, FunctionRule, Pattern, Rule
from palisade.functions.calls import call_arguments
from palisade.functions.entropy import is_high_entropy, shannon_entropy, token_entropy
from palisade.functions.masking import mask, mask_first
from palisade.functions.paths import is_pruned
from palisade.functions.positions import (
    hit_lines, line_positions, mark_matches, match_positions, matched_texts, pieces_from_matches,
)
from palisade.functions.prompts import (
    is_safe_expression, is_untrusted_expression, placeholders,
)
from palisade.functions.text import SPACE_CHARS, java_regex, lines_of
from palisade.operators import configured, diff, evaluate, scan, score, suppress, verdicts
from palisade.operators.detect import is_python
from palisade.plans import reports
from palisade.plans.store import shared_folder
from palisade.settings import PREFIX, ScanConfig
from palisade.sources import corpus, derived
from palisade.streaming import pushes as streaming

Query = Callable[[SparkSession, str], DataFrame]

NUMBERS_AND_TAGS = r"""\b\d{3,}|<(?:h[1-6]|a\s+href)[^>]*>"""
TOKEN = r"[A-Za-z0-9_]{20,}"
GENERIC_TOKEN = Rule(
    rule_id="CUSTOM-001",
    name="Token assignment",
    description="A variable named token is set to a long literal.",
    severity="medium",
    category="secret",
    patterns=(Pattern(r"""\btoken\s*=\s*(?:"|&quot;)([0-9a-f]{32,})(?:"|&quot;)""", groups=(1,)),),
    fix="Load the token at run time.",
    kind=SECRET,
    min_entropy=3.0,
    redact=True,
)


def _token_rule(number: int, name: str, pattern: str, groups: tuple[int, ...]) -> Rule:
    return Rule(
        rule_id=f"CUSTOM-{number:03d}", name=name, description="A token that the pattern tells by what stands around it.",
        severity="medium", category="secret", patterns=(Pattern(pattern, groups=groups),),
        kind=SECRET, min_entropy=3.0, redact=True,
    )


LOOKAROUND = (
    _token_rule(11, "Quote ahead", r"""token\s*=\s*"([0-9a-f]{32,})(?=")""", (1,)),
    _token_rule(12, "Assignment behind", r"""(?<=token = ")[0-9a-f]{32,}""", ()),
    _token_rule(13, "Nested", r"""((token)\s*=\s*(?:"|&quot;)(([0-9a-f]{8})[0-9a-f]{24,}))""", (3,)),
    _token_rule(14, "Group ahead", r"""\btoken\b(?=\s*=\s*"([0-9a-f]{32,}))""", (1,)),
)
WIDTH = 160


def wide_lines(text: str, path: str) -> list[tuple[int, int, str]]:
    return [(n, WIDTH + 1, t[:40]) for n, t in enumerate(text.split("\n"), 1) if len(t) > WIDTH]


def eval_calls(text: str, path: str) -> list[tuple[int, int, str]]:
    lines = enumerate(text.split("\n"), 1)
    return [(n, t.index("eval(") + 1, t.strip(SPACE_CHARS)) for n, t in lines if "eval(" in t]


def _function(number, name, match, **extra) -> FunctionRule:
    return FunctionRule(f"FUNCTION-{number}", name, name, "medium", "code-quality", match, **extra)


FUNCTIONS = (
    _function(1, "Wide line", wide_lines),
    _function(2, "Call of eval", eval_calls, path_pattern=AI_PATH, skip_suffixes=("fixtures.ts",)),
    _function(3, "Turned off", eval_calls),
)
IGNORES = ("dist/**", "vendor/", "*.yaml", "./tests", "docs", "*.min.js", "fixtures/**", "")
IGNORING = ScanConfig(ignore_paths=IGNORES)
DISABLED = ("AIS-002", "SEC-001", "MCP-004")
OVERRIDES = {"SEC-005": "critical", "AIS-004": "low", "MCP-005": "info"}
BY_FUNCTION = ScanConfig(
    ignore_paths=IGNORES, builtin_rules=(), function_rules=FUNCTIONS, disabled_rules=("FUNCTION-3",),
    severity_overrides={"FUNCTION-1": "low"},
)
BUDGET = 3000
#: Findings to a piece of a report, small enough for several pieces of each scan.
PIECE = 25
NOTE = "{} texts were reviewed, {} of them are doubtful."
THRESHOLDS = ("info", "medium", "high", "critical")


def _findings(spark: SparkSession, folder: str, **config) -> DataFrame:
    return scan.scan_files(derived.files(spark, folder), ScanConfig(**config))


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return scan.scan_files(derived.files(spark, folder), keep_clean=True)


def _described(spark: SparkSession, folder: str) -> DataFrame:
    return scan.describe(_findings(spark, folder))


def _stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scan results and described findings from one pass, kept in order as a small table."""
    rows = reports.in_order(_rows(spark, folder))
    found = rows.where(F.col("rule_id").isNotNull()).drop("first_row")
    return score.scan_result(rows), scan.describe(found)


def _result(spark: SparkSession, folder: str) -> DataFrame:
    return score.scan_result(_rows(spark, folder))


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts.parse_verdicts(derived.responses(spark, folder))


def _reviewed(spark: SparkSession, folder: str) -> DataFrame:
    found = diff.scan_diff(derived.diffs(spark, folder))
    return verdicts.join_verdicts(found, verdicts.verdict_rows(_reviews(spark, folder)))


# --- sources ------------------------------------------------------------------


def corpus_files(spark, folder):
    return derived.files(spark, folder).select(
        "scan_id", "file_path", F.size(lines_of(F.col("content"))).alias("n_lines"),
        F.length("content").alias("n_chars"), F.md5("content").alias("digest"),
    )


def prune_paths(spark, folder):
    files = derived.files(spark, folder)
    return files.where(~is_pruned(F.col("file_path"))).select("scan_id", "file_path")


def prune_paths_ci(spark, folder):
    files = derived.files(spark, folder)
    return files.where(~is_pruned(F.col("file_path"), "ci")).select("scan_id", "file_path")


def ignore_patterns(spark, folder):
    found = corpus.ignore_patterns(derived.files(spark, folder), ("docs/", "dist/**"))
    return found.select(
        "scan_id", "pattern", F.col("ord.src").alias("src"), F.col("ord.file_path").alias("origin"),
        F.col("ord.line").alias("line_ord"),
    )


def benchmark_cases(spark, folder):
    return derived.cases(spark, folder).select(
        "id", "category", "expected_vulnerability", "expected_rule_id", "file_path",
        F.md5("code").alias("digest"),
    )


def parse_verdicts(spark, folder):
    return _reviews(spark, folder).select(
        "scan_id", "summary", F.size("analysis").alias("n_verdicts"),
        F.array_join(
            F.transform(
                "analysis",
                lambda v: F.concat_ws(
                    ":", v["ruleId"], v["line"].cast("string"), v["verdict"],
                    F.round(v["confidence"] * 100).cast("int").cast("string"), v["reasoning"],
                    v["suggestedPatch"],
                ),
            ),
            ";",
        ).alias("verdicts"),
        F.array_join("recommendations", ";").alias("recommendations"),
    )


def history_blocks(spark, folder):
    """Histories written as one text file per source and read back in as many tasks as they are long."""
    base = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    texts = derived.histories(spark, folder).repartition("scan_id").sortWithinPartitions("scan_id", "doc_id")
    texts.select("scan_id", "text").write.partitionBy("scan_id").text(base)
    scan = F.regexp_extract("_metadata.file_path", "/scan_id=([^/]*)/", 1)
    return corpus.read_history(spark, base, F.url_decode(scan)).select(
        "scan_id", "block_ord", F.coalesce("commit", F.lit("")).alias("commit"),
        F.length("block").alias("n_chars"), F.md5("block").alias("digest"),
    )


# --- diffs --------------------------------------------------------------------


def diff_blocks(spark, folder):
    return diff.diff_blocks(derived.diffs(spark, folder)).select(
        "scan_id", "block_ord", F.length("block").alias("n_chars"), F.md5("block").alias("digest")
    )


def _diff_files(spark, folder):
    return diff.diff_files(derived.diffs(spark, folder))


def diff_files(spark, folder):
    return _diff_files(spark, folder).select("scan_id", "block_ord", "file")


def diff_hunks(spark, folder):
    return diff.diff_hunks(_diff_files(spark, folder)).select(
        "scan_id", "block_ord", "file", "hunk_ord", "new_start"
    )


def diff_lines(spark, folder):
    lines = diff.diff_lines(diff.diff_hunks(_diff_files(spark, folder)))
    return lines.withColumn("new_line", F.coalesce("new_line", F.lit(0)))  # 0: not in the new file


def hunk_text(spark, folder):
    hunks = diff.hunk_text(diff.diff_hunks(_diff_files(spark, folder)))
    return hunks.select(
        "scan_id", "block_ord", "hunk_ord", F.md5("content").alias("digest"),
        F.size("added").alias("n_lines"), F.size(F.filter("added", lambda a: a)).alias("n_added"),
    )


DIFF_COLUMNS = ("scan_id", "file", "line", "rule_id", "severity", "column", "snippet", "suppressed")


def scan_diff(spark, folder):
    return diff.scan_diff(derived.diffs(spark, folder)).select(*DIFF_COLUMNS)


def diff_dedupe(spark, folder):
    """History texts holding every commit twice: each hit counts once, the first wins."""
    twice = derived.diffs(spark, folder).withColumn("diff_text", F.repeat("diff_text", 2))
    return diff.scan_diff(twice).select(*DIFF_COLUMNS, "block_ord", "hunk_ord")


def budget_diff(spark, folder):
    """Blocks of files with active findings come first."""
    diffs = derived.diffs(spark, folder)
    fitted = diff.budget_diff(diffs, scan.active(diff.scan_diff(diffs)), BUDGET)
    return fitted.select(
        "scan_id", F.length("budgeted").alias("n_chars"), F.md5("budgeted").alias("digest")
    )


# --- filters and joins --------------------------------------------------------


def filter_ignored(spark, folder):
    files = derived.files(spark, folder)
    return scan.filter_ignored(files, IGNORING).select("scan_id", "file_path")


def scan_with_ignore_files(spark, folder):
    """Findings outside the paths that the ignore files of their own scan cover."""
    found = scan.scan_with_ignore_files(derived.files(spark, folder), ScanConfig())
    return found.select(*FINDING_COLUMNS, "suppressed")


def scan_configs(spark, folder):
    """Totals and gate of each scan under its own configuration."""
    files = derived.files(spark, folder).unionByName(derived.config_files(spark, folder))
    return configured.configured_result(configured.scan_configured(files))


def include_tests(spark, folder):
    files = derived.files(spark, folder)
    return scan.filter_ignored(files, IGNORING.including_tests()).select("scan_id", "file_path")


def disable_rules(spark, folder):
    return _findings(spark, folder, disabled_rules=DISABLED).select(*FINDING_COLUMNS)


FINDING_COLUMNS = (
    "scan_id", "file", "rule_id", "severity", "category", "line", "column", "snippet",
)


def scan_files(spark, folder):
    return _findings(spark, folder).select(
        *FINDING_COLUMNS, F.round("entropy", 6).alias("entropy"), "suppressed"
    )


def active_findings(spark, folder):
    return scan.active(_findings(spark, folder)).select(*FINDING_COLUMNS)


def apply_suppressions(spark, folder):
    return _findings(spark, folder).select(
        "scan_id", "file", "rule_id", "line", "column", "suppressed"
    )


def join_verdicts(spark, folder):
    return _reviewed(spark, folder).select(
        "scan_id", "file", "line", "rule_id", "verdict", F.round("confidence", 6).alias("confidence"),
        "reasoning", "suggested_patch",
    )


def severity_overrides(spark, folder):
    return _findings(spark, folder, severity_overrides=OVERRIDES).select(*FINDING_COLUMNS)


def enrich_cwe(spark, folder):
    return _described(spark, folder).select(
        "scan_id", "file", "line", "column", "rule_id", "cwe_id", "owasp_category"
    )


# --- functions ----------------------------------------------------------------


def match_positions_query(spark, folder):
    texts = derived.page_files(spark, folder).unionByName(derived.files(spark, folder))
    found = match_positions(F.col("content"), F.lit(java_regex(NUMBERS_AND_TAGS)))
    placed = texts.select("file_path", found.alias("f")).select(
        "file_path", F.transform("f.lines", lambda x: F.md5(x["snippet"])).alias("lines"), "f.matches"
    )
    return placed.select("file_path", "lines", F.posexplode("matches").alias("nth", "m")).select(
        "file_path", "nth", "m.line", "m.column", "m.text", F.get("lines", F.col("m.nth")).alias("snippet")
    )


def shannon_entropy_query(spark, folder):
    pages = derived.table(spark, folder, "pages")
    return pages.select("page_id", F.round(shannon_entropy(F.col("url")), 6).alias("entropy"))


def _tokens(spark, folder):
    texts = derived.files(spark, folder).select(
        "file_path",
        F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("nth", "token"),
    )
    return texts


def high_entropy_tokens(spark, folder):
    token = F.col("token")
    return _tokens(spark, folder).select(
        "file_path", "nth", "token", F.round(token_entropy(token), 6).alias("entropy"),
        is_high_entropy(token).alias("is_high"),
    )


def mask_secrets(spark, folder):
    token = F.col("token")
    line = F.concat(F.lit("key="), token, F.lit(" or "), token)
    return _tokens(spark, folder).select(
        "file_path", "nth", mask(token).alias("masked"),
        mask_first(line, token, mask(token)).alias("line"),
    )


def call_args(spark, folder):
    rule = next(r for r in RULES if r.rule_id == "AIS-004")
    pattern = F.lit(rule.patterns[0].java)
    files = derived.files(spark, folder).where(F.rlike("content", pattern)).withColumn(
        "marked", mark_matches(F.col("content"), pattern)
    )
    marked = F.col("marked")
    arguments = call_arguments(pieces_from_matches(marked), matched_texts(marked))
    zipped = F.zip_with(
        line_positions(hit_lines(marked)), arguments,
        lambda p, a: F.struct(p["line"].alias("line"), p["column"].alias("column"),
                              a.alias("arguments")),
    )
    return files.select("file_path", F.inline(zipped))


def prompt_placeholders(spark, folder):
    files = derived.files(spark, folder).unionByName(derived.chat_files(spark, folder))
    found = placeholders(F.col("content"), is_python(F.col("file_path")))
    rows = files.select("file_path", F.posexplode(found).alias("nth", "placeholder"))
    expr = F.col("placeholder")
    return rows.select(
        "file_path", "nth", "placeholder", is_safe_expression(expr).alias("safe"),
        is_untrusted_expression(expr).alias("untrusted"),
    )


def suppressions(spark, folder):
    return suppress.suppressions(derived.files(spark, folder), PREFIX)


def block_suppressions(spark, folder):
    return suppress.block_suppressions(derived.files(spark, folder), PREFIX)


# --- rules --------------------------------------------------------------------

RULE_COLUMNS = ("scan_id", "file", "line", "column", "snippet")


def rule_query(rule: Rule) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        files = derived.files(spark, folder)
        if rule.rule_id == "AIS-001":
            files = files.unionByName(derived.chat_files(spark, folder))
        found = scan.scan_files(files, ScanConfig(builtin_rules=(rule,)))
        return found.select(*RULE_COLUMNS, F.round("entropy", 6).alias("entropy"))

    return run


def custom_rule_generic_token(spark, folder):
    files = derived.files(spark, folder).unionByName(derived.page_files(spark, folder))
    config = ScanConfig(builtin_rules=(), custom_rules=(GENERIC_TOKEN,))
    return scan.scan_files(files, config).select(
        *RULE_COLUMNS, F.round("entropy", 6).alias("entropy")
    )


def custom_rule_lookaround(spark, folder):
    """Tokens told by lookaheads, lookbehinds and nested groups."""
    files = derived.files(spark, folder).unionByName(derived.page_files(spark, folder))
    found = scan.scan_files(files, ScanConfig(builtin_rules=(), custom_rules=LOOKAROUND))
    return found.select("rule_id", *RULE_COLUMNS, F.round("entropy", 6).alias("entropy"))


def custom_rule_function(spark, folder):
    """Rules written in Python, with ignored paths, suppressions, a disabled rule and an override."""
    return scan.scan_files(derived.files(spark, folder), BY_FUNCTION).select(
        *FINDING_COLUMNS, "suppressed"
    )


def custom_rule_diff(spark, folder):
    """The same rules on the added lines of diffs."""
    return diff.scan_diff(derived.diffs(spark, folder), BY_FUNCTION).select(*DIFF_COLUMNS)


# --- aggregation --------------------------------------------------------------


def severity_summary(spark, folder):
    return _result(spark, folder).select("scan_id", "critical", "high", "medium", "low", "info")


def risk_score(spark, folder):
    return _result(spark, folder).select("scan_id", "risk_score")


def threshold_gate(spark, folder):
    """The gate of each scan and file group at several thresholds, in one pass."""
    rows = _rows(spark, folder).withColumn(
        "scan_id", F.concat_ws(":", "scan_id", F.element_at(F.split("file", "\\."), -1))
    )
    totals = score.scan_result(rows)
    return totals.select(
        "scan_id",
        *[
            (sum((F.col(s) for s in score.SEVERITIES[score.threshold_rank(t):]), F.lit(0)) == 0)
            .alias(f"passed_{t}")
            for t in THRESHOLDS
        ],
        F.col("passed"),
    )


def scan_result(spark, folder):
    return _result(spark, folder)


def scan_result_diff(spark, folder):
    return score.diff_result(diff.scan_diff(derived.diffs(spark, folder), keep_clean=True))


def risk_band(spark, folder):
    totals = scan_result_diff(spark, folder)
    return totals.select("scan_id", "risk_score", score.risk_band(F.col("risk_score")).alias("band"))


def findings_by_file(spark, folder):
    return score.findings_by_file(scan.active(_findings(spark, folder)))


def detector_confusion(spark, folder):
    return evaluate.confusion(evaluate.detections(derived.cases(spark, folder)))


def detector_tiers(spark, folder):
    return evaluate.tiers(evaluate.detections(derived.cases(spark, folder)), total=True)


def detector_metrics(spark, folder):
    return evaluate.metrics(evaluate.detections(derived.cases(spark, folder)))


def review_gate(spark, folder):
    return verdicts.review_gate(_reviews(spark, folder), scan_result_diff(spark, folder))


# --- reports ------------------------------------------------------------------


def json_report(spark, folder):
    results, described = _stored(spark, folder)
    rounded = described.withColumn("entropy", F.round("entropy", 6))
    return reports.json_documents(results, rounded, PIECE)


def sarif_results(spark, folder):
    return reports.sarif_results(_described(spark, folder)).drop("rule_ord", "match_ord")


def sarif_rules(spark, folder):
    return reports.sarif_rules(_described(spark, folder))


def sarif_report(spark, folder):
    return reports.sarif_documents(*_stored(spark, folder), PIECE)


def markdown_report(spark, folder):
    """With notes on the scans of which documents have been labelled."""
    results, described = _stored(spark, folder)
    labels = derived.table(spark, folder, "labels").join(derived.table(spark, folder, "documents"), "doc_id")
    counted = labels.groupBy(F.col("source").alias("scan_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("bad")
    )
    notes = counted.select("scan_id", reports.worded(NOTE, "n", "bad").alias("notes"))
    return reports.markdown_documents(results, described, notes, PIECE)


def findings_table(spark, folder):
    """The stored findings of two categories, one of which has been written again without what is
    suppressed."""
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    found = _findings(spark, folder)
    reports.write_findings(found, path)
    reports.write_findings(scan.active(found).where(F.col("category") == "mcp"), path)
    return reports.read_findings(spark, path, "secret", "mcp").select(*FINDING_COLUMNS, "suppressed")


def annotations(spark, folder):
    return reports.annotations(_described(spark, folder))


def review_comments(spark, folder):
    return reports.review_comments(_described(spark, folder))


def verdict_comments(spark, folder):
    described = scan.describe(_reviewed(spark, folder))
    return reports.verdict_comments(described).drop("rule_ord", "match_ord")


def top_comments(spark, folder):
    """First ten active findings per source, in file order."""
    found = scan.active(_findings(spark, folder)).select(
        "scan_id", "file", "rule_ord", "match_ord", "rule_id", "line"
    )
    return reports.top_comments(found, ["file", "rule_ord", "match_ord"]).select(
        "scan_id", "nth", "file", "rule_id", "line"
    )


def top_verdict_comments(spark, folder):
    """First ten comments per diff of those left once dismissed findings are dropped."""
    comments = reports.verdict_comments(scan.describe(_reviewed(spark, folder)))
    return reports.top_comments(comments, ["path", "line", "rule_ord"]).select(
        "scan_id", "nth", "path", "line", "body"
    )


def verdict_report(spark, folder):
    return reports.verdict_documents(_reviews(spark, folder))


# --- streaming ----------------------------------------------------------------


def stream_scan_diffs(spark, folder):
    """Push events as a stream: redeliveries dropped, findings scored per day."""
    base = f"{shared_folder(spark)}/push-scan-{uuid.uuid4().hex}"
    derived.pushes(spark, folder).write.parquet(f"{base}/in")
    diffs = derived.push_diffs(spark, folder)
    schema = spark.read.parquet(f"{base}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in")
    streaming.start_push_scan(stream, diffs, f"{base}/out", f"{base}/state").awaitTermination()
    return streaming.daily_risk(spark.read.parquet(f"{base}/out"))


QUERIES: dict[str, Query] = {
    "corpus_files": corpus_files,
    "prune_paths": prune_paths,
    "prune_paths_ci": prune_paths_ci,
    "ignore_patterns": ignore_patterns,
    "benchmark_cases": benchmark_cases,
    "parse_verdicts": parse_verdicts,
    "diff_blocks": diff_blocks,
    "diff_files": diff_files,
    "diff_hunks": diff_hunks,
    "diff_lines": diff_lines,
    "hunk_text": hunk_text,
    "scan_diff": scan_diff,
    "diff_dedupe": diff_dedupe,
    "budget_diff": budget_diff,
    "filter_ignored": filter_ignored,
    "scan_with_ignore_files": scan_with_ignore_files,
    "scan_configs": scan_configs,
    "history_blocks": history_blocks,
    "include_tests": include_tests,
    "disable_rules": disable_rules,
    "scan_files": scan_files,
    "active_findings": active_findings,
    "apply_suppressions": apply_suppressions,
    "join_verdicts": join_verdicts,
    "severity_overrides": severity_overrides,
    "enrich_cwe": enrich_cwe,
    "match_positions": match_positions_query,
    "shannon_entropy": shannon_entropy_query,
    "high_entropy_tokens": high_entropy_tokens,
    "mask_secrets": mask_secrets,
    "call_args": call_args,
    "prompt_placeholders": prompt_placeholders,
    "suppressions": suppressions,
    "block_suppressions": block_suppressions,
    **{f"rule_{r.rule_id.lower().replace('-', '_')}": rule_query(r) for r in RULES},
    "custom_rule_generic_token": custom_rule_generic_token,
    "custom_rule_lookaround": custom_rule_lookaround,
    "custom_rule_function": custom_rule_function,
    "custom_rule_diff": custom_rule_diff,
    "severity_summary": severity_summary,
    "risk_score": risk_score,
    "threshold_gate": threshold_gate,
    "scan_result": scan_result,
    "scan_result_diff": scan_result_diff,
    "risk_band": risk_band,
    "findings_by_file": findings_by_file,
    "detector_confusion": detector_confusion,
    "detector_tiers": detector_tiers,
    "detector_metrics": detector_metrics,
    "review_gate": review_gate,
    "json_report": json_report,
    "sarif_results": sarif_results,
    "sarif_rules": sarif_rules,
    "sarif_report": sarif_report,
    "markdown_report": markdown_report,
    "findings_table": findings_table,
    "annotations": annotations,
    "review_comments": review_comments,
    "verdict_comments": verdict_comments,
    "top_comments": top_comments,
    "top_verdict_comments": top_verdict_comments,
    "verdict_report": verdict_report,
    "stream_scan_diffs": stream_scan_diffs,
}
