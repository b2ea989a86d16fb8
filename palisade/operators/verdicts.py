"""Stored model reviews: parsing, lookup by finding, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The response schema, the verdict words and the default texts.
ANALYSIS_DDL = (
    "array<struct<ruleId:string,line:int,verdict:string,confidence:double,reasoning:string,"
    "suggestedPatch:string>>"
)
RESPONSE_DDL = (
    f"summary string, findingsAnalysis {ANALYSIS_DDL}, architecturalRecommendations array<string>"
)
CONFIRMED, FALSE_POSITIVE, UNSURE = (
    "CONFIRMED_VULNERABILITY", "FALSE_POSITIVE", "NEEDS_INVESTIGATION",
)
DEFAULT_SUMMARY = "AI Semantic Review completed."
FAILED_SUMMARY = "AI Semantic Review could not complete: invalid response"
FAILED_ADVICE = "Check the model credentials and the network connection."


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """``(scan_id, summary, analysis, recommendations)`` from ``response_json``.

    Empty responses mean no review and drop out; broken JSON yields a failed review
    without verdicts; missing parts get defaults.
    """
    body = F.col("response_json")
    parsed = responses.where(F.coalesce(body, F.lit("")) != "").select(
        "scan_id",
        F.get_json_object(body, "$").isNotNull().alias("valid"),
        F.from_json(body, RESPONSE_DDL).alias("r"),
    )
    analysis = F.col("r.findingsAnalysis")
    advice = F.col("r.architecturalRecommendations")
    return parsed.select(
        "scan_id",
        F.when(~F.col("valid"), F.lit(FAILED_SUMMARY))
        .otherwise(F.coalesce(F.nullif("r.summary", F.lit("")), F.lit(DEFAULT_SUMMARY)))
        .alias("summary"),
        F.when(F.col("valid") & analysis.isNotNull(), analysis)
        .otherwise(F.array().cast(ANALYSIS_DDL))
        .alias("analysis"),
        F.when(~F.col("valid"), F.array(F.lit(FAILED_ADVICE)))
        .otherwise(F.coalesce(advice, F.array().cast("array<string>")))
        .alias("recommendations"),
    )


def verdict_rows(reviews: DataFrame) -> DataFrame:
    """One row per verdict, in response order."""
    return reviews.select(
        "scan_id", F.posexplode("analysis").alias("verdict_ord", "v")
    ).select(
        "scan_id", "verdict_ord", F.col("v.ruleId").alias("rule_id"), "v.line", "v.verdict",
        "v.confidence", "v.reasoning", F.col("v.suggestedPatch").alias("suggested_patch"),
    )


def join_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join with the first verdict of the same scan, rule and line.

    The file takes part in the key only if the verdicts carry one. The first verdict
    is picked by a ``min`` over structs, which combines map-side.
    """
    keys = ["scan_id", "rule_id", "line"] + (["file"] if "file" in verdicts.columns else [])
    fields = ("verdict", "confidence", "reasoning", "suggested_patch")
    first = verdicts.groupBy(*keys).agg(F.min(F.struct("verdict_ord", *fields)).alias("v"))
    return findings.join(
        first.select(*keys, *[F.col(f"v.{f}").alias(f) for f in fields]), keys, "left"
    )


def review_gate(
    reviews: DataFrame, results: DataFrame, on_missing: str = "pass"
) -> DataFrame:
    """Fail on a confirmed verdict, or on a failed threshold not cleared by verdicts.

    A failed threshold passes when there are no verdicts at all; ``on_missing="fail"``
    closes that gap. Scans without any review keep their threshold result.
    """
    if on_missing not in ("pass", "fail"):
        raise ValueError(f"unknown on_missing: {on_missing}")
    verdicts = F.transform("analysis", lambda v: F.coalesce(v["verdict"], F.lit("")))
    per_scan = reviews.select(
        "scan_id",
        F.exists(verdicts, lambda v: v == CONFIRMED).alias("confirmed"),
        F.exists(verdicts, lambda v: v != FALSE_POSITIVE).alias("open"),
        (F.size("analysis") > 0).alias("reviewed"),
    )
    joined = results.select("scan_id", "passed").join(per_scan, "scan_id", "left")
    unresolved = ~F.col("passed") & F.col("open")
    if on_missing == "fail":
        unresolved = unresolved | (~F.col("passed") & ~F.col("reviewed"))
    return joined.select(
        "scan_id",
        F.col("passed").alias("threshold_passed"),
        F.when(F.col("confirmed").isNull(), F.col("passed"))
        .otherwise(~F.col("confirmed") & ~unresolved)
        .alias("passed"),
    )
