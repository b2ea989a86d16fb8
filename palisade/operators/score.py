"""Severity counts, risk score, gate: one partial aggregation per scan.

Every aggregate here is a count, sum or max, so map-side combination reduces even a
scan that owns a third of all findings to one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.catalogue import SEVERITIES
from palisade.settings import DEFAULT_THRESHOLD

# Points per finding, the cap, and the bounds of the risk bands.
WEIGHTS = {"critical": 40, "high": 20, "medium": 10, "low": 5, "info": 1}
MAX_SCORE = 100
HIGH_RISK, MODERATE_RISK = 50, 20


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def threshold_rank(threshold: str) -> int:
    if threshold not in SEVERITIES:
        raise ValueError(f"unknown severity: {threshold}")
    return SEVERITIES.index(threshold)


def severity_points(severity: Column) -> Column:
    points = F.lit(0)
    for name, value in WEIGHTS.items():
        points = F.when(severity == name, F.lit(value)).otherwise(points)
    return points


def scan_result(
    rows: DataFrame, threshold: str = DEFAULT_THRESHOLD, scanned_files: Column | None = None
) -> DataFrame:
    """One row per scan from findings that include clean files (``keep_clean=True``)."""
    if scanned_files is None:
        scanned_files = F.count_if(F.col("first_row"))
    return score_rows(rows, scanned_files, F.lit(threshold_rank(threshold)))


def score_rows(rows: DataFrame, scanned_files: Column, threshold: Column) -> DataFrame:
    """``scan_result`` with the rank of the threshold as an aggregate column."""
    found = F.col("rule_id").isNotNull()
    live = found & ~F.col("suppressed")
    severity = F.col("severity")
    totals = rows.groupBy("scan_id").agg(
        scanned_files.alias("scanned_files"),
        F.count_if(live).alias("findings_count"),
        F.count_if(found & F.col("suppressed")).alias("suppressed_count"),
        *[F.count_if(live & (severity == s)).alias(s) for s in reversed(SEVERITIES)],
        F.coalesce(F.sum(F.when(live, severity_points(severity))), F.lit(0)).alias("_points"),
        F.coalesce(F.max(F.when(live, severity_rank(severity))), F.lit(-1)).alias("_worst"),
        threshold.alias("_threshold"),
    )
    return totals.select(
        "scan_id",
        "scanned_files",
        "findings_count",
        "suppressed_count",
        *reversed(SEVERITIES),
        F.least(F.lit(MAX_SCORE), F.col("_points")).cast("int").alias("risk_score"),
        (F.col("_worst") < F.col("_threshold")).alias("passed"),
    )


def diff_result(rows: DataFrame, threshold: str = DEFAULT_THRESHOLD) -> DataFrame:
    """``scan_result`` for ``scan_diff(..., keep_clean=True)``: the files of each diff count."""
    return scan_result(rows, threshold, F.count_distinct("file"))


def risk_band(score: Column) -> Column:
    return (
        F.when(score > HIGH_RISK, F.lit("high"))
        .when(score > MODERATE_RISK, F.lit("moderate"))
        .otherwise(F.lit("safe"))
    )


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Findings of each file in order; a group is bounded by one file's text."""
    entry = F.struct(
        "rule_ord", "match_ord", F.concat_ws(":", "rule_id", "line", "column").alias("label")
    )
    return findings.groupBy("scan_id", "file").agg(
        F.count("*").alias("issues"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["label"]), ","
        ).alias("findings"),
    )
