"""Detector quality against labelled cases: confusion, tiers, precision / recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.scan import scan_files
from palisade.settings import ScanConfig

# Tier names and the F1 a run must reach.
NEGATIVE_TIER = "Tier 4: False Positive Resistance"
TIERS = {
    "secret": "Tier 1: Secrets & Shannon Entropy",
    "mcp": "Tier 3: Model Context Protocol (MCP)",
}
ALL_TIERS = "all"
OTHER_TIER = "Tier 2: OWASP Top 10 for LLM"
PASSING_F1 = 90


def detections(cases: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """One row per case with ``detected``: at least one active finding of any rule."""
    files = cases.select(
        F.struct("id", "category", "expected_vulnerability", "expected_rule_id").alias("scan_id"),
        "file_path",
        F.col("code").alias("content"),
    )
    rows = scan_files(files, config, keep_clean=True)
    live = F.col("rule_id").isNotNull() & ~F.col("suppressed")
    return rows.groupBy("scan_id").agg(
        F.coalesce(F.max(live), F.lit(False)).alias("detected"),
        F.coalesce(
            F.max(live & (F.col("rule_id") == F.col("scan_id.expected_rule_id"))), F.lit(False)
        ).alias("expected_rule_found"),
    ).select("scan_id.*", "detected", "expected_rule_found")


def _matrix() -> list[Column]:
    expected, detected = F.col("expected_vulnerability"), F.col("detected")
    return [
        F.count("*").alias("total"),
        F.count_if(expected & detected).alias("tp"),
        F.count_if(~expected & detected).alias("fp"),
        F.count_if(~expected & ~detected).alias("tn"),
        F.count_if(expected & ~detected).alias("fn"),
    ]


def confusion(detected: DataFrame) -> DataFrame:
    return detected.agg(*_matrix())


def tiers(detected: DataFrame, total: bool = False) -> DataFrame:
    """Counts per tier and, with ``total``, of all (``ALL_TIERS``), by grouping sets in one aggregation.

    A tier passes without false negatives and positives."""
    tier = F.when(~F.col("expected_vulnerability"), F.lit(NEGATIVE_TIER))
    for category, name in TIERS.items():
        tier = tier.when(F.col("category") == category, F.lit(name))
    named = detected.withColumn("tier", tier.otherwise(F.lit(OTHER_TIER)))
    key = F.col("tier")
    grouped = named.groupingSets([[key], []] if total else [[key]], key).agg(F.grouping("tier").alias("_all"), *_matrix())
    return grouped.select(
        F.when(F.col("_all") == 1, F.lit(ALL_TIERS)).otherwise(F.col("tier")).alias("tier"),
        *[c for c in grouped.columns if c not in ("tier", "_all")],
        ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("passed"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(100.0))


def metrics(detected: DataFrame) -> DataFrame:
    """Percentages with one decimal, rounded half up."""
    raw = confusion(detected).select(
        "*",
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("_p"),
        _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("_r"),
    )
    p, r = F.col("_p"), F.col("_r")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return raw.select(
        "total", "tp", "fp", "tn", "fn",
        F.round(p, 1).alias("precision"),
        F.round(r, 1).alias("recall"),
        F.round(f1, 1).alias("f1"),
        (F.round(f1, 1) >= PASSING_F1).alias("passed"),
    )
