"""Whole-file scan: files in, findings out, in one narrow pass."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.catalogue import FunctionRule, Rule
from palisade.functions.paths import ignored_paths, is_ignored
from palisade.operators.custom import function_hits
from palisade.operators.detect import detect
from palisade.operators.suppress import directives, is_suppressed
from palisade.settings import ScanConfig
from palisade.sources.corpus import ignore_patterns

FINDING_COLUMNS = (
    "scan_id", "file", "rule_ord", "match_ord", "rule_id", "severity", "category", "line",
    "column", "snippet", "entropy", "suppressed",
)


def filter_ignored(files: DataFrame, config: ScanConfig, path: str = "file_path") -> DataFrame:
    return files.where(~is_ignored(F.col(path), config.ignore_paths))


def all_hits(
    texts: DataFrame,
    config: ScanConfig,
    content: str,
    path: str,
    keep: Sequence[str],
    keep_clean: bool = False,
) -> DataFrame:
    """Hits of all active rules, with the directives of their text as ``_found``.

    Declared rules are one pass. Rules written in Python are a second one, over the texts that
    their path gates let through; without such rules it is not there.
    """
    found = directives(F.col(content), config.directive_prefix, config.strict_ids)
    rules, functions = config.rules, config.functions
    if not rules and not functions:
        raise ValueError("no active rules")
    parts = []
    if rules:
        parts.append(
            detect(texts, rules, content, path, keep, keep_clean, per_text={"_found": found})
        )
    if functions:
        noted = texts.withColumn("_found", found)
        by_function = function_hits(noted, functions, content, path, (*keep, "_found"), len(rules))
        if keep_clean and not rules:  # a row per text all the same
            new = [f for f in by_function.schema if f.name not in keep]
            nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in new]
            parts.append(texts.select(*keep, *nulls, F.lit(True).alias("first_row")))
        if keep_clean:
            by_function = by_function.withColumn("first_row", F.lit(False))
        parts.append(by_function)
    return functools.reduce(DataFrame.unionByName, parts)


def scan_files(
    files: DataFrame, config: ScanConfig | None = None, keep_clean: bool = False
) -> DataFrame:
    """Findings of ``files(scan_id, file_path, content)``; suppressed ones are marked.

    ``keep_clean`` adds a null row per clean file and ``first_row``, so that file
    counts and clean scans come out of the same single pass.
    """
    config = config or ScanConfig()
    prepared = filter_ignored(files, config).select(
        "scan_id", F.col("file_path").alias("file"), "content"
    )
    hits = all_hits(prepared, config, "content", "file", ("scan_id", "file"), keep_clean)
    flagged = hits.withColumn(
        "suppressed",
        F.when(
            F.col("rule_id").isNotNull(),
            is_suppressed(F.col("_found"), F.col("line"), F.col("rule_id")),
        ),
    )
    extra = ("first_row",) if keep_clean else ()
    return flagged.select(*FINDING_COLUMNS, *extra)


def scan_with_ignore_files(
    files: DataFrame, config: ScanConfig | None = None, keep_clean: bool = False
) -> DataFrame:
    """``scan_files`` in which each scan's own ignore files count as well.

    What is ignored for all scans is a column test before the scan. The lists of the scans are
    joined to the *paths*, by equal keys, and the paths that they cover are taken out of the
    findings: no text is shuffled, whatever the lists.
    """
    config = config or ScanConfig()
    listed = ignore_patterns(files).where(F.col("ord.src") > 1).select("scan_id", "pattern")
    paths = filter_ignored(files.select("scan_id", "file_path"), config)
    covered = ignored_paths(paths, listed).withColumnRenamed("file_path", "file")
    return scan_files(files, config, keep_clean).join(covered, ["scan_id", "file"], "left_anti")


def active(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("rule_id").isNotNull() & ~F.col("suppressed"))


def catalogue_frame(
    findings: DataFrame, rules: Sequence[Rule | FunctionRule]
) -> DataFrame:
    """The rule texts as a table: one row per rule, a size fixed by the rule list."""
    rows = [
        (r.rule_id, r.name, r.description, r.fix, r.url, r.cwe_id, r.owasp) for r in rules
    ]
    return findings.sparkSession.createDataFrame(
        rows,
        "rule_id string, title string, description string, suggested_fix string, "
        "reference_url string, cwe_id string, owasp_category string",
    )


def describe(findings: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Add title, description, fix, reference and weakness ids by rule id."""
    config = config or ScanConfig()
    texts = catalogue_frame(findings, (*config.rules, *config.functions))
    return findings.join(texts, "rule_id", "left")


def scan_with_columns(
    files: DataFrame,
    rule_id: str,
    severity: str,
    category: str,
    build: Callable[[Column, Column], Column],
) -> DataFrame:
    """A rule given as a column: ``build(content, path)`` returns what ``match_positions`` does."""
    hits = build(F.col("content"), F.col("file_path"))
    placed = files.select(
        "scan_id", F.col("file_path").alias("file"), hits.alias("hits")
    ).select("scan_id", "file", "hits.lines", F.posexplode("hits.matches").alias("match_ord", "hit"))
    return placed.select(
        "scan_id", "file", "match_ord", F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"), F.lit(category).alias("category"),
        "hit.line", "hit.column", F.get("lines", F.col("hit.nth"))["snippet"].alias("snippet"),
    )
