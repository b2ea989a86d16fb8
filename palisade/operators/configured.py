"""Scans under the configuration that each of them brings along.

A configuration is data here: the first of a scan's configuration files that can be parsed, as
one row of settings. The rules run once over all scans, with the least entropy that any setting
could ask for; the settings are then joined to the findings (never to the texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.paths import ignored_paths
from palisade.operators.scan import FINDING_COLUMNS, filter_ignored, scan_files
from palisade.operators.score import SEVERITIES, score_rows
from palisade.settings import CONFIG_FILES, ScanConfig
from palisade.sources.corpus import ignore_patterns


def scan_configs(files: DataFrame) -> DataFrame:
    """(scan_id, ignore_paths, disabled_rules, severity_overrides, min_entropy, fail_threshold).

    One row per scan with a configuration file at its root. Files are tried in the order of
    ``CONFIG_FILES``; the first that is JSON counts, even if it is no object and sets nothing.
    Fields of another type than expected are not set; entries of lists that are no text are left out.
    """
    name = F.array_position(F.array(*[F.lit(n) for n in CONFIG_FILES]), F.col("file_path"))
    parsed = files.where(F.col("file_path").isin(*CONFIG_FILES)).select(
        "scan_id", name.alias("nth"), F.try_parse_json("content").alias("config")
    )
    first = (
        parsed.where(F.col("config").isNotNull())
        .groupBy("scan_id")
        .agg(F.min_by(F.to_json("config"), "nth").alias("config"))
        .select("scan_id", F.parse_json("config").alias("config"))
    )

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("config", path, kind)

    def texts(path: str) -> Column:
        items = field(path, "array<variant>")
        quoted = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
        return F.transform(quoted, lambda v: F.variant_get(v, "$", "string"))

    entropy = F.when(
        F.schema_of_variant(field("$.minEntropy", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
        field("$.minEntropy", "double"),
    )
    return first.select(
        "scan_id",
        texts("$.ignorePaths").alias("ignore_paths"),
        texts("$.disabledRules").alias("disabled_rules"),
        field("$.severityOverrides", "map<string,string>").alias("severity_overrides"),
        entropy.alias("min_entropy"),
        F.nullif(field("$.failThreshold", "string"), F.lit("")).alias("fail_threshold"),
    )


def scan_configured(files: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Rows of ``scan_files(keep_clean=True)`` under each scan's own settings and ignore files, with
    ``fail_threshold``. What a scan does not set comes from ``config``.

    A severity that is none of the known ones is an error where it would take effect.
    """
    config = config or ScanConfig()
    settings = scan_configs(files)
    own_least = {r.rule_id: float(r.min_entropy) for r in config.rules if r.min_entropy is not None}
    lists = (
        ignore_patterns(files).where(F.col("ord.src") > 1).select("scan_id", "pattern")
        .unionByName(settings.select("scan_id", F.explode("ignore_paths").alias("pattern")))
    )
    paths = filter_ignored(files.select("scan_id", "file_path"), config)
    covered = ignored_paths(paths, lists).withColumnRenamed("file_path", "file")
    rows = scan_files(files, config.with_least_entropy(0.0), keep_clean=True)
    kept = rows.join(covered, ["scan_id", "file"], "left_anti").join(settings, "scan_id", "left")

    least = F.create_map(*[F.lit(x) for pair in own_least.items() for x in pair])
    wanted = F.coalesce("min_entropy", least[F.col("rule_id")])
    dropped = F.coalesce(F.array_contains("disabled_rules", F.col("rule_id")), F.lit(False)) | (
        least[F.col("rule_id")].isNotNull() & F.coalesce(F.col("entropy") < wanted, F.lit(False))
    )
    severity = F.coalesce(F.col("severity_overrides")[F.col("rule_id")], F.col("severity"))
    of_finding = [c for c in FINDING_COLUMNS if c not in ("scan_id", "file")]
    changed = kept.withColumn("severity", severity)
    checked = F.when(
        F.col("rule_id").isNotNull() & ~F.col("severity").isin(*SEVERITIES),
        F.raise_error(F.concat(F.lit("unknown severity: "), "severity")).cast("string"),
    )
    return changed.select(
        "scan_id", "file",
        *[
            F.when(~dropped, F.coalesce(checked, F.col(c)) if c == "severity" else F.col(c)).alias(c)
            for c in of_finding
        ],
        "first_row",
        F.coalesce("fail_threshold", F.lit(config.fail_threshold)).alias("fail_threshold"),
    )


def configured_result(rows: DataFrame) -> DataFrame:
    """One row per scan of ``scan_configured``, with the gate at each scan's own threshold."""
    threshold = F.coalesce(
        F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.first("fail_threshold")) - 1, F.lit(0)
    )
    return score_rows(rows, F.count_if("first_row"), threshold)
