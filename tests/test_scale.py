"""Plan shapes that must hold at any size, and results that must not depend on layout."""

import re

import pytest
from pyspark.sql import functions as F

from palisade.operators import diff, score
from palisade.operators.scan import scan_files
from palisade.plans import reports
from palisade.plans.queries import QUERIES
from palisade.sources import derived

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("source").alias("scan_id"), derived.file_path(F.col("doc_id")).alias("file_path"),
        F.concat_ws("\n", derived.head(F.col("doc_id")), "text", derived.tail(F.col("doc_id")))
        .alias("content"),
    )


def test_file_scan_has_no_shuffle_and_one_source_read(files):
    text = plan(scan_files(files))
    assert "Exchange" not in text and "Join" not in text
    assert text.count("FileScan") == 1
    assert "n_chars" not in text.split("FileScan")[1].split("ReadSchema")[1]


def test_gate_is_evaluated_once(files):
    assert len(re.findall(r"ArrowEvalPython", plan(scan_files(files)))) == 1


def test_scan_result_shuffles_only_partial_counts(files):
    text = plan(score.scan_result(scan_files(files, keep_clean=True)))
    assert text.count("Exchange") == 1 and "partial_" in text
    shuffled = next(l for l in text.split("\n") if "HashAggregate" in l and "partial_" in l)
    assert "content" not in shuffled


def test_diff_scan_shuffles_findings_not_texts(spark):
    diffs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("scan_id"),
        derived.diff_text(F.col("doc_id"), F.col("text")).alias("diff_text"),
    )
    text = plan(diff.scan_diff(diffs))
    assert text.count("Exchange") == 1 and "Window" not in text
    raw = plan(diff.raw_diff_findings(diffs))
    assert "Exchange" not in raw


def test_diff_result_reads_the_diffs_once(spark):
    text = plan(QUERIES["scan_result_diff"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1


def test_comment_limit_is_applied_before_the_shuffle(files):
    found = scan_files(files).where(~F.col("suppressed"))
    text = plan(reports.top_comments(found, ["file", "rule_ord", "match_ord"]))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    if name in ("stream_scan_diffs", "history_blocks", "findings_table", "json_report", "sarif_report", "markdown_report"):
        pytest.skip("runs a job to build its plan")
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_results_do_not_depend_on_partitioning(files):
    def rows(n):
        return sorted(map(str, scan_files(files.repartition(n)).collect()))

    assert rows(1) == rows(7)


def test_one_scan_may_own_everything(spark, files):
    hot = files.withColumn("scan_id", F.lit("hot")).unionByName(files)
    result = score.scan_result(scan_files(hot, keep_clean=True))
    got = {r.scan_id: r.findings_count for r in result.collect()}
    assert got["hot"] == sum(n for k, n in got.items() if k != "hot")
