import json
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import configured, diff
from palisade.operators.scan import scan_files
from palisade.operators.score import scan_result
from palisade.plans import reports
from palisade.settings import CONFIG_FILES
from palisade.sources.corpus import (
    ignore_patterns, list_tree, read_history, read_patches, read_tree, with_unreadable,
)


def test_tree(spark, tmp_path):
    for name, body in {
        "src/a.ts": b"eval(aiOutput)", "node_modules/x.js": b"eval(aiOutput)", "b.png": b"x",
        "src/.hidden/c.ts": b"eval(msg)", "src/rules/d.ts": b"eval(msg)", "src/bad.ts": b"\xff\xfe eval(msg)",
    }.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    files = read_tree(spark, str(tmp_path), "repo")
    assert {r.file_path for r in files.collect()} == {"src/a.ts", "src/rules/d.ts", "src/bad.ts"}
    found = {r.file for r in scan_files(files).collect()}
    assert {"src/a.ts", "src/rules/d.ts"} <= found


def test_patches(spark, tmp_path):
    (tmp_path / "one.patch").write_text("diff --git a/x b/x\n+++ b/x\n@@ -1 +1 @@\n+y\n")
    row = read_patches(spark, str(tmp_path)).first()
    assert row.scan_id.endswith("one.patch") and row.diff_text.count("\n") == 4


def test_ignore_patterns(spark):
    files = spark.createDataFrame(
        [("s", "p/.gitignore", "# c\n a/ \n\nb"), ("s", "q/.gitignore", "b\ndist/**"), ("t", "x.ts", "z")],
        "scan_id string, file_path string, content string",
    )
    rows = ignore_patterns(files, ("cfg/",)).orderBy("scan_id", "ord").collect()
    defaults = ["dist/**", "build/**", "node_modules/**", "coverage/**", "cfg/"]
    assert [r.pattern for r in rows if r.scan_id == "s"] == [*defaults, "a/", "b"]
    assert [r.pattern for r in rows if r.scan_id == "t"] == defaults


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "rep o+%41"
    for name in ("src/a.ts", "node_modules/x.js", "b.png", "rep o+%41/c d.ts", "src/e+f%20.ts"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("eval(aiOutput)")
    return root


def test_pruned_files_are_never_opened(spark, tree):
    files = read_tree(spark, str(tree), "repo")
    want = {"src/a.ts", "rep o+%41/c d.ts", "src/e+f%20.ts"}
    assert {r.file_path for r in files.collect()} == want
    # the path test is a filter of the scan over file metadata, applied when files are listed
    scan = files._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "node_modules" in scan.dataFilters().toString()
    kept = [p for group in scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters()).mkString("|").split("|") for p in [group] if p]
    assert "node_modules" not in str(kept) and "b.png" not in str(kept) and "a.ts" in str(kept)
    listed = list_tree(spark, str(tree), "repo")
    assert {r.file_path for r in listed.collect()} == want
    assert "content" not in plan(listed).split("FileScan")[-1]


def test_unreadable_files_count_as_scanned(spark, tree):
    files = read_tree(spark, str(tree), "repo").where("file_path != 'src/a.ts'")  # as if it could not be read
    rows = with_unreadable(scan_files(files, keep_clean=True), list_tree(spark, str(tree), "repo"))
    total = scan_result(rows).first()
    assert (total.scanned_files, total.findings_count) == (3, 2)


def history(rng, n):
    parts = []
    for i in range(n):
        if rng.random() < 0.4:
            parts.append(f"commit {rng.randrange(16**10):040x}\n\n    message diff --git here\n\n")
        body = "".join(f"+line {j} diff --git x\n" for j in range(rng.randrange(6)))
        parts.append(f"diff --git a/f{i} b/f{i}\n--- a/f{i}\n+++ b/f{i}\n@@ -1 +1,9 @@\n{body}")
        if rng.random() < 0.1:
            parts.append("+eval(msg);\rdiff --git a/cr b/cr\n")
    return "".join(parts)


@pytest.mark.parametrize("opening", ["", "commit 0123456789abcdef\n\n", "\n", "text\n\n"])
def test_a_history_is_read_in_many_tasks(spark, tmp_path, opening):
    text = opening + history(random.Random(opening), 400)
    (tmp_path / "one.patch").write_text(text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        blocks = read_history(spark, str(tmp_path))
        tasks = spark.read.option("lineSep", "\ndiff --git ").text(str(tmp_path)).rdd.getNumPartitions()
        assert tasks > 1
        got = sorted((r.block_ord, r.block, r.commit) for r in blocks.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    whole = diff.diff_blocks(read_patches(spark, str(tmp_path))).orderBy("block_ord").collect()
    assert [(o, b) for o, b, _ in got] == [(r.block_ord, r.block) for r in whole]
    commit, said = None, {}
    for line_block in text.replace("\rdiff --git ", "\ndiff --git ").split("\ndiff --git "):
        said[line_block] = commit
        names = [l.split()[1] for l in line_block.split("\n") if l.startswith("commit ")]
        commit = names[-1] if names else commit
    assert [c for _, _, c in got if c] and {c for _, _, c in got} == {c for c in said.values()} | ({None} if got[0][0] == 0 else set())


def test_a_history_is_not_shuffled(spark, tmp_path):
    (tmp_path / "one.patch").write_text(history(random.Random(0), 20))
    lines = plan(read_history(spark, str(tmp_path))).split("\n")
    assert any("BroadcastExchange" in line for line in lines)
    shuffles = [line for line in lines if " Exchange " in line]
    assert all("scan_id" in line for line in shuffles) and not any("SortMergeJoin" in line for line in lines)


def test_blocks_of_a_history_are_scanned_like_diffs(spark, tmp_path):
    (tmp_path / "one.patch").write_text("diff --git a/x.ts b/x.ts\n+++ b/x.ts\n@@ -1 +5 @@\n+eval(msg);\n" * 2)
    found = diff.scan_blocks(read_history(spark, str(tmp_path))).collect()
    assert [(r.file, r.line, r.rule_id) for r in found] == [("x.ts", 5, "AIS-002")]


def test_configurations_per_scan(spark):
    rc, plain, last = CONFIG_FILES
    code = "eval(aiOutput);\nfetch(args.url);"
    rows = [
        ("off", rc, '{"disabledRules": ["AIS-002", 3]}'), ("off", "a.ts", code),
        ("broken", rc, "{"), ("broken", plain, '{"severityOverrides": {"AIS-002": "info"}, "failThreshold": "critical"}'),
        ("broken", last, '{"disabledRules": ["AIS-002"]}'), ("broken", "a.ts", code),
        ("odd", rc, "[]"), ("odd", plain, '{"disabledRules": ["AIS-002"]}'), ("odd", "a.ts", code),
        ("nested", f"sub/{rc}", '{"disabledRules": ["AIS-002"]}'), ("nested", "a.ts", code),
        ("paths", plain, json.dumps({"ignorePaths": ["gen/**"], "minEntropy": "x"})), ("paths", "gen/a.ts", code), ("paths", "b.ts", code),
        ("none", "a.ts", code), (None, "a.ts", code),
    ]
    files = spark.createDataFrame(rows, "scan_id string, file_path string, content string")
    settings = {r.scan_id: r for r in configured.scan_configs(files).collect()}
    assert set(settings) == {"off", "broken", "odd", "paths"}
    assert settings["off"].disabled_rules == ["AIS-002"] and settings["off"].fail_threshold is None
    assert settings["broken"].severity_overrides == {"AIS-002": "info"}
    assert settings["paths"].min_entropy is None and settings["paths"].ignore_paths == ["gen/**"]
    got = {r.scan_id: (r.high, r.info, r.scanned_files, r.passed) for r in configured.configured_result(configured.scan_configured(files)).collect()}
    assert got == {
        "off": (2, 0, 2, False), "broken": (2, 1, 4, True), "odd": (3, 0, 3, False), "nested": (3, 0, 2, False),
        "paths": (3, 0, 2, False), "none": (3, 0, 1, False), None: (3, 0, 1, False),
    }
    bad = files.union(spark.createDataFrame([("none", rc, '{"severityOverrides": {"AIS-002": "awful"}}')], files.schema))
    with pytest.raises(Exception, match="unknown severity: awful"):
        configured.configured_result(configured.scan_configured(bad)).collect()


def test_configured_scan_moves_no_text(spark):
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("source").alias("scan_id"), F.concat(F.lit("a"), "doc_id", F.lit(".ts")).alias("file_path"), F.col("text").alias("content"),
    )
    text = plan(configured.scan_configured(files))
    assert "NestedLoop" not in text and "Cartesian" not in text
    for line in text.split("\n"):
        assert "Exchange" not in line or "content" not in line


def test_stored_findings_are_replaced_and_read_by_category(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = [("s", "secret", 1), ("s", "mcp", 2), ("t", "mcp", 3)]
    found = spark.createDataFrame(rows, "scan_id string, category string, line int")
    reports.write_findings(found, path)
    reports.write_findings(found.where("line = 3"), path)
    table = reports.read_findings(spark, path, "secret", "mcp")
    assert sorted(r.line for r in table.collect()) == [1, 3]
    assert sorted(r.line for r in reports.read_findings(spark, path).collect()) == [1, 3]
    assert "PartitionFilters: [" in plan(table) and "category" in plan(table).split("PartitionFilters: [")[1].split("]")[0]
