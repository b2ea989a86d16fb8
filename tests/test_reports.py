import json
import math

import pytest
from pyspark.sql import functions as F

from palisade.operators.scan import describe, scan_files
from palisade.operators.score import scan_result
from palisade.plans import reports
from palisade.settings import PREFIX


@pytest.fixture(scope="module")
def scanned(spark):
    data = [
        ("s", "src\\a.ts", "eval(aiOutput);\nfetch(args.url);"),
        ("s", "src/b.ts", f"eval(msg); // {PREFIX}-ignore"),
        ("s", "src/c.ts", "openai.chat.completions.create({ m: 1 })"),
        ("clean", "x.ts", "ok"),
    ] + [("big", f"src/{i}.ts", "eval(aiOutput);") for i in range(60)]
    files = spark.createDataFrame(data, "scan_id string, file_path string, content string")
    rows = scan_files(files, keep_clean=True).cache()
    found = rows.where(F.col("rule_id").isNotNull()).drop("first_row")
    return scan_result(rows), describe(found).cache()


def joined(pieces):
    """Whole documents by scan: pieces in order, none missing."""
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.scan_id, r.piece)):
        texts.setdefault(r.scan_id, []).append(r)
    for own in texts.values():
        assert [r.piece for r in own] == list(range(own[0].n_pieces))
    return {scan: "\n".join(r.text for r in own) for scan, own in texts.items()}


def parsed(pieces):
    return {scan: json.loads(text) for scan, text in joined(pieces).items()}


def test_sarif(scanned):
    docs = parsed(reports.sarif_documents(*scanned))
    run = docs["s"]["runs"][0]
    assert docs["s"]["version"] == "2.1.0"
    empty = docs["clean"]["runs"][0]
    assert empty["results"] == [] and empty["tool"]["driver"]["rules"] == []
    results = [(r["ruleId"], r["level"]) for r in run["results"]]
    assert results == [("AIS-002", "error"), ("AIS-007", "error"), ("MCP-004", "error"),
                       ("AIS-004", "warning")]  # by uri, then rule
    place = run["results"][0]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "src/a.ts"
    assert place["region"] == {"startLine": 1, "startColumn": 1, "snippet": {"text": "eval(aiOutput);"}}
    rules = {r["id"]: r for r in run["tool"]["driver"]["rules"]}
    assert set(rules) == {"AIS-002", "AIS-004", "AIS-007", "MCP-004"}
    assert "external/cwe/cwe-95" in rules["AIS-002"]["properties"]["tags"]
    assert rules["AIS-002"]["defaultConfiguration"]["level"] == "error"


@pytest.mark.parametrize("size", [1, 20])
def test_one_form_at_every_size(scanned, size):
    """The same documents, whatever the number of findings to a piece."""
    results, found = scanned
    for build in (reports.sarif_documents, reports.json_documents, reports.markdown_documents):
        whole = joined(build(results, found))
        assert joined(build(results, found, size=size)) == whole
        pieces = build(results, found, size=size).collect()
        counts = {r.scan_id: r.n_pieces for r in pieces}
        assert counts == {"s": 2 + math.ceil(4 / size), "clean": 2, "big": 2 + math.ceil(60 / size)}


def test_a_file_with_very_many_findings(spark):
    """12,000 findings in one file of one scan: numbered and cut like any other, in order."""
    code = "eval(aiOutput);\n" * 12_000
    data = [("s", "src/b.ts", code), ("s", "src/a.ts", "eval(msg);"), ("s", "src/c.ts", "eval(msg);"), ("t", "x.ts", code[:160])]
    files = spark.createDataFrame(data, "scan_id string, file_path string, content string")
    rows = reports.in_order(scan_files(files, keep_clean=True))
    results, found = scan_result(rows), describe(rows.where(F.col("rule_id").isNotNull()).drop("first_row"))
    docs = parsed(reports.json_documents(results, found, size=500))
    want = [("src/a.ts", 1), *(("src/b.ts", n + 1) for n in range(12_000)), ("src/c.ts", 1)]
    assert [(f["file"], f["line"]) for f in docs["s"]["findings"]] == want
    assert [f["line"] for f in docs["t"]["findings"]] == list(range(1, 11))
    sizes = [r.text.count("\n") + 1 for r in reports.json_documents(results, found, size=500).where("scan_id = 's'").orderBy("piece").collect()]
    assert sizes == [1, *[500] * 24, 2, 1]
    text = joined(reports.markdown_documents(results, found, size=500))["s"]
    assert text.count("### `src/b.ts` (12000)") == 1 and text.count("\n| ") == 12_002 + 2 * 3
    sarif = parsed(reports.sarif_documents(results, found, size=999))["s"]["runs"][0]
    assert len(sarif["results"]) == 12_002 and len(sarif["tool"]["driver"]["rules"]) == 1


def test_documents_are_written_in_order(scanned, tmp_path):
    results, found = scanned
    pieces = reports.json_documents(results, found, size=3)
    reports.write_documents(pieces, str(tmp_path / "out"))
    for scan, text in joined(pieces).items():
        files = sorted((tmp_path / "out" / f"scan_id={scan}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == text + "\n"


def test_json(scanned):
    docs = parsed(reports.json_documents(*scanned))
    assert docs["clean"]["findings"] == [] and docs["clean"]["passed"] is True
    assert docs["s"]["summary"] == {"critical": 0, "high": 3, "medium": 1, "low": 0, "info": 0}
    assert docs["s"]["suppressedCount"] == 1 and docs["s"]["scannedFiles"] == 3
    assert docs["s"]["riskScore"] == 70


def test_markdown(spark, scanned):
    notes = spark.createDataFrame([("s", "look here")], "scan_id string, notes string")
    docs = joined(reports.markdown_documents(*scanned, notes=notes))
    assert reports.CLEAN_END in docs["clean"] and "✅ Safe" in docs["clean"]
    assert "Risk score 70 of 100, 🚨 High Risk" in docs["s"] and "look here" in docs["s"]
    assert "### `src\\a.ts` (3)" in docs["s"] and "### `src/c.ts` (1)" in docs["s"]


def test_comments_and_annotations(scanned):
    comments = reports.review_comments(scanned[1]).where("scan_id = 's'").collect()
    assert len(comments) == 4 and {c.path for c in comments} == {"src/a.ts", "src/c.ts"}
    assert all(c.side == "RIGHT" and c.line >= 1 for c in comments)
    assert all("high, ai-safety" in c.body or "high, mcp" in c.body or "medium, " in c.body for c in comments)
    levels = {r.title[1:8]: r.level for r in reports.annotations(scanned[1]).collect()}
    assert levels["AIS-004"] == "warning" and levels["AIS-002"] == "error"


def test_top_comments_keeps_ten(scanned):
    top = reports.top_comments(scanned[1].where("not suppressed"), ["file", "rule_ord"]).collect()
    counts = {}
    for r in top:
        counts[r.scan_id] = counts.get(r.scan_id, 0) + 1
    assert counts == {"big": 10, "s": 4}


def test_verdict_comments_skip_false_alarms(scanned):
    judged = scanned[1].where("scan_id = 's'").withColumn(
        "verdict",
        F.when(F.col("rule_id") == "AIS-002", "FALSE_POSITIVE").when(
            F.col("rule_id") == "AIS-007", "CONFIRMED_VULNERABILITY"),
    ).withColumn("reasoning", F.lit("because")).withColumn(
        "suggested_patch", F.when(F.col("rule_id") == "AIS-007", "safe(args.url);"))
    bodies = [r.body for r in reports.verdict_comments(judged).collect()]
    assert len(bodies) == 3 and not any("AIS-002" in b for b in bodies)
    patched = next(b for b in bodies if "AIS-007" in b)
    assert "because" in patched and "```suggestion\nsafe(args.url);\n```" in patched


def test_findings_table(scanned, tmp_path, spark):
    reports.write_findings(scanned[1], str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == scanned[1].count() and "category" in back.columns
