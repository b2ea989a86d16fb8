import pytest

from palisade.operators import score, verdicts
from palisade.operators.scan import scan_files

ROWS_DDL = "scan_id string, rule_id string, severity string, suppressed boolean, first_row boolean"


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("a", "S", "critical", False, True), ("a", "S", "high", False, False),
        ("a", "S", "high", True, True), ("b", "S", "medium", False, True),
        ("b", "S", "low", False, False), ("b", "S", "info", False, False),
        ("clean", None, None, None, True), ("clean", None, None, None, True),
        ("worst", "S", "critical", False, True), ("worst", "S", "critical", False, True),
        ("worst", "S", "critical", False, True),
    ]
    return spark.createDataFrame(data, ROWS_DDL)


def test_scan_result(rows):
    got = {r.scan_id: r for r in score.scan_result(rows).collect()}
    assert (got["a"].risk_score, got["a"].passed, got["a"].suppressed_count) == (60, False, 1)
    assert (got["a"].scanned_files, got["a"].findings_count) == (2, 2)
    assert (got["b"].risk_score, got["b"].passed) == (16, True)
    assert (got["clean"].risk_score, got["clean"].passed, got["clean"].scanned_files) == (0, True, 2)
    assert got["worst"].risk_score == 100


@pytest.mark.parametrize("threshold,passing", [
    ("info", {"clean"}), ("low", {"clean"}), ("medium", {"clean"}), ("high", {"clean", "b"}),
    ("critical", {"clean", "b"}),
])
def test_thresholds(rows, threshold, passing):
    got = score.scan_result(rows, threshold).where("passed").collect()
    assert {r.scan_id for r in got} == passing
    with pytest.raises(ValueError):
        score.scan_result(rows, "severe")


def test_two_findings_fail(files_of):
    key = "sk-" + "proj-12345678901234567890123456789012"
    text = f'\n  const k = "{key}";\n  eval(aiOutput);\n'
    result = score.scan_result(scan_files(files_of([("src/app.ts", text)]), keep_clean=True)).first()
    assert (result.critical, result.high, result.risk_score, result.passed) == (1, 1, 60, False)


def test_risk_bands(spark):
    frame = spark.createDataFrame([(s,) for s in (0, 20, 21, 50, 51, 100)], "s int")
    got = [r[0] for r in frame.select(score.risk_band(frame.s)).collect()]
    assert got == ["safe", "safe", "moderate", "moderate", "high", "high"]


REVIEW = ('{"summary":"s","findingsAnalysis":[{"ruleId":"R","line":3,"verdict":"%s","confidence":'
          '0.9,"reasoning":"r","suggestedPatch":"p"},{"ruleId":"R","line":3,"verdict":'
          '"NEEDS_INVESTIGATION","confidence":0.1,"reasoning":"q","suggestedPatch":""}],'
          '"architecturalRecommendations":["x"]}')


@pytest.fixture(scope="module")
def reviews(spark):
    data = [
        ("confirmed", REVIEW % "CONFIRMED_VULNERABILITY"), ("open", REVIEW % "FALSE_POSITIVE"),
        ("none", '{"summary":""}'), ("broken", '{"summary": "x'), ("empty", ""), ("null", None),
        ("cleared", '{"findingsAnalysis":[{"ruleId":"R","line":1,"verdict":"FALSE_POSITIVE"}]}'),
    ]
    return verdicts.parse_verdicts(spark.createDataFrame(data, "scan_id string, response_json string"))


def test_parse_verdicts(reviews):
    got = {r.scan_id: r for r in reviews.collect()}
    assert set(got) == {"confirmed", "open", "none", "broken", "cleared"}
    assert got["none"].summary == verdicts.DEFAULT_SUMMARY and got["none"].analysis == []
    assert got["broken"].summary == verdicts.FAILED_SUMMARY
    assert got["broken"].recommendations == [verdicts.FAILED_ADVICE]
    assert got["confirmed"].analysis[0].confidence == 0.9


def test_first_verdict_wins(spark, reviews):
    found = spark.createDataFrame([("open", "R", 3, "f"), ("open", "R", 4, "f")],
                                  "scan_id string, rule_id string, line int, file string")
    rows = verdicts.join_verdicts(found, verdicts.verdict_rows(reviews)).collect()
    assert {r.line: r.verdict for r in rows} == {3: "FALSE_POSITIVE", 4: None}


@pytest.mark.parametrize("missing,expected", [("pass", True), ("fail", False)])
def test_review_gate(spark, reviews, missing, expected):
    scans = ["confirmed", "open", "none", "broken", "cleared", "unreviewed"]
    results = spark.createDataFrame([(s, p) for s in scans for p in (False,)],
                                    "scan_id string, passed boolean")
    got = {r.scan_id: r.passed for r in verdicts.review_gate(reviews, results, missing).collect()}
    assert got == {"confirmed": False, "open": False, "none": expected, "broken": expected,
                   "cleared": True, "unreviewed": False}
    with pytest.raises(ValueError):
        verdicts.review_gate(reviews, results, "other")
