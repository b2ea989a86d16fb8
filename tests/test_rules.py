"""The labelled set and per-rule cases, each found or not found in one scan."""

import pytest

from palisade.catalogue import RULES, SECRET, FunctionRule, Pattern, Rule, active_rules
from palisade.operators import evaluate
from palisade.operators.scan import (
    describe, scan_files, scan_with_columns, scan_with_ignore_files,
)
from palisade.operators.score import scan_result
from palisade.settings import PREFIX, ScanConfig
from palisade.sources.labelled import CASES, labelled_cases
from palisade.sources.planted import AWS, HUGGING_FACE

GH = "gh" + "p_123456789012345678901234567890123456"
PC = "pcsk_" + "9876543210abcdef9876543210abcdef98765432"

# (path, text, {rule: number of findings})
TEXTS = [
    ("src/chat.ts", "x\n  { role: 'system', content: `Do ${req.body.userInput}` }\n",
     {"AIS-001": 1}),
    ("src/inverted.ts", "[{ content: `With: ${req.body.userInput}`, role: 'system' }]",
     {"AIS-001": 1}),
    ("src/dev.ts",
     "a = { role: 'developer', content: `G: ${req.body.userInput}` };\n"
     "b = [ 'system', `I: ${req.query.prompt}` ];\nc = [ 'developer', `D: ${req.body.input}` ];",
     {"AIS-001": 3}),
    ("src/benign.ts", "{ role: 'system', content: `ID: ${user_id}, ${status}` }\n"
     "{ role: 'system', content: `Hi ${username}` }", {}),
    ("src/roles.ts", "[{ role: 'system', content: 'Static.' },\n"
     "{ role: 'user', content: `q: ${req.body.userInput}` }]", {}),
    ("agent/tuple.py", '[("system", f"A: {user_query}"),\n ("developer", f"B: {raw_input}")]',
     {"AIS-001": 2}),
    ("agent/triple.py", 'system_prompt = f"""\nRun: {raw_user_prompt}\n"""', {"AIS-001": 1}),
    ("agent/safe.py", '[{"role": "system", "content": "Hi."},\n'
     '{"role": "user", "content": f"q {user_query}"}]', {}),
    ("src/exec.ts", "eval(aiOutput);", {"AIS-002": 1}),
    ("tools/bash_tool.py", 'subprocess.run(f"ls {tool_args.path}", shell=True)', {"AIS-003": 1}),
    ("tools/safe.py", 'subprocess.run(["ls", path], shell=False)', {}),
    ("src/git.ts", "exec(`git checkout ${toolArgs.branch}`);", {"AIS-003": 1, "MCP-002": 1}),
    ("src/spread.ts", "client.chat.completions.create({\n ...defaults, messages: [] })", {}),
    ("src/var.ts", "client.chat.completions.create(options)", {}),
    ("src/unbounded.ts", "openai.chat.completions.create({ messages: [f(')')] })",
     {"AIS-004": 1}),
    ("agent/state.py", "pickle.loads(session_memory)", {"AIS-005": 1}),
    ("src/vector.ts", f'new Pinecone({{\n  apiKey: "{PC}"\n}});', {"AIS-006": 1}),
    ("src/tools/fetch.ts", "const r = await fetch(toolArgs.url);",
     {"AIS-007": 1, "MCP-004": 1}),
    ("claude_desktop_config.json", '{"allowedDirectories": ["/"]}', {"MCP-001": 1}),
    ("sub/claude_desktop_config.json", '{"allowedDirectories": ["./workspace"]}', {}),
    ("mcp_list.yaml", "allowedDirectories:\n" + "  - /home\n" * 3000, {"MCP-001": 1}),
    ("mcp_config.json", f'{{\n"env": {{\n  "GITHUB_TOKEN": "{GH}"\n}}}}',
     {"MCP-003": 1, "SEC-004": 1}),
    ("agent_config.json", '{"env": {"API_KEY": "process.env.GITHUB_ACCESS_NAME"}}', {}),
    ("src/mcp/server.ts", 'server.tool("a", {\n inputSchema: {\n  type: "object"\n }\n});',
     {"MCP-005": 1}),
    ("src/mcp/admin_tool.ts", 'server.tool("p", (args) => { fs.rmSync(args.dir); });',
     {"MCP-006": 1}),
    ("src/mcp/no_context_tool.ts", "fs.rmSync(args.dir);", {}),
    ("README.md", "We used eval(aiOutput) and fetch(args.url).", {}),
    ("src/fixtures.ts", "eval(aiOutput); const t = { shell: true };", {}),
    ("infra/a.py", f'ID = "{AWS}"', {"SEC-005": 1}),
    ("ml/hub.py", f"t = '{HUGGING_FACE}'", {"SEC-008": 1}),
    ("src/rules/own.ts", "eval(aiOutput)", {"AIS-002": 1}),
    ("empty.ts", "", {}),
]


@pytest.fixture(scope="module")
def found(files_of):
    rows = scan_files(files_of([(p, t) for p, t, _ in TEXTS] + [("null.ts", None)])).collect()
    return {p: [r for r in rows if r.file == p] for p, _, _ in TEXTS} | {"null.ts": []}


@pytest.mark.parametrize("path,text,expected", TEXTS, ids=[t[0] for t in TEXTS])
def test_findings(found, path, text, expected):
    counts = {}
    for row in found[path]:
        counts[row.rule_id] = counts.get(row.rule_id, 0) + 1
    assert counts == expected


def test_details(found):
    (finding,) = [r for r in found["mcp_config.json"] if r.rule_id == "MCP-003"]
    assert (finding.line, finding.column) == (3, 20)
    assert "ghp_...3456" in finding.snippet and GH not in finding.snippet
    (secret,) = [r for r in found["mcp_config.json"] if r.rule_id == "SEC-004"]
    assert secret.entropy == pytest.approx(3.308, abs=1e-3) and secret.severity == "critical"
    (vector,) = found["src/vector.ts"]
    assert vector.line == 2 and "pcsk...5432" in vector.snippet


def test_labelled_set(spark):
    detected = evaluate.detections(labelled_cases(spark)).cache()
    total = evaluate.confusion(detected).first()
    assert (total.tp, total.tn, total.fp, total.fn) == (28, 15, 0, 0)
    positives = [r for r in detected.collect() if r.expected_vulnerability]
    assert all(r.expected_rule_found for r in positives)
    by_tier = {r.tier[:6]: (r.tp, r.tn, r.total, r.passed) for r in evaluate.tiers(detected).collect()}
    assert by_tier == {
        "Tier 1": (11, 0, 11, True), "Tier 2": (10, 0, 10, True),
        "Tier 3": (7, 0, 7, True), "Tier 4": (0, 15, 15, True),
    }
    metrics = evaluate.metrics(detected).first()
    assert (metrics.precision, metrics.recall, metrics.f1, metrics.passed) == (100, 100, 100, True)


def test_metrics_with_errors(spark):
    rows = [("secret", True, True)] * 2 + [("mcp", True, False)] + [("secret", False, True)] * 3
    detected = spark.createDataFrame(
        rows, "category string, expected_vulnerability boolean, detected boolean"
    )
    m = evaluate.metrics(detected).first()
    assert (m.precision, m.recall, m.f1, m.passed) == (40.0, 66.7, 50.0, False)
    empty = evaluate.metrics(detected.limit(0)).first()
    assert (empty.precision, empty.recall) == (100.0, 100.0)


def test_catalogue():
    assert len(RULES) == 25 and len({r.rule_id for r in RULES}) == 25
    assert len(CASES) == 43
    kept = active_rules(disabled=("AIS-002",), severities={"SEC-005": "critical"}, min_entropy=4.5)
    by_id = {r.rule_id: r for r in kept}
    assert "AIS-002" not in by_id and by_id["SEC-005"].severity == "critical"
    assert by_id["SEC-001"].min_entropy == 4.5 and by_id["SEC-006"].min_entropy is None


def test_config_reaches_the_scan(files_of):
    files = files_of([("a.ts", "eval(aiOutput); fetch(args.url)"), ("b.py", f'ID = "{AWS}"')])
    config = ScanConfig(disabled_rules=("AIS-002",), severity_overrides={"SEC-005": "low"})
    got = {(r.rule_id, r.severity) for r in scan_files(files, config).collect()}
    assert got == {("AIS-007", "high"), ("MCP-004", "high"), ("SEC-005", "low")}
    strict = scan_files(files, ScanConfig(min_entropy=5.0)).collect()
    assert "SEC-005" not in {r.rule_id for r in strict}


def test_custom_rules(files_of):
    custom = Rule(
        "X-1", "word", "a word", "info", "code-quality",
        (Pattern(r"tok=(\w+)", groups=(1,)),), kind=SECRET, min_entropy=2.0, redact=True,
    )
    lookahead = Rule("X-2", "n", "d", "low", "code-quality", (Pattern(r"foo(?=bar)"),))
    files = files_of([("a.txt", "tok=abcdefghijkl foobar foo\nfoobar"), ("b.txt", "tok=aaaaaaaaaaaa")])
    rows = scan_files(files, ScanConfig(custom_rules=(custom, lookahead))).collect()
    got = sorted((r.file, r.rule_id, r.line, r.column) for r in rows)
    assert got == [("a.txt", "X-1", 1, 1), ("a.txt", "X-2", 1, 18), ("a.txt", "X-2", 2, 1)]
    assert describe(scan_files(files, ScanConfig(custom_rules=(custom,))),
                    ScanConfig(custom_rules=(custom,))).first().title == "word"


def test_column_rules(files_of):
    from pyspark.sql import functions as F

    from palisade.functions.positions import match_positions

    files = files_of([("a.txt", "x\n foo foo"), ("b.txt", None)])
    by_column = scan_with_columns(
        files, "C-1", "low", "code-quality", lambda c, p: match_positions(c, F.lit("foo"))
    )

    rows = by_column.orderBy("match_ord").collect()
    assert [(r.line, r.column, r.snippet) for r in rows] == [(2, 2, "foo foo"), (2, 6, "foo foo")]


def function_rule(rule_id, **extra):
    def foo_lines(text, path):  # local, so that it travels to the workers by value
        return [(n + 1, 1, line.strip()) for n, line in enumerate(text.split("\n")) if "foo" in line]

    return FunctionRule(rule_id, "foo", "a foo", "low", "code-quality", foo_lines, **extra)


def test_function_rules_are_rules_like_others(files_of):
    files = files_of([
        ("a.ts", f"eval(msg);\n foo foo\nfoo // {PREFIX}-ignore F-1\nfoo // {PREFIX}-ignore F-2"), ("b.txt", None),
        ("dist/c.ts", "foo"), ("d.py", "foo"), ("e.txt", "none"),
    ])
    config = ScanConfig(
        function_rules=(function_rule("F-1", path_pattern=r"\.ts\z"), function_rule("F-2")),
        disabled_rules=("F-2", "AIS-003"), severity_overrides={"F-1": "high"},
    )
    rows = scan_files(files, config)
    got = sorted((r.file, r.rule_id, r.line, r.severity, r.suppressed) for r in rows.collect())
    assert got == [
        ("a.ts", "AIS-002", 1, "high", False), ("a.ts", "F-1", 2, "high", False),
        ("a.ts", "F-1", 3, "high", True), ("a.ts", "F-1", 4, "high", False),
    ]
    assert len({(r.file, r.rule_ord) for r in rows.collect()}) == 2
    assert {r.title for r in describe(rows, config).collect()} >= {"foo"}


def test_function_rules_alone_and_clean_files(files_of):
    files = files_of([("a.ts", "foo\nfoo"), ("b.ts", "x")])
    config = ScanConfig(builtin_rules=(), function_rules=(function_rule("F-1"),))
    totals = {r.scan_id: r for r in scan_result(scan_files(files, config, keep_clean=True)).collect()}
    assert totals["a.ts"].low == 2 and totals["b.ts"].low == 0
    assert [t.scanned_files for t in totals.values()] == [1, 1]
    with pytest.raises(ValueError, match="no active rules"):
        scan_files(files, ScanConfig(builtin_rules=()))


def test_groups_beside_lookarounds(files_of):
    rules = tuple(
        Rule(f"X-{i}", "n", "d", "low", "secret", (Pattern(text, groups=(1,)),), kind=SECRET, redact=True)
        for i, text in enumerate([r"key=([A-Za-z0-9]{20,})(?=;)", r"(?<=key=)([A-Za-z0-9]{20,})", r"key(?==(\w{20,}))"])
    )
    token = "a1B2c3D4e5F6g7H8i9J0"
    files = files_of([("a.txt", f"key={token};\nkey={token},")])
    rows = scan_files(files, ScanConfig(builtin_rules=(), custom_rules=rules)).collect()
    got = sorted((r.rule_id, r.line, r.column, r.snippet) for r in rows)
    assert got == [
        ("X-0", 1, 1, "key=a1B2...i9J0;"), ("X-1", 1, 5, "key=a1B2...i9J0;"), ("X-1", 2, 5, "key=a1B2...i9J0,"),
        ("X-2", 1, 1, "key=a1B2...i9J0;"), ("X-2", 2, 1, "key=a1B2...i9J0,"),
    ]


def test_ignore_files_hold_for_their_own_scan(spark):
    rows = [
        ("s", ".gitignore", "# no\ngen/\n*.snap\n"), ("s", "gen/a.ts", "eval(msg)"), ("s", "src/gen/a.ts", "eval(msg)"),
        ("s", "b.snap", "key"), ("s", "src/b.ts", "eval(msg)"), ("t", "gen/a.ts", "eval(msg)"), ("t", "dist/x.ts", "eval(msg)"),
    ]
    files = spark.createDataFrame(rows, "scan_id string, file_path string, content string")
    found = scan_with_ignore_files(files, keep_clean=True)
    got = sorted((r.scan_id, r.file, r.rule_id) for r in found.collect() if r.rule_id)
    assert got == [("s", "src/b.ts", "AIS-002"), ("t", "gen/a.ts", "AIS-002")]
    counts = {r.scan_id: r.scanned_files for r in scan_result(found).collect()}
    assert counts == {"s": 2, "t": 1}
