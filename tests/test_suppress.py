import re

import pytest

from palisade.operators.scan import scan_files
from palisade.operators.score import scan_result
from palisade.operators.suppress import suppressions
from palisade.settings import PREFIX, ScanConfig

P = PREFIX


def brute(text):
    """Line -> suppressed ids, as the directives are defined."""
    out, inside, block = {}, False, set()
    for n, line in enumerate(re.split(r"\r?\n", text), 1):
        m = re.search(rf"/\*\s*{P}-disable(?:\s+([\w-]+))?\s*\*/", line)
        if m:
            inside, block = True, {m[1] or "*"}
        if f"/* {P}-enable */" in line:
            inside, block = False, set()
        if inside:
            out[n] = set(block)
        m = re.search(rf"(?://|/\*)\s*{P}-ignore(?::|\s+)?([\w-]+)?", line)
        if m:
            out.setdefault(n, set()).add(m[1] or "*")
        m = re.search(rf"(?://|/\*)\s*{P}-disable-next-line(?::|\s+)?([\w-]+)?", line)
        if m:
            out.setdefault(n + 1, set()).add(m[1] or "*")
    return {(n, r) for n, rules in out.items() for r in rules}


TEXTS = {
    "a": f"// {P}-disable-next-line AIS-002\neval(aiOutput);",
    "b": f"eval(aiOutput); // {P}-ignore: AIS-002\n// {P}-ignore:AIS-003\n// {P}-ignore AIS-004",
    "c": f"/* {P}-disable */\neval(aiOutput);\n/* {P}-enable */\neval(aiOutput);",
    "d": f"/* {P}-disable AIS-001 */\nx\n/* {P}-disable AIS-002 */\neval(msg)",
    "e": f"// {P}-disable-next-line X\n/* {P}-disable Y */ z // {P}-ignore Z\nq",
    "f": f"/* {P}-disable */ a /* {P}-enable */\n# {P}-ignore\n/*{P}-enable*/",
    "g": f"/* {P}-disable A */\r\n// {P}-disable-next-line B\r\n/* {P}-enable */ c\r\nd",
    "h": f"// {P}-disable-next-line",
    "i": "nothing here",
}


def test_rows_match_brute_force(files_of):
    rows = suppressions(files_of([(k + ".ts", v) for k, v in TEXTS.items()]), P).collect()
    for key, text in TEXTS.items():
        got = {(r.line, r.rule_id) for r in rows if r.file == key + ".ts"}
        assert got == brute(text), key


def test_flags_match_brute_force(files_of):
    texts = {k: re.sub(r"\bz\b|\bq\b|\bd\b", "eval(msg)", v) for k, v in TEXTS.items()}
    rows = scan_files(files_of([(k + ".ts", v) for k, v in texts.items()])).collect()
    assert rows
    for r in rows:
        known = brute(texts[r.file[:-3]])
        want = (r.line, "*") in known or (r.line, r.rule_id) in known
        assert r.suppressed == want, (r.file, r.line)


@pytest.mark.parametrize("key", ["a", "b"])
def test_suppressed_findings_pass(files_of, key):
    rows = scan_files(files_of([("x.ts", TEXTS[key])]), keep_clean=True)
    result = scan_result(rows).first()
    assert (result.passed, result.risk_score, result.suppressed_count, result.findings_count) == (
        True, 0, 1, 0,
    )


def test_strict_ids(files_of):
    text = f"eval(aiOutput); // {P}-ignore: AIS-003"
    files = files_of([("x.ts", text)])
    assert scan_files(files).first().suppressed
    assert not scan_files(files, ScanConfig(strict_ids=True)).first().suppressed
