"""DuckDB SQL giving the expected result of each registered query.

Written independently of the Spark expressions: positions come from running sums over
unnested pieces, diffs from windows over exploded lines, suppressions from
``last_value``, argument lists from a recursive walk. Only the fixed values (patterns,
word lists, planted texts) are shared.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from palisade.catalogue import (
    CALL, ENV, PINECONE_TOKEN_PREFIX, PROMPT, RULES, SECRET, SEVERITIES, SPREAD_OR_VARIABLE,
    TOKEN_LIMIT, VECTOR, Pattern, Rule,
)
from palisade.functions.entropy import DEFAULT_THRESHOLD, TOKEN_PREFIXES
from palisade.functions.paths import CI_DIRS, CLI_DIRS, CLI_EXTENSIONS, clean_patterns
from palisade.functions.prompts import (
    INPUT_WORDS, JS_PLACEHOLDER, PY_PLACEHOLDER, REQUEST_ACCESS, SAFE_EXPRESSION,
)
from palisade.functions.text import SPACE_CHARS, re2_regex
from palisade.operators.diff import LEAST_PARTIAL, OMITTED, TRUNCATED
from palisade.operators.evaluate import (
    ALL_TIERS, NEGATIVE_TIER, OTHER_TIER, PASSING_F1, TIERS,
)
from palisade.operators.score import HIGH_RISK, MAX_SCORE, MODERATE_RISK, WEIGHTS
from palisade.operators.suppress import directive_patterns
from palisade.operators.verdicts import (
    CONFIRMED, DEFAULT_SUMMARY, FAILED_ADVICE, FAILED_SUMMARY, FALSE_POSITIVE,
)
from palisade.plans import queries as registered
from palisade.plans.reports import (
    ADVICE_TITLE, BADGES, BANDS, CLEAN_END, COMMENT_END, COMMENT_FIX, COMMENT_PATCH,
    COMMENT_REASON, COMMENT_TITLE, COUNTS_TEXT, FILE_HEAD, FILES_TEXT, FINDINGS_TITLE, FOUND_END,
    GATE_TEXT, INFORMATION_URI, LEVELS, MAX_COMMENTS, NO_FIX, NOTES_TITLE, OTHER_VERDICT_BADGE,
    PATCHES_TITLE, REPORT_TITLE, REVIEW_TITLE, SARIF_ROOT, SARIF_SCHEMA, SARIF_VERSION, SCORE_TEXT,
    TABLE_HEAD, TOOL, VERDICT_BADGES, VERDICTS_HEAD, VERDICTS_TITLE, VERSION,
)
from palisade.settings import DEFAULT_IGNORES, IGNORE_FILES, PREFIX, TEST_WORDS
from palisade.sources.labelled import CASES
from palisade.sources.planted import CONFIGS, FOLDERS, PLANTED


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


NL = "chr(10)"
SPACES = q(SPACE_CHARS)


def values(name: str, columns: str, rows: Iterable[tuple]) -> str:
    def cell(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, int) else q(v)

    body = ",\n".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def with_(ctes: Sequence[str], select: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


# --- base views ---------------------------------------------------------------

FILES = [
    values("planted", "k, path, head, tail",
           [(i, p.path, p.head, p.tail) for i, p in enumerate(PLANTED)]),
    values("folders", "j, folder", list(enumerate(FOLDERS))),
    f"""files AS MATERIALIZED (
      SELECT doc_id, text, source, head, tail, source AS scan_id,
             folder || 'd' || doc_id || '/' || path AS file_path,
             head || {NL} || text || {NL} || tail AS content
      FROM documents JOIN planted ON doc_id % {len(PLANTED)} = k
      JOIN folders ON (doc_id // {len(PLANTED)}) % {len(FOLDERS)} = j)""",
]

CHAT_FILES = """chat_files AS (
  SELECT 'conversations' AS scan_id, 'chat/c' || conv_id || '_' || turn || '.py' AS file_path,
         'm = {"role": "' || role || '", "content": f\"\"\"' || text
         || CASE WHEN turn % 2 = 0 THEN ' {user_input}' ELSE ' {user_id}' END
         || '\"\"\"}' AS content
  FROM conversations)"""

PAGE_FILES = """page_files AS (
  SELECT 'pages' AS scan_id, 'site/p' || page_id || '.html' AS file_path, html AS content
  FROM pages)"""

CASE_VIEW = [
    values("labelled", "k, cid, category, rid, path, body",
           [(i, c.case_id, c.category, c.rule_id, c.file_path, c.code)
            for i, c in enumerate(CASES)]),
    f"""cases AS MATERIALIZED (
      SELECT cid || '-' || doc_id AS id, category, rid IS NOT NULL AS expected_vulnerability,
             rid::VARCHAR AS expected_rule_id, path AS file_path, body || {NL} || text AS code
      FROM documents JOIN labelled ON doc_id % {len(CASES)} = k)""",
]


def ignored(path: str, patterns: Iterable[str]) -> str:
    tests = ["FALSE"]
    norm = f"regexp_replace(replace({path}, '\\', '/'), '^\\./', '')"
    for pattern in clean_patterns(patterns):
        if pattern.startswith("*."):
            tests.append(f"ends_with({norm}, {q(pattern[1:])})")
        folder = pattern.removesuffix("/**").removesuffix("/")
        tests += [
            f"{norm} = {q(folder)}", f"starts_with({norm}, {q(folder + '/')})",
            f"contains({norm}, {q('/' + folder + '/')})", f"ends_with({norm}, {q('/' + folder)})",
        ]
    return "(" + " OR ".join(tests) + ")"


def texts_from(source: str, patterns: Iterable[str] = DEFAULT_IGNORES) -> str:
    return (
        f"texts AS MATERIALIZED (SELECT scan_id || '|' || file_path AS tid, scan_id, "
        f"file_path AS file, content FROM {source} WHERE NOT {ignored('file_path', patterns)})"
    )


# --- detection ----------------------------------------------------------------


def cleaned(token: str) -> str:
    for prefix in TOKEN_PREFIXES:
        token = f"regexp_replace({token}, {q('(?i)' + prefix)}, '')"
    return token


def entropy(text: str) -> str:
    chars = f"string_split({text}, '')"
    share = f"(len(list_filter({chars}, lambda x: x = c)) / length({text}))"
    return (
        f"CASE WHEN {text} = '' THEN 0.0 ELSE coalesce(list_sum(list_transform("
        f"list_distinct({chars}), lambda c: -{share} * log2({share}))), 0.0) END"
    )


def high_entropy(token: str, limit: float) -> str:
    return (
        f"(length({token}) >= 12 AND length({cleaned(token)}) >= 8 "
        f"AND {entropy(cleaned(token))} >= {limit})"
    )


def untrusted(expr: str) -> str:
    return (
        f"(NOT regexp_matches(trim({expr}, {SPACES}), {q(re2_regex(SAFE_EXPRESSION))}) AND "
        f"regexp_matches({expr}, {q(re2_regex(f'(?:{REQUEST_ACCESS}|{INPUT_WORDS})'))}))"
    )


# the alternatives of the Python prompt pattern, one by one: DuckDB's regexp_extract
# reaches nine groups only
_FSTRING = r"""(?:f\"\"\"([\s\S]*?)\"\"\"|f'''([\s\S]*?)'''|f['"]([^'"]*)['"])"""
_ROLE = r"""['"]role['"]\s*:\s*['"](?:system|developer)['"]"""
_CONTENT = r"""['"]content['"]\s*:\s*""" + _FSTRING
_PY_SHAPES = (
    _ROLE + r"[^{}]*?" + _CONTENT,
    _CONTENT + r"[^{}]*?" + _ROLE,
    r"""\(\s*['"](?:system|developer)['"]\s*,\s*""" + _FSTRING + r"\s*\)",
    r"(?:system_prompt|systemPrompt|developer_prompt|developerPrompt)\s*=\s*" + _FSTRING,
    r"(?:SystemMessage|DeveloperMessage)\s*\(\s*(?:content\s*=\s*)?" + _FSTRING,
)


def token_of(pattern, text: str) -> str:
    if "$2$5" in pattern.mark:  # the located part of the environment pattern
        return " || ".join(f"coalesce(regexp_extract({text}, {q(pattern.re2)}, {g}), '')"
                           for g in (2, 5))
    if not pattern.groups:
        return text
    if len(pattern.groups) > 9:
        shapes = [re2_regex(r"\A(?:" + s + r")\z") for s in _PY_SHAPES]
        parts = [f"coalesce(regexp_extract({text}, {q(s)}, {g}), '')"
                 for s in shapes for g in (1, 2, 3)]
    else:
        parts = [f"coalesce(regexp_extract({text}, {q(pattern.re2)}, {g}), '')"
                 for g in pattern.groups]
    return " || ".join(parts)


def path_test(rule: Rule) -> str:
    tests = ["TRUE"]
    if rule.path_pattern:
        tests.append(f"regexp_matches(file, {q(re2_regex(rule.path_pattern))})")
    tests += [f"NOT ends_with(replace(file, '\\', '/'), {q(s)})" for s in rule.skip_suffixes]
    if rule.context:
        tests.append(f"regexp_matches(content, {q(rule.context.re2)})")
    return " AND ".join(tests)


def raw_hits(rules: Sequence[Rule]) -> str:
    selects = []
    for ro, rule in enumerate(rules):
        variants = [("NOT regexp_matches(file, '(?i)\\.py\\z')", rule.patterns)]
        if rule.python_patterns:
            variants.append(("regexp_matches(file, '(?i)\\.py\\z')", rule.python_patterns))
        else:
            variants = [("TRUE", rule.patterns)]
        for language, patterns in variants:
            for xo, pattern in enumerate(patterns):
                regex = q(pattern.re2)
                at_token = (
                    "length(m) - length(token) - CASE WHEN right(m, 1) IN ('\"', '''') "
                    "THEN 1 ELSE 0 END" if rule.kind == ENV else "0"
                )
                selects.append(f"""
      SELECT *, off0 + {at_token} AS off FROM (
        SELECT tid, {ro} AS ro, {xo} AS xo, k, m, {token_of(pattern, 'm')} AS token,
          sum(length(s)) OVER (PARTITION BY tid ORDER BY k)
          + coalesce(sum(length(m)) OVER (PARTITION BY tid ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0
        FROM (SELECT tid, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS k,
                     unnest(ss[1:len(ms)]) AS s
              FROM (SELECT tid, regexp_extract_all(content, {regex}) AS ms,
                           string_split_regex(content, {regex}) AS ss
                    FROM texts WHERE {path_test(rule)} AND {language}
                      AND regexp_matches(content, {regex}))))""")
    return "raw_hits AS MATERIALIZED (" + "\nUNION ALL".join(selects) + ")"


# walks each call's characters until its parenthesis closes
CALLS = """walk AS (
  SELECT tid, ro, xo, k, rest, 0 AS i, 1 AS depth, '' AS quote, '(' AS prev
  FROM (SELECT h.*, substr(content, CAST(off + length(m) + 1 AS BIGINT)) AS rest
        FROM raw_hits h JOIN texts USING (tid) WHERE ro IN ({rules}))
  UNION ALL
  SELECT tid, ro, xo, k, rest, i + 1,
    CASE WHEN quote <> '' THEN depth WHEN ch = '(' THEN depth + 1 WHEN ch = ')' THEN depth - 1
         ELSE depth END,
    CASE WHEN quote <> '' THEN CASE WHEN ch = quote AND prev <> '\\' THEN '' ELSE quote END
         WHEN ch IN ('"', '''', '`') THEN ch ELSE '' END,
    ch
  FROM (SELECT *, substr(rest, i + 1, 1) AS ch FROM walk WHERE depth > 0 AND i < length(rest))),
calls AS (SELECT tid, ro, xo, k,
    CASE WHEN depth = 0 THEN left(rest, i - 1) ELSE rest END AS arguments
  FROM walk WHERE depth = 0 OR i = length(rest))"""


def kept(rule: Rule) -> str:
    if rule.kind == SECRET:
        tests = ["TRUE"]
        if rule.not_prefix:
            tests.append(f"NOT starts_with(token, {q(rule.not_prefix)})")
        if rule.min_entropy is not None:
            tests.append(high_entropy("token", rule.min_entropy))
        return " AND ".join(tests)
    if rule.kind == PROMPT:
        def some(regex: str) -> str:
            return (f"len(list_filter(regexp_extract_all(token, {q(regex)}, 1), "
                    f"lambda e: {untrusted('e')})) > 0")

        return (f"CASE WHEN regexp_matches(file, '(?i)\\.py\\z') THEN {some(PY_PLACEHOLDER)} "
                f"ELSE {some(JS_PLACEHOLDER)} END")
    if rule.kind == CALL:
        return (f"NOT regexp_matches(arguments, {q(TOKEN_LIMIT)}) AND NOT regexp_matches("
                f"trim(arguments, {SPACES}), {q(SPREAD_OR_VARIABLE)})")
    if rule.kind == VECTOR:
        return f"NOT (starts_with(token, {q(PINECONE_TOKEN_PREFIX)}) AND xo > 0)"
    if rule.kind == ENV:
        return "NOT contains(token, 'process.env')"
    return "TRUE"


def masked(token: str) -> str:
    return (f"CASE WHEN length({token}) <= 8 THEN '***' ELSE left({token}, 4) || '...' "
            f"|| right({token}, 4) END")


def replaced(line: str, token: str) -> str:
    return (
        f"CASE WHEN instr({line}, {token}) > 0 THEN "
        f"left({line}, instr({line}, {token}) - 1) || {masked(token)} "
        f"|| substr({line}, instr({line}, {token}) + length({token})) ELSE {line} END"
    )


def suppression_ctes() -> list[str]:
    p = directive_patterns(PREFIX)

    def rule(kind: str) -> str:
        return f"coalesce(nullif(regexp_extract(t, {q(p[kind])}, 1), ''), '*')"

    return [
        f"""dir_lines AS MATERIALIZED (
          SELECT tid, scan_id, file, unnest(string_split(content, {NL})) AS t,
                 unnest(range(1, len(string_split(content, {NL})) + 1)) AS n
          FROM texts WHERE contains(content, {q(PREFIX)}))""",
        f"""dir_state AS (
          SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY tid ORDER BY n) AS state
          FROM (SELECT *, CASE WHEN contains(t, {q(f'/* {PREFIX}-enable */')}) THEN 'close'
                  WHEN regexp_matches(t, {q(p['open'])}) THEN 'open:' || {rule('open')} END AS e
                FROM dir_lines))""",
        """block_rows AS MATERIALIZED (
          SELECT tid, scan_id, file, n AS line, substr(state, 6) AS rule_id FROM dir_state
          WHERE state LIKE 'open:%')""",
        f"""suppressed_rows AS MATERIALIZED (
          SELECT * FROM block_rows
          UNION SELECT tid, scan_id, file, n, {rule('ignore')} FROM dir_lines
            WHERE regexp_matches(t, {q(p['ignore'])})
          UNION SELECT tid, scan_id, file, n + 1, {rule('next')} FROM dir_lines d
            WHERE regexp_matches(t, {q(p['next'])}) AND NOT EXISTS (
              SELECT 1 FROM block_rows b WHERE b.tid = d.tid AND b.line = d.n + 1))""",
    ]


def finding_ctes(rules: Sequence[Rule] = RULES) -> list[str]:
    """``found``: one row per finding in ``texts``, with its suppression flag."""
    calls = ", ".join(str(i) for i, r in enumerate(rules) if r.kind == CALL)
    keep = " ".join(f"WHEN {i} THEN {kept(r)}" for i, r in enumerate(rules)
                    if r.kind in (SECRET, PROMPT, CALL, VECTOR, ENV))
    entropies = ", ".join(str(i) for i, r in enumerate(rules) if r.min_entropy is not None) or "-1"
    redacted = ", ".join(str(i) for i, r in enumerate(rules) if r.redact) or "-1"
    single = ", ".join(str(i) for i, r in enumerate(rules) if r.one_per_line) or "-1"
    ctes = [raw_hits(rules)]
    if calls:
        ctes.append(CALLS.replace("{rules}", calls))
    arguments = "arguments" if calls else "NULL AS arguments"
    join = "LEFT JOIN calls USING (tid, ro, xo, k)" if calls else ""
    ctes += [
        f"""placed AS (
          SELECT *, CAST(length(before) - length(replace(before, {NL}, '')) + 1 AS INTEGER) AS line,
                 CAST(length(list_extract(string_split(before, {NL}), -1)) + 1 AS INTEGER) AS col
          FROM (SELECT h.*, {arguments}, t.scan_id, t.file, t.content,
                       substr(content, 1, CAST(off AS BIGINT)) AS before
                FROM raw_hits h JOIN texts t USING (tid) {join}))""",
        f"""valid AS (
          SELECT *, row_number() OVER (PARTITION BY tid, ro, line ORDER BY xo, k) AS on_line
          FROM placed WHERE {f'CASE ro {keep} ELSE TRUE END' if keep else 'TRUE'})""",
        values("catalogue", "ro, rule_id, severity, category, title, description, fix, url, cwe, "
               "owasp",
               [(i, r.rule_id, r.severity, r.category, r.name, r.description, r.fix, r.url,
                 r.cwe_id, r.owasp) for i, r in enumerate(rules)]),
        *suppression_ctes(),
        f"""found AS MATERIALIZED (
          SELECT v.tid, v.scan_id, v.file, v.ro, v.xo, v.k, rule_id, severity, category, v.line,
            v.col AS "column",
            CASE WHEN ro IN ({redacted}) THEN {replaced('sn', 'token')} ELSE sn END AS snippet,
            CASE WHEN ro IN ({entropies}) THEN round({entropy(cleaned('token'))}, 6) END
              AS entropy,
            EXISTS (SELECT 1 FROM suppressed_rows s WHERE s.tid = v.tid AND s.line = v.line
                    AND s.rule_id IN ('*', c.rule_id)) AS suppressed,
            title, description, fix, url, cwe, owasp
          FROM (SELECT *, trim(string_split(content, {NL})[line], {SPACES}) AS sn FROM valid) v
          JOIN catalogue c USING (ro)
          WHERE ro NOT IN ({single}) OR on_line = 1)""",
    ]
    return ctes


SCAN = [*FILES, texts_from("files"), *finding_ctes()]

# --- diffs --------------------------------------------------------------------


def prefixed(text: str, prefix: str) -> str:
    return f"{q(prefix)} || replace({text}, {NL}, {NL} || {q(prefix)})"


DIFFS = [
    *FILES,
    f"""diffs AS MATERIALIZED (
      SELECT source || '/' || doc_id AS scan_id,
        CASE WHEN doc_id % 3 = 0 THEN 'commit ' || md5(doc_id::VARCHAR) || {q(chr(10) * 2 + '    change' + chr(10) * 2)} ELSE '' END
        || CASE WHEN doc_id % 11 = 0 THEN {q("diff --git a/x.bin b/x.bin" + chr(10) + "Binary files a/x.bin and b/x.bin differ" + chr(10))} ELSE '' END
        || 'diff --git a/' || file_path || ' b/' || file_path || {q(chr(10) + '--- a/')} || file_path
        || {q(chr(10) + '+++ b/')} || file_path || {NL}
        || '@@ -1,3 +' || (doc_id % 40 + 1) || {q(',9 @@ section' + chr(10))}
        || {prefixed('head', '+')} || {q(chr(10) + '-old line' + chr(10))}
        || {prefixed('text', ' ')} || {NL} || {prefixed('tail', '+')} || {NL}
        || CASE WHEN doc_id % 7 = 0 THEN '@@ -900 +' || (doc_id % 40 + 901) || {q(' @@' + chr(10))}
             || {prefixed('tail', ' ')}
             || {q(chr(10) + '+eval(msg);' + chr(10) + chr(92) + ' No newline at end of file' + chr(10))} ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN {q("diff --git a/gone.ts b/gone.ts" + chr(10) + "--- a/gone.ts" + chr(10) + "+++ /dev/null" + chr(10) + "@@ -1 +0,0 @@" + chr(10) + "-eval(msg)" + chr(10))} ELSE '' END
        AS diff_text
      FROM files)""",
]


def parsed_diffs(source: str = "diffs") -> list[str]:
    return [
        f"""blocks AS MATERIALIZED (
          SELECT * FROM (
            SELECT scan_id, unnest(ss) AS block, unnest(range(0, len(ss))) AS block_ord
            FROM (SELECT scan_id, string_split_regex(diff_text, '(?m)^diff --git ') AS ss
                  FROM {source}))
          WHERE trim(block, {SPACES}) <> '')""",
        f"""block_lines AS MATERIALIZED (
          SELECT scan_id, block_ord, unnest(string_split(block, {NL})) AS t,
                 unnest(range(0, len(string_split(block, {NL})))) AS n FROM blocks)""",
        """block_files AS MATERIALIZED (
          SELECT * FROM (
            SELECT scan_id, block_ord, arg_min(
              CASE WHEN starts_with(t, '+++ b/') THEN substr(t, 7) ELSE substr(t, 5) END, n) AS file
            FROM block_lines WHERE starts_with(t, '+++ ') GROUP BY ALL)
          WHERE file NOT IN ('', '/dev/null'))""",
        r"""hunk_lines AS MATERIALIZED (
          SELECT scan_id, block_ord, file, t, n, start,
            count(start) OVER w AS hunk_ord,
            last_value(start IGNORE NULLS) OVER w AS new_start,
            max(CASE WHEN start IS NOT NULL THEN n END) OVER w AS header_n
          FROM (SELECT *, CASE WHEN regexp_matches(t, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@')
                  THEN CAST(regexp_extract(t, '^@@ -\d+(?:,\d+)? \+(\d+)', 1) AS BIGINT) END AS start
                FROM block_lines JOIN block_files USING (scan_id, block_ord))
          WINDOW w AS (PARTITION BY scan_id, block_ord ORDER BY n))""",
        """typed_lines AS MATERIALIZED (
          SELECT scan_id, block_ord, file, hunk_ord, new_start, n, n - header_n AS line_ord,
            substr(t, 2) AS content, type,
            CASE WHEN type <> 'del' THEN new_start + coalesce(sum(CASE WHEN type <> 'del' THEN 1
              ELSE 0 END) OVER (PARTITION BY scan_id, block_ord, hunk_ord ORDER BY n
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS new_line
          FROM (SELECT *, CASE
                  WHEN starts_with(t, '+') AND NOT starts_with(t, '+++') THEN 'add'
                  WHEN starts_with(t, '-') AND NOT starts_with(t, '---') THEN 'del'
                  WHEN starts_with(t, ' ') THEN 'context' END AS type
                FROM hunk_lines WHERE hunk_ord > 0 AND start IS NULL)
          WHERE type IS NOT NULL)""",
        f"""hunks AS MATERIALIZED (
          SELECT scan_id, block_ord, file, hunk_ord, new_start,
            string_agg(content, {NL} ORDER BY n) AS content, list(type = 'add' ORDER BY n) AS added
          FROM typed_lines WHERE type <> 'del' GROUP BY ALL)""",
    ]


def diff_scan(source: str = "diffs") -> list[str]:
    return [
        *parsed_diffs(source),
        f"""texts AS MATERIALIZED (
          SELECT scan_id || '#' || block_ord || '#' || hunk_ord AS tid, scan_id, file, content,
                 added, new_start, block_ord, hunk_ord
          FROM hunks WHERE NOT {ignored('file', DEFAULT_IGNORES)})""",
        *finding_ctes(),
        """diff_found AS MATERIALIZED (
          SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY scan_id, file, real_line, rule_id
                ORDER BY block_ord, hunk_ord, ro, xo, k) AS nth
            FROM (SELECT f.*, CAST(t.new_start + f.line - 1 AS INTEGER) AS real_line,
                         t.block_ord, t.hunk_ord
                  FROM found f JOIN texts t USING (tid) WHERE t.added[f.line]))
          WHERE nth = 1)""",
    ]


DIFF_SCAN = [*DIFFS, *diff_scan()]
DIFF_SELECT = ('scan_id, file, real_line AS line, rule_id, severity, "column", snippet, '
               "suppressed")

# --- reviews ------------------------------------------------------------------

VERDICT = (
    f"CASE WHEN toxic = 1 THEN {q(CONFIRMED)} WHEN quality = 1 THEN {q(FALSE_POSITIVE)} "
    "ELSE 'NEEDS_INVESTIGATION' END"
)


def one_verdict(line: str, patch: str) -> str:
    return (
        "'{\"ruleId\":\"' || CASE doc_id % 4 WHEN 0 THEN 'AIS-002' WHEN 1 THEN 'AIS-007' "
        "WHEN 2 THEN 'SEC-001' ELSE 'MCP-004' END "
        f"|| '\",\"line\":' || {line} || ',\"verdict\":\"' || {VERDICT} "
        "|| '\",\"confidence\":0.' || (doc_id % 89 + 10) || ',\"reasoning\":\"seen | in ' "
        f"|| doc_id || '\",\"suggestedPatch\":\"{patch}\"}}'"
    )


REVIEWS = [
    f"""responses AS MATERIALIZED (
      SELECT source || '/' || doc_id AS scan_id,
        CASE doc_id % 17 WHEN 0 THEN '' WHEN 1 THEN '{{"summary": "cut'
          WHEN 2 THEN '{{"summary":""}}'
          ELSE '{{"summary":"review of ' || doc_id || '","findingsAnalysis":['
            || {one_verdict('(doc_id % 40 + 1)', 'fixed();')}
            || CASE WHEN doc_id % 2 = 0 THEN ',' || {one_verdict('(doc_id % 40 + 902)', '')}
               ELSE '' END || ']'
            || CASE WHEN doc_id % 3 = 0 THEN ''
               ELSE ',"architecturalRecommendations":["rotate keys","pin versions"]' END || '}}'
        END AS response_json
      FROM labels JOIN documents USING (doc_id))""",
    f"""reviews AS MATERIALIZED (
      SELECT scan_id, ok,
        CASE WHEN NOT ok THEN {q(FAILED_SUMMARY)}
          ELSE coalesce(nullif(body ->> '$.summary', ''), {q(DEFAULT_SUMMARY)}) END AS summary,
        CASE WHEN ok THEN coalesce(json_extract(body, '$.findingsAnalysis[*]'), []) ELSE [] END
          AS analysis,
        CASE WHEN NOT ok THEN [{q(FAILED_ADVICE)}]
          ELSE coalesce(json_extract_string(body, '$.architecturalRecommendations[*]'), []) END
          AS recommendations
      FROM (SELECT scan_id, json_valid(response_json) AS ok,
              CASE WHEN json_valid(response_json) THEN response_json::JSON END AS body
            FROM responses WHERE response_json <> ''))""",
    """verdicts AS MATERIALIZED (
      SELECT scan_id, verdict_ord, v ->> 'ruleId' AS rule_id, CAST(v ->> 'line' AS INTEGER) AS line,
        v ->> 'verdict' AS verdict, CAST(v ->> 'confidence' AS DOUBLE) AS confidence,
        v ->> 'reasoning' AS reasoning, v ->> 'suggestedPatch' AS suggested_patch
      FROM (SELECT scan_id, unnest(analysis) AS v,
                   unnest(range(0, len(analysis))) AS verdict_ord FROM reviews))""",
]
JUDGED = """judged AS MATERIALIZED (
  SELECT f.* EXCLUDE (line), f.real_line AS line, v.verdict, v.confidence, v.reasoning,
         v.suggested_patch
  FROM diff_found f LEFT JOIN (
    SELECT * FROM verdicts QUALIFY row_number() OVER (
      PARTITION BY scan_id, rule_id, line ORDER BY verdict_ord) = 1) v
  ON f.scan_id = v.scan_id AND f.rule_id = v.rule_id AND f.real_line = v.line)"""

# --- totals -------------------------------------------------------------------


def totals(base: str, found: str, threshold: str = "high") -> str:
    """``base(scan_id, scanned_files)`` with the counts of ``found``."""
    counts = ", ".join(
        f"count(*) FILTER (WHERE NOT suppressed AND severity = {q(s)}) AS {s}"
        for s in reversed(SEVERITIES)
    )
    points = " + ".join(f"{w} * coalesce({s}, 0)" for s, w in WEIGHTS.items())
    failing = SEVERITIES[SEVERITIES.index(threshold):]
    return f"""totals AS MATERIALIZED (
      SELECT scan_id, scanned_files, coalesce(findings_count, 0) AS findings_count,
        coalesce(suppressed_count, 0) AS suppressed_count,
        {', '.join(f'coalesce({s}, 0) AS {s}' for s in reversed(SEVERITIES))},
        CAST(least({MAX_SCORE}, {points}) AS INTEGER) AS risk_score,
        {' + '.join(f'coalesce({s}, 0)' for s in failing)} = 0 AS passed
      FROM ({base}) LEFT JOIN (
        SELECT scan_id, count(*) FILTER (WHERE NOT suppressed) AS findings_count,
          count(*) FILTER (WHERE suppressed) AS suppressed_count, {counts}
        FROM {found} GROUP BY scan_id) USING (scan_id))"""


TEXT_COUNT = "SELECT scan_id, count(*) AS scanned_files FROM texts GROUP BY scan_id"
DIFF_COUNT = f"""SELECT scan_id, count(DISTINCT file) AS scanned_files FROM diffs
  LEFT JOIN (SELECT * FROM block_files WHERE NOT {ignored('file', DEFAULT_IGNORES)})
  USING (scan_id) GROUP BY scan_id"""
SCAN_TOTALS = [*SCAN, totals(TEXT_COUNT, "found")]
DIFF_TOTALS = [*DIFF_SCAN, totals(DIFF_COUNT, "diff_found")]

DETECTED = [
    *CASE_VIEW,
    "texts AS MATERIALIZED (SELECT id AS tid, id AS scan_id, file_path AS file, code AS content "
    "FROM cases)",
    *finding_ctes(),
    """detected AS MATERIALIZED (
      SELECT c.*, EXISTS (SELECT 1 FROM found f WHERE f.tid = c.id AND NOT f.suppressed) AS hit
      FROM cases c)""",
]
MATRIX = """count(*) AS total,
  count(*) FILTER (WHERE expected_vulnerability AND hit) AS tp,
  count(*) FILTER (WHERE NOT expected_vulnerability AND hit) AS fp,
  count(*) FILTER (WHERE NOT expected_vulnerability AND NOT hit) AS tn,
  count(*) FILTER (WHERE expected_vulnerability AND NOT hit) AS fn"""


def case_of(column: str, table: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def filled(text: str, *values: str) -> str:
    """SQL for ``text`` with its ``{}`` filled by expressions."""
    parts = [q(part) for part in text.split("{}")]
    return " || ".join([parts[0], *(f"{value} || {part}" for value, part in zip(values, parts[1:]))])


COMMENT_HEAD = (
    f"{filled(COMMENT_TITLE, 'rule_id', 'title')} || {q(chr(10) * 2)} || severity || ', ' || category "
    f"|| {q(chr(10) * 2)} || description || {q(chr(10) * 2)}"
)
COMMENT_BODY = (
    f"{COMMENT_HEAD} || CASE WHEN coalesce(fix, '') <> '' THEN {q(COMMENT_FIX)} "
    f"|| fix || {q(chr(10) * 2)} ELSE '' END || {filled(COMMENT_END, 'rule_id')}"
)
JUDGED_BODY = (
    f"{COMMENT_HEAD} || CASE WHEN coalesce(reasoning, '') <> '' THEN {q(COMMENT_REASON)} "
    f"|| reasoning || {q(chr(10) * 2)} ELSE '' END || CASE WHEN coalesce(suggested_patch, '') <> '' "
    f"THEN {q(COMMENT_PATCH + chr(10) + '```suggestion' + chr(10))} "
    f"|| suggested_patch || {q(chr(10) + '```' + chr(10))} "
    f"WHEN coalesce(fix, '') <> '' THEN {q(COMMENT_FIX)} || fix || {NL} ELSE '' END"
)

FINDING = 'scan_id, file, rule_id, severity, category, line, "column", snippet'


def rule_sql(rule: Rule) -> str:
    source, extra = "files", []
    if rule.rule_id == "AIS-001":
        extra = [CHAT_FILES]
        source = ("(SELECT scan_id, file_path, content FROM files UNION ALL "
                  "SELECT * FROM chat_files)")
    return with_(
        [*FILES, *extra, texts_from(source), *finding_ctes((rule,))],
        'SELECT scan_id, file, line, "column", snippet, entropy FROM found',
    )


def pruned(path: str, dirs: Sequence[str], extensions: Sequence[str]) -> str:
    named = ", ".join(q(d) for d in dirs)
    folders = f"string_split(replace({path}, '\\', '/'), '/')[:-2]"
    tests = (f"len(list_filter({folders}, lambda d: d IN ({named}) OR starts_with(d, '.'))) > 0")
    if extensions:
        listed = ", ".join(q(e) for e in extensions)
        tests += (f" OR lower(regexp_extract(list_extract(string_split({path}, '/'), -1), "
                  f"'[^.](\\.[^.]*)\\z', 1)) IN ({listed})")
    return f"({tests})"


def listed_patterns() -> str:
    """CTE: the non-comment lines of each scan's ignore files, with where they stand."""
    names = " ".join(f"WHEN {q(n)} THEN {i + 2}" for i, n in enumerate(IGNORE_FILES))
    return f"""listed AS (
      SELECT scan_id, trim(raw, {SPACES}) AS pattern, src, file_path AS origin, line_ord
      FROM (SELECT scan_id, file_path,
              CASE list_extract(string_split(file_path, '/'), -1) {names} END AS src,
              unnest(string_split(content, {NL})) AS raw,
              unnest(range(0, len(string_split(content, {NL})))) AS line_ord
            FROM files) WHERE src IS NOT NULL)"""


def covered_ctes(more: str = "") -> list[str]:
    """``open_files``: those that no pattern of their scan covers, each path against each pattern
    as the test is worded. ``more`` adds (scan_id, pattern) rows."""
    norm = "regexp_replace(replace(file_path, '\\', '/'), '^\\./', '')"
    return [
        listed_patterns(),
        f"""worded AS (
          SELECT scan_id, clean, regexp_replace(regexp_replace(clean, '/\\*\\*$', ''), '/$', '') AS folder
          FROM (SELECT DISTINCT scan_id, trim(regexp_replace(replace(pattern, '\\', '/'), '^\\./', ''), {SPACES}) AS clean
                FROM (SELECT scan_id, pattern FROM listed WHERE pattern <> '' AND NOT starts_with(pattern, '#') {more}))
          WHERE clean <> '')""",
        f"""covered AS (
          SELECT DISTINCT scan_id, file_path
          FROM (SELECT scan_id, file_path, {norm} AS norm FROM files) JOIN worded USING (scan_id)
          WHERE starts_with(clean, '*.') AND ends_with(norm, substr(clean, 2))
            OR norm = folder OR starts_with(norm, folder || '/')
            OR contains(norm, '/' || folder || '/') OR ends_with(norm, '/' || folder))""",
        "open_files AS (SELECT * FROM files ANTI JOIN covered USING (scan_id, file_path))",
        texts_from("open_files"),
    ]


def ignore_files_sql() -> str:
    return with_([*FILES, *covered_ctes(), *finding_ctes()], f"SELECT {FINDING}, suppressed FROM found")


# Fixed width patterns for the rules that look around: what they find must be the same.
_LOOKED_AT = (
    (r"""token\s*=\s*"([0-9a-f]{32,})["]""", (1,)),
    (r"""token = "([0-9a-f]{32,})""", (1,)),
    (r"""token\s*=\s*(?:"|&quot;)([0-9a-f]{32,})""", (1,)),
    (r"""\btoken\s*=\s*"([0-9a-f]{32,})""", (1,)),
)


def lookaround_sql() -> str:
    rules = tuple(
        replace(rule, patterns=(Pattern(text, groups=groups),))
        for rule, (text, groups) in zip(registered.LOOKAROUND, _LOOKED_AT)
    )
    behind = registered.LOOKAROUND[1].rule_id
    return with_(
        [*FILES, PAGE_FILES, texts_from(_CUSTOM_SOURCE), *finding_ctes(rules)],
        f"""SELECT rule_id, scan_id, file, line,
          CAST("column" + CASE WHEN rule_id = {q(behind)} THEN length('token = "') ELSE 0 END AS INTEGER)
            AS "column", snippet, entropy FROM found""",
    )


def function_ctes() -> list[str]:
    """Findings of the functions in ``texts``: the same tests on unnested lines."""
    wide, called, _ = registered.FUNCTIONS
    gate = f"regexp_matches(file, {q(re2_regex(called.path_pattern))}) AND NOT ends_with(replace(file, '\\', '/'), 'fixtures.ts')"
    return [
        *suppression_ctes(),
        f"""lines AS MATERIALIZED (
          SELECT tid, scan_id, file, unnest(string_split(content, {NL})) AS t,
            CAST(unnest(range(1, len(string_split(content, {NL})) + 1)) AS INTEGER) AS line FROM texts)""",
        f"""by_function AS (
          SELECT *, EXISTS (SELECT 1 FROM suppressed_rows s WHERE s.tid = h.tid AND s.line = h.line
              AND s.rule_id IN ('*', h.rule_id)) AS suppressed, 'code-quality' AS category
          FROM (
            SELECT tid, scan_id, file, line, {q(wide.rule_id)} AS rule_id, 'low' AS severity,
              CAST({registered.WIDTH + 1} AS INTEGER) AS "column", left(t, 40) AS snippet
            FROM lines WHERE length(t) > {registered.WIDTH}
            UNION ALL
            SELECT tid, scan_id, file, line, {q(called.rule_id)}, 'medium',
              CAST(instr(t, 'eval(') AS INTEGER), trim(t, {SPACES})
            FROM lines WHERE contains(t, 'eval(') AND {gate}) h)""",
    ]


def function_diff_sql() -> str:
    return with_(
        [
            *DIFFS,
            *parsed_diffs(),
            f"""texts AS MATERIALIZED (
              SELECT scan_id || '#' || block_ord || '#' || hunk_ord AS tid, scan_id, file, content,
                     added, new_start, block_ord, hunk_ord
              FROM hunks WHERE NOT {ignored('file', registered.IGNORES)})""",
            *function_ctes(),
        ],
        """SELECT scan_id, file, CAST(new_start + f.line - 1 AS INTEGER) AS line, rule_id, severity,
             "column", snippet, suppressed
           FROM by_function f JOIN (SELECT tid, added, new_start, block_ord, hunk_ord FROM texts) USING (tid)
           WHERE added[f.line]
           QUALIFY row_number() OVER (PARTITION BY scan_id, file, new_start + f.line - 1, rule_id
             ORDER BY block_ord, hunk_ord) = 1""",
    )


def history_sql() -> str:
    """Whole histories as one text per source, cut as any diff; the commit is the last one named."""
    commit = "list_extract(regexp_extract_all(p, '(?m)^commit ([0-9a-f]{7,64})', 1), -1)"
    return with_(
        [
            *DIFFS,
            f"""histories AS (
              SELECT source AS scan_id, string_agg(CASE WHEN doc_id % 2 = 0 THEN 'commit ' || md5('h' || doc_id)
                || {NL} ELSE '' END || diff_text || {NL}, '' ORDER BY doc_id) AS t
              FROM (SELECT scan_id AS sid, diff_text FROM diffs) JOIN documents ON sid = source || '/' || doc_id
              GROUP BY source)""",
            """cut AS (
              SELECT scan_id, unnest(ss) AS p, unnest(range(0, len(ss))) AS block_ord
              FROM (SELECT scan_id, string_split_regex(t, '(?m)^diff --git ') AS ss FROM histories))""",
            f"""told AS (
              SELECT *, last_value({commit} IGNORE NULLS) OVER (PARTITION BY scan_id ORDER BY block_ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS commit FROM cut)""",
        ],
        f"""SELECT scan_id, CAST(block_ord AS INTEGER) AS block_ord, coalesce(commit, '') AS commit,
              CAST(length(p) AS INTEGER) AS n_chars, md5(p) AS digest
            FROM told WHERE trim(p, {SPACES}) <> ''""",
    )


def configs_sql() -> str:
    """Every scan under the settings that its configuration is known to mean."""
    rows = ",\n".join(
        f"({i}, {q(','.join(c.disabled))}, {q(c.severity_rule)}, {q(c.severity)}, "
        f"{'NULL' if c.min_entropy is None else c.min_entropy}, {q(c.threshold or 'high')}, {q(','.join(c.ignores))})"
        for i, c in enumerate(CONFIGS)
    )
    known = f"known(k, off, changed, severity, least, threshold, folders) AS (VALUES {rows})"
    own = values("own", "rule_id, own_least", [(r.rule_id, str(r.min_entropy)) for r in RULES if r.min_entropy is not None])
    open_rules = tuple(replace(r, min_entropy=0.0) if r.min_entropy is not None else r for r in RULES)
    points = " ".join(f"WHEN {q(s)} THEN {w}" for s, w in WEIGHTS.items())
    rank = " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(SEVERITIES))
    return with_(
        [
            *FILES,
            known,
            own,
            f"""settings AS (
              SELECT scan_id, known.* FROM (SELECT source AS scan_id, min(doc_id) AS d FROM documents GROUP BY source)
              JOIN known ON d % {len(CONFIGS)} = k)""",
            *covered_ctes("UNION ALL SELECT scan_id, unnest(string_split(folders, ',')) FROM settings"),
            *finding_ctes(open_rules),
            f"""effective AS (
              SELECT f.scan_id, CASE WHEN s.changed = f.rule_id THEN s.severity ELSE f.severity END AS severity, f.suppressed
              FROM found f JOIN settings s USING (scan_id) LEFT JOIN own USING (rule_id)
              WHERE NOT list_contains(string_split(s.off, ','), f.rule_id)
                AND (own_least IS NULL OR f.entropy >= coalesce(s.least, CAST(own_least AS DOUBLE))))""",
            values("written", "k, n_files", [(i, len(c.files)) for i, c in enumerate(CONFIGS)]),
            """counted AS (
              SELECT s.scan_id, coalesce(n, 0) + n_files AS scanned_files FROM settings s JOIN written USING (k)
              LEFT JOIN (SELECT scan_id, count(*) AS n FROM texts GROUP BY scan_id) USING (scan_id))""",
        ],
        f"""SELECT scan_id, coalesce(scanned_files, 0) AS scanned_files,
              count(*) FILTER (WHERE NOT suppressed) AS findings_count,
              count(*) FILTER (WHERE suppressed) AS suppressed_count,
              {', '.join(f"count(*) FILTER (WHERE NOT suppressed AND e.severity = {q(s)}) AS {s}" for s in reversed(SEVERITIES))},
              CAST(least({MAX_SCORE}, coalesce(sum(CASE WHEN NOT suppressed THEN CASE e.severity {points} END END), 0)) AS INTEGER) AS risk_score,
              coalesce(max(CASE WHEN NOT suppressed THEN CASE e.severity {rank} END END), -1)
                < any_value(CASE s.threshold {rank} END) AS passed
            FROM settings s LEFT JOIN counted USING (scan_id) LEFT JOIN effective e USING (scan_id)
            GROUP BY scan_id, scanned_files""",
    )


def ignore_patterns() -> str:
    fixed = [(p, 0, i) for i, p in enumerate(DEFAULT_IGNORES)]
    fixed += [(p, 1, i) for i, p in enumerate(("docs/", "dist/**"))]
    return with_(
        [
            *FILES,
            values("fixed", "pattern, src, line_ord", fixed),
            listed_patterns(),
            """all_rows AS (
              SELECT scan_id, pattern, src, '' AS origin, line_ord
              FROM (SELECT DISTINCT scan_id FROM files), fixed
              UNION ALL SELECT * FROM listed WHERE pattern <> '' AND NOT starts_with(pattern, '#'))""",
        ],
        """SELECT scan_id, pattern, CAST(src AS INTEGER) AS src, origin,
             CAST(line_ord AS INTEGER) AS line_ord
           FROM all_rows QUALIFY row_number() OVER (
             PARTITION BY scan_id, pattern ORDER BY src, origin, line_ord) = 1""",
    )


def budget() -> str:
    limit = registered.BUDGET
    over = f"length(s.text) + 1 + length(b.block) > {limit}"
    part = f"substr(b.block, 1, {limit} - length(s.text))"
    cut = (f"CASE WHEN contains({part}, {NL}) THEN left({part}, length({part}) - length("
           f"list_extract(string_split({part}, {NL}), -1)) - 1) ELSE {part} END")
    return with_(
        [
            *DIFF_SCAN,
            f"""targets AS (SELECT DISTINCT scan_id, replace(file, '\\', '/') AS f FROM diff_found
              WHERE NOT suppressed)""",
            f"""ranked AS MATERIALIZED (
              SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY targeted DESC, block_ord) AS i
              FROM (SELECT scan_id, block_ord, 'diff --git ' || block AS block,
                EXISTS (SELECT 1 FROM targets t WHERE t.scan_id = b.scan_id AND contains(
                  string_split('diff --git ' || b.block, {NL})[1], t.f)) AS targeted
                FROM blocks b))""",
            f"""steps AS (
              SELECT scan_id, CAST(0 AS BIGINT) AS i, '' AS text, FALSE AS stop1, FALSE AS stop2
              FROM diffs WHERE length(diff_text) > {limit}
              UNION ALL
              SELECT s.scan_id, b.i,
                CASE WHEN b.targeted THEN
                  CASE WHEN s.stop1 THEN s.text
                    WHEN {over} THEN CASE WHEN {limit} - length(s.text) > {LEAST_PARTIAL}
                      THEN s.text || {NL} || {cut} || {q(TRUNCATED)} ELSE s.text END
                    WHEN s.text = '' THEN b.block ELSE s.text || {NL} || b.block END
                ELSE CASE WHEN s.stop2 THEN s.text WHEN {over} THEN s.text || {q(OMITTED)}
                    ELSE s.text || {NL} || b.block END END,
                s.stop1 OR (b.targeted AND {over}),
                s.stop2 OR (NOT b.targeted AND {over})
              FROM steps s JOIN ranked b ON b.scan_id = s.scan_id AND b.i = s.i + 1)""",
            f"""fitted AS (
              SELECT d.scan_id, CASE WHEN length(diff_text) <= {limit} THEN diff_text
                WHEN l.text = '' THEN left(diff_text, {limit}) ELSE l.text END AS budgeted
              FROM diffs d LEFT JOIN (SELECT scan_id, arg_max(text, i) AS text FROM steps
                GROUP BY scan_id) l USING (scan_id))""",
        ],
        "SELECT scan_id, CAST(length(budgeted) AS INTEGER) AS n_chars, md5(budgeted) AS digest "
        "FROM fitted",
    )


TOKENS = [
    *FILES,
    f"""tokens AS (
      SELECT file_path, CAST(unnest(range(0, len(ts))) AS INTEGER) AS nth, unnest(ts) AS token
      FROM (SELECT file_path, regexp_extract_all(content, {q(registered.TOKEN)}) AS ts FROM files))""",
]


def positions_sql() -> str:
    regex = q(re2_regex(registered.NUMBERS_AND_TAGS))
    return with_(
        [
            *FILES,
            PAGE_FILES,
            f"""cut AS (SELECT file_path, content, regexp_extract_all(content, {regex}) AS ms,
                  string_split_regex(content, {regex}) AS ss FROM (
                    SELECT * FROM page_files
                    UNION ALL SELECT scan_id, file_path, content FROM files))""",
            """parts AS (SELECT file_path, content, unnest(ms) AS m, unnest(ss[1:len(ms)]) AS s,
                  unnest(range(0, len(ms))) AS nth FROM cut)""",
            """offs AS (SELECT *, substr(content, 1, CAST(sum(length(s)) OVER w
                  + sum(length(m)) OVER w - length(m) AS BIGINT)) AS before FROM parts
                  WINDOW w AS (PARTITION BY file_path ORDER BY nth))""",
            f"""placed AS (SELECT *, CAST(len(string_split_regex(before, '\\r?\\n')) AS INTEGER) AS line,
                  CAST(length(list_extract(string_split_regex(before, '\\r?\\n'), -1)) + 1 AS INTEGER)
                    AS col FROM offs)""",
        ],
        f"""SELECT file_path, CAST(nth AS INTEGER) AS nth, line, col AS "column", m AS text,
              md5(trim(string_split_regex(content, '\\r?\\n')[line], {SPACES})) AS snippet
            FROM placed""",
    )


CALL_RULE = next(r for r in RULES if r.kind == CALL)

SARIF_RULES = f"""
SELECT DISTINCT scan_id, rule_id, title AS name, description,
  description || CASE WHEN coalesce(fix, '') <> '' THEN {q(chr(10) + 'How to fix it: ')} || fix
    ELSE '' END AS help_text,
  '### ' || title || {q(chr(10) * 2)} || description || {q(chr(10) * 2)}
    || CASE WHEN coalesce(fix, '') <> '' THEN {q('**How to fix it**' + chr(10))} || fix
       || {q(chr(10) * 2)} ELSE '' END
    || CASE WHEN coalesce(url, '') <> '' THEN '[More on this](' || url || ')' ELSE '' END
    AS help_markdown,
  url AS help_uri, {case_of('severity', LEVELS)} AS level, severity,
  'security,ai-safety' || coalesce(',external/cwe/' || lower(cwe), '')
    || coalesce(',external/owasp/' || regexp_replace(lower(owasp), '[^a-z0-9]+', '-', 'g'), '')
    AS tags
FROM found WHERE NOT suppressed"""

TOTAL_COLUMNS = ("scan_id, scanned_files, findings_count, suppressed_count, critical, high, medium, "
                 "low, info, risk_score, passed")


def gate_sql() -> str:
    grouped = "scan_id || ':' || list_extract(string_split(file, '.'), -1)"
    base = f"SELECT {grouped} AS scan_id, count(*) AS scanned_files FROM texts GROUP BY 1"
    found = f"(SELECT * REPLACE ({grouped} AS scan_id) FROM found)"
    gates = ", ".join(
        " + ".join(SEVERITIES[SEVERITIES.index(t):]) + f" = 0 AS passed_{t}"
        for t in registered.THRESHOLDS
    )
    return with_([*SCAN, totals(base, found)], f"SELECT scan_id, {gates}, passed FROM totals")


def review_gate_sql() -> str:
    return with_(
        [*DIFF_TOTALS, *REVIEWS],
        f"""SELECT scan_id, t.passed AS threshold_passed,
          CASE WHEN r.scan_id IS NULL THEN t.passed
            ELSE NOT (coalesce(confirmed, FALSE) OR (NOT t.passed AND coalesce(open, FALSE))) END
            AS passed
        FROM totals t LEFT JOIN reviews r USING (scan_id) LEFT JOIN (
          SELECT scan_id, bool_or(verdict = {q(CONFIRMED)}) AS confirmed,
                 bool_or(verdict <> {q(FALSE_POSITIVE)}) AS open
          FROM verdicts GROUP BY scan_id) v USING (scan_id)""",
    )


def verdict_report_sql() -> str:
    badge = case_of("v ->> 'verdict'", VERDICT_BADGES, q(OTHER_VERDICT_BADGE))
    row = (f"'| `' || (v ->> 'ruleId') || '` | `' || (v ->> 'line') || '` | ' || {badge} || ' | ' "
           "|| CAST(floor(CAST(v ->> 'confidence' AS DOUBLE) * 100 + 0.5) AS BIGINT) || '% | ' "
           "|| replace(v ->> 'reasoning', '|', '\\|') || ' |'")
    patch = (f"'`' || (v ->> 'ruleId') || '`, line ' || (v ->> 'line') "
             f"|| {q(chr(10) + '```suggestion' + chr(10))} || (v ->> 'suggestedPatch') "
             f"|| {q(chr(10) + '```' + chr(10))}")
    patched = "list_filter(analysis, lambda v: (v ->> 'suggestedPatch') <> '')"
    table_head = f"{VERDICTS_TITLE}\n\n{VERDICTS_HEAD}\n"
    return with_(
        REVIEWS,
        f"""SELECT scan_id, concat_ws({NL},
          {q(REVIEW_TITLE + chr(10) * 2)} || summary || {NL},
          CASE WHEN len(analysis) > 0 THEN {q(table_head)}
            || array_to_string(list_transform(analysis, lambda v: {row}), {NL}) || {NL} END,
          CASE WHEN len({patched}) > 0 THEN
            {q(PATCHES_TITLE + chr(10) * 2)}
            || array_to_string(list_transform({patched}, lambda v: {patch}), {NL}) END,
          CASE WHEN len(recommendations) > 0 THEN {q(ADVICE_TITLE + chr(10) * 2)}
            || array_to_string(list_transform(recommendations, lambda a: '* ' || a), {NL})
            || {NL} END) AS markdown
        FROM reviews""",
    )


def stream_sql() -> str:
    """The batch equivalent: each event once, its document's diff scanned as its own scan."""
    points = case_of("severity", {}, "0").replace("ELSE", " ".join(
        f"WHEN {q(s)} THEN {w}" for s, w in WEIGHTS.items()) + " ELSE")
    return with_(
        [*DIFF_SCAN,
         """day_rows AS (
           SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, severity
           FROM events JOIN documents d ON event_id % (SELECT max(doc_id) + 1 FROM documents) = d.doc_id
           JOIN diff_found f ON f.scan_id = d.source || '/' || d.doc_id
           WHERE NOT f.suppressed)"""],
        f"""SELECT day, count(*) AS findings, CAST(sum({points}) AS BIGINT) AS points,
              CAST(least({MAX_SCORE}, sum({points})) AS INTEGER) AS risk_score
            FROM day_rows GROUP BY day""",
    )


_TWICE = ["diffs2 AS (SELECT scan_id, diff_text || diff_text AS diff_text FROM diffs)"]
_OVERRIDES = case_of("rule_id", registered.OVERRIDES, "severity")
_DISABLED = ", ".join(q(r) for r in registered.DISABLED)
_WITHOUT_TESTS = [p for p in registered.IGNORES if not any(w in p for w in TEST_WORDS)]
_CUSTOM_SOURCE = ("(SELECT scan_id, file_path, content FROM files UNION ALL "
                  "SELECT * FROM page_files)")
_TIER = (f"CASE WHEN NOT expected_vulnerability THEN {q(NEGATIVE_TIER)} "
         + " ".join(f"WHEN category = {q(c)} THEN {q(n)}" for c, n in TIERS.items())
         + f" ELSE {q(OTHER_TIER)} END")

_BADGE = case_of("severity", BADGES)
_BAND = (f"CASE WHEN risk_score > {HIGH_RISK} THEN {q(BANDS['high'])} WHEN risk_score > "
         f"{MODERATE_RISK} THEN {q(BANDS['moderate'])} ELSE {q(BANDS['safe'])} END")


def document_sql(extra: Sequence[str], row: str, header: str, footer: str, scans: str = "totals") -> str:
    """Pieces of a document per scan: numbers by one window over each whole scan."""
    size = registered.PIECE
    return with_(
        [
            *SCAN_TOTALS,
            *extra,
            f"""numbered AS (
              SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY file, ro, xo, k) - 1 AS number,
                row_number() OVER (PARTITION BY scan_id, file ORDER BY ro, xo, k) AS in_file,
                count(*) OVER (PARTITION BY scan_id, file) AS n_file,
                count(*) OVER (PARTITION BY scan_id) AS n_scan
              FROM found WHERE NOT suppressed)""",
            f"""texts_of AS (
              SELECT scan_id, number // {size} + 1 AS piece, string_agg({row}, {NL} ORDER BY number) AS text
              FROM numbered GROUP BY ALL)""",
            f"""ends AS (SELECT *, (findings_count + {size - 1}) // {size} + 1 AS final FROM {scans})""",
            f"""documents_of AS (
              SELECT scan_id, 0 AS piece, {header} AS text FROM ends
              UNION ALL SELECT scan_id, final, {footer} FROM ends
              UNION ALL SELECT scan_id, piece, text FROM texts_of)""",
        ],
        """SELECT scan_id, CAST(d.piece AS INTEGER) AS piece, CAST(final + 1 AS INTEGER) AS n_pieces, d.text
           FROM documents_of d JOIN (SELECT scan_id, final FROM ends) USING (scan_id)""",
    )


def comma(row: str) -> str:
    return f"{row} || CASE WHEN number < n_scan - 1 THEN ',' ELSE '' END"


def markdown_sql() -> str:
    cell = "'| ' || line || ' | ' || {} || ' | ' || {} || ' | ' || {} || ' | ' || {} || ' |'"
    row = cell.format(_BADGE, "replace(title, '|', '\\|')", "replace(description, '|', '\\|')",
                      f"coalesce(replace(nullif(fix, ''), '|', '\\|'), {q(NO_FIX)})")
    head = f"{NL} || {filled(FILE_HEAD, 'file', 'n_file')} || {q(chr(10) * 2 + TABLE_HEAD + chr(10))}"
    header = f"""concat_ws({NL}, {q(REPORT_TITLE + chr(10))},
        CASE WHEN passed THEN {q(GATE_TEXT['passed'])} ELSE {q(GATE_TEXT['failed'])} END || {NL},
        '* ' || {filled(SCORE_TEXT, 'risk_score', _BAND)}, '* ' || {filled(FILES_TEXT, 'scanned_files')},
        '* ' || {filled(COUNTS_TEXT, 'critical', 'high', 'medium', 'low')} || {NL},
        {q(NOTES_TITLE + chr(10) * 2)} || notes || {NL},
        CASE WHEN findings_count > 0 THEN {q(FINDINGS_TITLE)} END)"""
    footer = f"{NL} || CASE WHEN findings_count > 0 THEN {q(FOUND_END)} ELSE {q(CLEAN_END)} END"
    notes = f"""noted AS (
      SELECT t.*, notes FROM totals t LEFT JOIN (
        SELECT source AS scan_id, {filled(registered.NOTE, 'count(*)', 'count(*) FILTER (WHERE toxic = 1)')} AS notes
        FROM labels JOIN documents USING (doc_id) GROUP BY source) USING (scan_id))"""
    return document_sql([notes], f"CASE WHEN in_file = 1 THEN {head} ELSE '' END || {row}", header, footer, "noted")


def json_sql() -> str:
    row = """regexp_replace(CAST(to_json({'rule_id': rule_id, 'title': title, 'description': description,
      'severity': severity, 'category': category, 'file': file, 'line': line, 'column': "column",
      'snippet': snippet, 'suggested_fix': fix, 'reference_url': url, 'entropy': entropy,
      'suppressed': suppressed, 'cwe_id': cwe, 'owasp_category': owasp}) AS VARCHAR),
      ',"(entropy|owasp_category)":null', '', 'g')"""
    header = """rtrim(CAST(to_json({'scanId': scan_id, 'totalFiles': scanned_files,
      'scannedFiles': scanned_files}) AS VARCHAR), '}') || ',"findings":['"""
    footer = """'],' || substr(CAST(to_json({'suppressedCount': suppressed_count, 'riskScore': risk_score,
      'summary': {'critical': critical, 'high': high, 'medium': medium, 'low': low, 'info': info},
      'passed': passed}) AS VARCHAR), 2)"""
    return document_sql([], comma(row), header, footer)


def sarif_sql() -> str:
    rules = [
        f"seen AS ({SARIF_RULES})",
        """rule_docs AS (
          SELECT scan_id, list({'id': rule_id, 'name': name, 'shortDescription': {'text': name},
            'fullDescription': {'text': description},
            'help': {'text': help_text, 'markdown': help_markdown}, 'helpUri': help_uri,
            'defaultConfiguration': {'level': level},
            'properties': {'tags': string_split(tags, ','), 'precision': 'high',
                           'problem': {'severity': severity}}} ORDER BY rule_id) AS rules
          FROM seen GROUP BY scan_id)""",
        "ruled AS (SELECT t.*, rules FROM totals t LEFT JOIN rule_docs USING (scan_id))",
    ]
    row = f"""CAST(to_json({{'ruleId': rule_id, 'level': {case_of('severity', LEVELS)},
      'message': {{'text': title || ': ' || description || CASE WHEN coalesce(fix, '') <> ''
         THEN ' (fix: ' || fix || ')' ELSE '' END}},
      'locations': [{{'physicalLocation': {{
        'artifactLocation': {{'uri': replace(file, '\\', '/'), 'uriBaseId': {q(SARIF_ROOT)}}},
        'region': {{'startLine': line, 'startColumn': "column",
                    'snippet': {{'text': snippet}}}}}}}}]}}) AS VARCHAR)"""
    header = f"""rtrim(CAST(to_json({{'$schema': {q(SARIF_SCHEMA)}, 'version': {q(SARIF_VERSION)}}}) AS VARCHAR), '}}')
      || ',"runs":[{{"tool":' || CAST(to_json({{'driver': {{'name': {q(TOOL)}, 'version': {q(VERSION)},
        'informationUri': {q(INFORMATION_URI)}, 'rules': coalesce(rules, [])}}}}) AS VARCHAR) || ',"results":['"""
    return document_sql(rules, comma(row), header, "']}]}'", "ruled")


ORACLES: dict[str, str] = {
    "corpus_files": with_(FILES, f"""SELECT scan_id, file_path,
        CAST(len(string_split(content, {NL})) AS INTEGER) AS n_lines,
        CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS digest FROM files"""),
    "prune_paths": with_(FILES, "SELECT scan_id, file_path FROM files WHERE NOT "
                         + pruned("file_path", CLI_DIRS, CLI_EXTENSIONS)),
    "prune_paths_ci": with_(FILES, "SELECT scan_id, file_path FROM files WHERE NOT "
                            + pruned("file_path", CI_DIRS, ())),
    "ignore_patterns": ignore_patterns(),
    "benchmark_cases": with_(CASE_VIEW, """SELECT id, category, expected_vulnerability,
        expected_rule_id, file_path, md5(code) AS digest FROM cases"""),
    "parse_verdicts": with_(REVIEWS, """SELECT scan_id, summary,
        CAST(len(analysis) AS INTEGER) AS n_verdicts,
        array_to_string(list_transform(analysis, lambda v: concat_ws(':', v ->> 'ruleId',
          v ->> 'line', v ->> 'verdict',
          CAST(round(CAST(v ->> 'confidence' AS DOUBLE) * 100) AS INTEGER), v ->> 'reasoning',
          v ->> 'suggestedPatch')), ';') AS verdicts,
        array_to_string(recommendations, ';') AS recommendations FROM reviews"""),
    "diff_blocks": with_([*DIFFS, *parsed_diffs()], """SELECT scan_id,
        CAST(block_ord AS INTEGER) AS block_ord, CAST(length(block) AS INTEGER) AS n_chars,
        md5(block) AS digest FROM blocks"""),
    "diff_files": with_([*DIFFS, *parsed_diffs()], """SELECT scan_id,
        CAST(block_ord AS INTEGER) AS block_ord, file FROM block_files"""),
    "diff_hunks": with_([*DIFFS, *parsed_diffs()], """SELECT scan_id,
        CAST(block_ord AS INTEGER) AS block_ord, file, CAST(hunk_ord AS INTEGER) AS hunk_ord,
        new_start FROM hunk_lines WHERE start IS NOT NULL"""),
    "diff_lines": with_([*DIFFS, *parsed_diffs()], """SELECT scan_id,
        CAST(block_ord AS INTEGER) AS block_ord, file, CAST(hunk_ord AS INTEGER) AS hunk_ord,
        CAST(line_ord AS INTEGER) AS line_ord, type, content, CAST(coalesce(new_line, 0) AS BIGINT) AS new_line
        FROM typed_lines"""),
    "hunk_text": with_([*DIFFS, *parsed_diffs()], """SELECT scan_id,
        CAST(block_ord AS INTEGER) AS block_ord, CAST(hunk_ord AS INTEGER) AS hunk_ord,
        md5(content) AS digest, CAST(len(added) AS INTEGER) AS n_lines,
        CAST(len(list_filter(added, lambda a: a)) AS INTEGER) AS n_added FROM hunks"""),
    "scan_diff": with_(DIFF_SCAN, f"SELECT {DIFF_SELECT} FROM diff_found"),
    "diff_dedupe": with_([*DIFFS, *_TWICE, *diff_scan("diffs2")],
                         f"""SELECT {DIFF_SELECT}, CAST(block_ord AS INTEGER) AS block_ord,
                         CAST(hunk_ord AS INTEGER) AS hunk_ord FROM diff_found"""),
    "budget_diff": budget(),
    "filter_ignored": with_(FILES, "SELECT scan_id, file_path FROM files WHERE NOT "
                            + ignored("file_path", registered.IGNORES)),
    "include_tests": with_(FILES, "SELECT scan_id, file_path FROM files WHERE NOT "
                           + ignored("file_path", _WITHOUT_TESTS)),
    "scan_with_ignore_files": ignore_files_sql(),
    "scan_configs": configs_sql(),
    "history_blocks": history_sql(),
    "findings_table": with_(SCAN, f"""SELECT {FINDING}, suppressed FROM found
        WHERE category = 'secret' OR category = 'mcp' AND NOT suppressed"""),
    "disable_rules": with_(SCAN, f"SELECT {FINDING} FROM found WHERE rule_id NOT IN ({_DISABLED})"),
    "scan_files": with_(SCAN, f"SELECT {FINDING}, entropy, suppressed FROM found"),
    "active_findings": with_(SCAN, f"SELECT {FINDING} FROM found WHERE NOT suppressed"),
    "apply_suppressions": with_(SCAN, 'SELECT scan_id, file, rule_id, line, "column", suppressed FROM found'),
    "join_verdicts": with_([*DIFF_SCAN, *REVIEWS, JUDGED], """SELECT scan_id, file, line, rule_id,
        verdict, round(confidence, 6) AS confidence, reasoning, suggested_patch FROM judged"""),
    "severity_overrides": with_(SCAN, f"""SELECT * EXCLUDE (severity), {_OVERRIDES} AS severity
        FROM (SELECT {FINDING} FROM found)"""),
    "enrich_cwe": with_(SCAN, """SELECT scan_id, file, line, "column", rule_id, cwe AS cwe_id,
        owasp AS owasp_category FROM found"""),
    "match_positions": positions_sql(),
    "shannon_entropy": f"SELECT page_id, round({entropy('url')}, 6) AS entropy FROM pages",
    "high_entropy_tokens": with_(TOKENS, f"""SELECT file_path, nth, token,
        round({entropy(cleaned('token'))}, 6) AS entropy,
        {high_entropy('token', DEFAULT_THRESHOLD)} AS is_high FROM tokens"""),
    "mask_secrets": with_(TOKENS, f"""SELECT file_path, nth, {masked('token')} AS masked,
        {replaced("('key=' || token || ' or ' || token)", 'token')} AS line FROM tokens"""),
    "call_args": with_(
        [*FILES, "texts AS MATERIALIZED (SELECT scan_id || '|' || file_path AS tid, scan_id, "
         "'any.ts' AS file, file_path, content FROM files)",
         raw_hits((CALL_RULE,)), CALLS.replace("{rules}", "0")],
        f"""SELECT file_path, CAST(length(b) - length(replace(b, {NL}, '')) + 1 AS INTEGER) AS line,
          CAST(length(list_extract(string_split(b, {NL}), -1)) + 1 AS INTEGER) AS "column", arguments
        FROM (SELECT *, substr(content, 1, CAST(off AS BIGINT)) AS b
              FROM raw_hits JOIN texts USING (tid) JOIN calls USING (tid, ro, xo, k))"""),
    "prompt_placeholders": with_(
        [*FILES, CHAT_FILES,
         f"""holders AS (SELECT file_path, unnest(ps) AS placeholder,
               CAST(unnest(range(0, len(ps))) AS INTEGER) AS nth
             FROM (SELECT file_path, regexp_extract_all(content, {q(PY_PLACEHOLDER)}, 1) AS ps
                   FROM (SELECT file_path, content FROM files UNION ALL
                         SELECT file_path, content FROM chat_files)
                   WHERE regexp_matches(file_path, '(?i)\\.py\\z')
                   UNION ALL
                   SELECT file_path, regexp_extract_all(content, {q(JS_PLACEHOLDER)}, 1) AS ps
                   FROM files WHERE NOT regexp_matches(file_path, '(?i)\\.py\\z')))"""],
        f"""SELECT file_path, nth, placeholder,
          regexp_matches(trim(placeholder, {SPACES}), {q(re2_regex(SAFE_EXPRESSION))}) AS safe,
          {untrusted('placeholder')} AS untrusted FROM holders"""),
    "suppressions": with_([*FILES, texts_from("files", ()), *suppression_ctes()],
                          """SELECT scan_id, file, CAST(line AS INTEGER) AS line, rule_id
                          FROM suppressed_rows"""),
    "block_suppressions": with_([*FILES, texts_from("files", ()), *suppression_ctes()],
                                """SELECT scan_id, file, CAST(line AS INTEGER) AS line, rule_id
                                FROM block_rows"""),
    **{f"rule_{r.rule_id.lower().replace('-', '_')}": rule_sql(r) for r in RULES},
    "custom_rule_lookaround": lookaround_sql(),
    "custom_rule_function": with_(
        [*FILES, texts_from("files", registered.IGNORES), *function_ctes()],
        f"SELECT {FINDING}, suppressed FROM by_function",
    ),
    "custom_rule_diff": function_diff_sql(),
    "custom_rule_generic_token": with_(
        [*FILES, PAGE_FILES, texts_from(_CUSTOM_SOURCE),
         *finding_ctes((registered.GENERIC_TOKEN,))],
        'SELECT scan_id, file, line, "column", snippet, entropy FROM found'),
    "severity_summary": with_(SCAN_TOTALS,
                              "SELECT scan_id, critical, high, medium, low, info FROM totals"),
    "risk_score": with_(SCAN_TOTALS, "SELECT scan_id, risk_score FROM totals"),
    "threshold_gate": gate_sql(),
    "scan_result": with_(SCAN_TOTALS, f"SELECT {TOTAL_COLUMNS} FROM totals"),
    "scan_result_diff": with_(DIFF_TOTALS, f"SELECT {TOTAL_COLUMNS} FROM totals"),
    "risk_band": with_(DIFF_TOTALS, f"""SELECT scan_id, risk_score,
        CASE WHEN risk_score > {HIGH_RISK} THEN 'high' WHEN risk_score > {MODERATE_RISK}
          THEN 'moderate' ELSE 'safe' END AS band FROM totals"""),
    "findings_by_file": with_(SCAN, """SELECT scan_id, file, count(*) AS issues,
        string_agg(rule_id || ':' || line || ':' || "column", ',' ORDER BY ro, xo, k) AS findings
        FROM found WHERE NOT suppressed GROUP BY scan_id, file"""),
    "detector_confusion": with_(DETECTED, f"SELECT {MATRIX} FROM detected"),
    "detector_tiers": with_(DETECTED, f"""SELECT *, fp = 0 AND fn = 0 AS passed FROM (
        SELECT {_TIER} AS tier, {MATRIX} FROM detected GROUP BY 1
        UNION ALL SELECT {q(ALL_TIERS)}, {MATRIX} FROM detected)"""),
    "detector_metrics": with_(DETECTED, f"""SELECT total, tp, fp, tn, fn, round(p, 1) AS "precision",
        round(r, 1) AS recall, round(f, 1) AS f1, round(f, 1) >= {PASSING_F1} AS passed
      FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (
        SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) * 100 ELSE 100.0 END AS p,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) * 100 ELSE 100.0 END AS r
        FROM (SELECT {MATRIX} FROM detected)))"""),
    "review_gate": review_gate_sql(),
    "sarif_results": with_(SCAN, f"""SELECT scan_id, rule_id, {case_of('severity', LEVELS)} AS level,
        title || ': ' || description || CASE WHEN coalesce(fix, '') <> ''
          THEN ' (fix: ' || fix || ')' ELSE '' END AS message,
        replace(file, '\\', '/') AS uri, line AS start_line, "column" AS start_column,
        nullif(snippet, '') AS snippet FROM found WHERE NOT suppressed"""),
    "sarif_rules": with_(SCAN, SARIF_RULES),
    "annotations": with_(SCAN, """SELECT scan_id,
        CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level, file,
        line AS start_line, "column" AS start_column, '[' || rule_id || '] ' || title AS title,
        description || CASE WHEN coalesce(fix, '') <> '' THEN ' | Fix: ' || fix
          ELSE '' END AS message FROM found WHERE NOT suppressed"""),
    "review_comments": with_(SCAN, f"""SELECT scan_id, replace(file, '\\', '/') AS path, line,
        {COMMENT_BODY} AS body, 'RIGHT' AS side FROM found WHERE NOT suppressed"""),
    "verdict_comments": with_([*DIFF_SCAN, *REVIEWS, JUDGED], f"""SELECT scan_id,
        replace(file, '\\', '/') AS path, line,
        CASE WHEN verdict IS NULL THEN {COMMENT_BODY} ELSE {JUDGED_BODY} END AS body
        FROM judged WHERE NOT suppressed AND coalesce(verdict, '') <> {q(FALSE_POSITIVE)}"""),
    "top_comments": with_(SCAN, f"""SELECT scan_id, CAST(nth AS INTEGER) AS nth, file, rule_id, line
        FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY file, ro, xo, k) AS nth
              FROM found WHERE NOT suppressed) WHERE nth <= {MAX_COMMENTS}"""),
    "top_verdict_comments": with_([*DIFF_SCAN, *REVIEWS, JUDGED], f"""SELECT scan_id,
        CAST(nth AS INTEGER) AS nth, path, line, body
        FROM (SELECT scan_id, replace(file, '\\', '/') AS path, line,
                CASE WHEN verdict IS NULL THEN {COMMENT_BODY} ELSE {JUDGED_BODY} END AS body,
                row_number() OVER (PARTITION BY scan_id
                  ORDER BY replace(file, '\\', '/'), line, ro) AS nth
              FROM judged WHERE NOT suppressed AND coalesce(verdict, '') <> {q(FALSE_POSITIVE)})
        WHERE nth <= {MAX_COMMENTS}"""),
    "verdict_report": verdict_report_sql(),
    "json_report": json_sql(),
    "markdown_report": markdown_sql(),
    "sarif_report": sarif_sql(),
    "stream_scan_diffs": stream_sql(),
}
