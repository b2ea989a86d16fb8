"""Text functions against plain Python on small fixtures."""

import math
import random
import re
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from palisade.functions.calls import call_arguments
from palisade.functions.entropy import is_high_entropy, shannon_entropy
from palisade.functions.masking import mask, mask_first
from palisade.functions.paths import clean_patterns, ignored_paths, is_ignored, is_pruned
from palisade.functions.positions import (
    END, MARK, group_texts, mark_matches, marker_template, match_positions, matched_texts,
    pieces_from_matches, without_groups,
)
from palisade.functions.prompts import is_safe_expression, is_untrusted_expression
from palisade.functions.text import (
    CHUNK, SPACE_CHARS, java_regex, re2_regex, running_sums, trim, without_lookarounds,
)


def entropy(text):
    n = len(text.encode("utf-16-le")) // 2
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if text else 0.0


def test_entropy(spark):
    openai = "sk-" + "proj-aB9xK1mQ8zLp7vW2rT4yU6iO0eN3sD5fG1hJ"
    texts = ["", "a" * 32, openai, "a😀b", "é" * 3 + "x", "abcdefgh" * 4]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(shannon_entropy(F.col("t"))).collect()]
    assert got == pytest.approx([entropy(t) for t in texts])
    assert got[0] == 0 and got[1] == 0 and got[2] > 4.0


def test_high_entropy(spark):
    cases = {
        "sk-" + "proj-aB9xK1mQ8zLp7vW2rT4yU6iO0eN3sD5fG1hJ": True,
        "sk-" + "proj-" + "1" * 32: False,
        "sk-" + "proj-" + "abcdefgh" * 4: False,
        "aB9xK1mQ8z": False,
        "sk-" + "proj-aB9xK1": False,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = [r[0] for r in rows.select(is_high_entropy(F.col("t"))).collect()]
    assert got == list(cases.values())


def brute_positions(text, pattern):
    out = []
    for m in re.finditer(pattern, text):
        lines = re.split(r"\r?\n", text[: m.start()])
        line = re.split(r"\r?\n", text)[len(lines) - 1]
        out.append((len(lines), len(lines[-1]) + 1, line.strip(SPACE_CHARS), m.group()))
    return out


def flat(found):
    return [(m.line, m.column, found.lines[m.nth].snippet, m.text) for m in found.matches]


@pytest.mark.parametrize("pattern", [r"ab+", r"b\s*a", r"\n", r"[^c]{3}", r"a(b|\r?\n)?"])
def test_positions_match_brute_force(spark, pattern):
    rng = random.Random(pattern)
    texts = ["", "ab", "\n\nab", "ab\r\nab", "é ab", "😀ab ab"]
    texts += ["".join(rng.choices("aabbc \n\r\té", k=60)) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    # Python's \s knows no U+FEFF and the texts hold none, so the plain pattern serves both
    hits = match_positions(F.col("t"), F.lit(java_regex(pattern, ignore_case=False)))
    got = {r.i: flat(r.h) for r in rows.select("i", hits.alias("h")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_positions(text, pattern), repr(text)


def test_positions_survive_the_marker_characters(spark):
    text = f"x{MARK}\n{END}ab {MARK}ab"
    rows = spark.createDataFrame([(text,)], "t string")
    hits = rows.select(match_positions(F.col("t"), F.lit("ab"))).first()[0]
    assert [(h.line, h.column, h.text) for h in hits.matches] == [(2, 2, "ab"), (2, 6, "ab")]


def test_very_many_matches_on_one_line(spark):
    """Each line is held once and sums are taken in chunks: no growing array, no repeated line."""
    n = 100_000
    text = spark.range(1).select(F.repeat(F.lit("abc 12 "), n).alias("t"))
    hits = match_positions(F.col("t"), F.lit(r"\d+"))
    rows = text.select(F.posexplode(hits["matches"]).alias("nth", "m")).select(
        "nth", "m.line", "m.column", "m.nth"
    )
    wrong = rows.toDF("nth", "line", "column", "at").where("line != 1 or at != 0 or column != nth * 7 + 5")
    assert wrong.count() == 0
    assert text.select(F.size(hits["matches"]), F.size(hits["lines"])).first() == (n, 1)


def test_running_sums(spark):
    sizes = [0, 1, 2, CHUNK, CHUNK + 1, 3 * CHUNK, CHUNK * CHUNK + 5]
    rng = random.Random(1)
    lists = [[rng.randrange(9) for _ in range(n)] for n in sizes]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, a array<int>")
    got = {r.i: r.s for r in rows.select("i", running_sums(F.col("a")).alias("s")).collect()}
    for i, values in enumerate(lists):
        assert got[i] == [0, *accumulate(values)][: len(values)]


def test_group_texts_in_lookarounds(spark):
    text = "key=abc; key=def, <key=g\nh>"
    cases = {
        r"key=([a-z]+)(?=;)": ["abc"],
        r"(?<=<key=)([a-z]\s[a-z])": ["g\nh"],
        r"key(?==((\w)\w+))": ["abca", "defd"],
        r"(key)=(?!abc)(\w)": ["keyd", "keyg"],
    }
    for pattern, tokens in cases.items():
        groups = tuple(range(1, re.compile(pattern).groups + 1))
        marked = mark_matches(F.lit(text), F.lit(java_regex(pattern)), F.lit(marker_template(groups=groups)))
        row = spark.range(1).select(group_texts(marked), without_groups(marked)).first()
        assert row[0] == tokens
        assert row[1].replace(MARK, "").replace(END, "") == text


def brute_arguments(text, start):
    depth, quote = 0, None
    for i in range(start, len(text)):
        ch, prev = text[i], text[i - 1] if i else ""
        if quote:
            if ch == quote and prev != "\\":
                quote = None
        elif ch in "\"'`":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return text[start + 1 : i]
    return text[start + 1 :]


def test_call_arguments_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["f(a)", "f(", "x", "f(')')", "f(f(1), 2) f(3)", "f('it\\'s (' ) )"]
    texts += ["".join(rng.choices(["f(", "(", ")", "'", '"', "`", "\\", "a", " "], k=40))
              for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    marked = mark_matches(F.col("t"), F.lit(r"f\("))
    got = rows.select(
        "i", call_arguments(pieces_from_matches(marked), matched_texts(marked)).alias("a")
    ).collect()
    for r in got:
        text = texts[r.i]
        want = [brute_arguments(text, m.end() - 1) for m in re.finditer(r"f\(", text)]
        assert r.a == want, repr(text)


def test_dialects(spark):
    rows = spark.createDataFrame([("éexec(", "a b")], "t string, s string")
    java = rows.select(
        F.rlike("t", F.lit(java_regex(r"\bexec\("))), F.rlike("s", F.lit(java_regex(r"a\sb")))
    ).first()
    assert tuple(java) == (True, True)  # ASCII boundary and Unicode spaces, as in JavaScript
    assert re2_regex(r"(?:a)++[\s\S]\b", False) == r"(?:a)+[\s\S]\b"
    java = rows.select(
        F.rlike(F.lit("zq\u00a0x"), F.lit(java_regex(r"zq\Sx"))), F.rlike(F.lit("zq\u00e9x"), F.lit(java_regex(r"zq\Sx"))),
        F.rlike(F.lit("\u00e9\u00e9"), F.lit(java_regex("\u00e9\\B\u00e9"))), F.rlike(F.lit("ab"), F.lit(java_regex(r"a\Bb"))),
        F.rlike(F.lit("a\u00e9"), F.lit(java_regex("a\\B\u00e9"))),
    ).first()
    assert tuple(java) == (False, True, True, True, False)
    with pytest.raises(ValueError, match="inside a character class"):
        java_regex(r"[a\S]")
    for word in (r"\d{3,}", r"[A-Z0-9_]+", r"(?:ab|\d)x", r"(a|(?:b|[c-e]))", r"\w"):
        assert java_regex(r"\b" + word).startswith(r"(?i)(?<!\w)"), word
    for other in (r"\d*", r"(?:a|<b)", r"[^a]", r"(?:a)?", r"(?=a)b", r"-", r"[a-z.]"):
        assert java_regex(r"\b" + other).startswith(r"(?i)(?:(?<!\w)(?=\w)"), other
    assert without_lookarounds(r"(?<=a[)])b(?=c(d|e))\(?!x(?!y)(z)") == r"b\(?!x(z)"
    assert rows.select(trim(F.lit("﻿  x \t"))).first()[0] == "x"


def test_masking(spark):
    rows = spark.createDataFrame([("ghp_123456789", "short")], "long string, short string")
    line = F.concat(F.lit("a="), "long", F.lit(" b="), "long")
    got = rows.select(
        mask(F.col("long")), mask(F.col("short")),
        mask_first(line, F.col("long"), mask(F.col("long"))),
        mask_first(F.lit("none"), F.col("long"), F.lit("?")),
    ).first()
    assert tuple(got) == (
        "ghp_...6789", "***", "a=ghp_...6789 b=ghp_123456789", "none",
    )


def test_prompt_expressions(spark):
    cases = {
        "user_id": (True, False), " req.user.id ": (True, False), "userRole": (True, False),
        "req.body.x": (False, True), "userQuery": (False, True), "total": (False, False),
        "id + 1": (False, False), "user_prompt": (False, True), "messageCount": (False, True),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = rows.select(is_safe_expression(F.col("t")), is_untrusted_expression(F.col("t"))).collect()
    assert [tuple(r) for r in got] == list(cases.values())


def test_ignore_patterns(spark):
    patterns = ["dist/**", "vendor/", "*.log", ".\\tmp", "", "  docs "]
    cases = {
        "dist": True, "dist/a.js": True, "pkg/dist/a.js": True, "pkg/dist": True,
        "distance/a.js": False, "./vendor/x": True, "x\\vendor\\y": True, "a.log": True,
        "a.log/b": False, "tmp/x": True, "docs/x": True, "mydocs/x": False, "src/a.ts": False,
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    got = [r[0] for r in rows.select(is_ignored(F.col("p"), patterns)).collect()]
    assert dict(zip(cases, got)) == cases


def brute_ignored(path, patterns):
    norm = path.replace("\\", "/")
    norm = norm[2:] if norm.startswith("./") else norm
    for pattern in patterns:
        clean = pattern.replace("\\", "/")
        clean = (clean[2:] if clean.startswith("./") else clean).strip()
        if not clean:
            continue
        if clean.startswith("*.") and norm.endswith(clean[1:]):
            return True
        clean = re.sub(r"/$", "", re.sub(r"/\*\*$", "", clean))
        if (norm == clean or norm.startswith(clean + "/") or f"/{clean}/" in norm
                or norm.endswith("/" + clean)):
            return True
    return False


def test_ignore_patterns_match_brute_force(spark):
    rng = random.Random(11)
    parts = ["a", "b", "ab", "/", "/", ".", "*", "**", "\\", " ", "a.b"]
    for _ in range(12):
        patterns = ["".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(4)]
        paths = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(60)] + ["", "/", "a//b"]
        rows = spark.createDataFrame([(p,) for p in paths], "p string")
        got = [r[0] for r in rows.select(is_ignored(F.col("p"), patterns)).collect()]
        assert got == [brute_ignored(p, patterns) for p in paths], patterns


def test_pruning(spark):
    cases = {
        "src/a.ts": (False, False), "node_modules/a.ts": (True, True), ".hidden/a": (True, True),
        "x/.env": (False, False), "benchmark/a.ts": (True, False), "a/logo.PNG": (True, False),
        "a/benchmark": (False, False), ".png": (False, False), "rules/a.ts": (False, False),
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    got = rows.select(is_pruned(F.col("p")), is_pruned(F.col("p"), "ci")).collect()
    assert {p: tuple(r) for p, r in zip(cases, got)} == cases
    with pytest.raises(ValueError):
        is_pruned(F.col("p"), "other")


def test_word_boundaries_hold_before_any_character(spark):
    frame = spark.createDataFrame([("let password = 1;",), ("passwords = 1",), ("a.b",)], "t string")
    for pattern, want in ((r"\bpassword\b\s*=", [True, False, False]), (r"(\bpassword\b)\s*=", [True, False, False]),
                          (r"a\b\.\bb\b", [False, False, True])):
        assert [r[0] for r in frame.select(frame.t.rlike(java_regex(pattern))).collect()] == want


def brute_ignored(path, patterns):
    norm = path.replace("\\", "/").removeprefix("./")
    for pattern in clean_patterns(patterns):
        folder = pattern.removesuffix("/**").removesuffix("/")
        if pattern.startswith("*.") and norm.endswith(pattern[1:]):
            return True
        if norm == folder or norm.startswith(folder + "/") or f"/{folder}/" in norm or norm.endswith("/" + folder):
            return True
    return False


def test_ignored_paths_equal_the_column_and_brute_force(spark):
    rng = random.Random(9)
    names = ["a", "b", "src", "x.log", "a.min.js", "", ".", "*.log", "b/**", "..", "src "]
    paths = sorted({"/".join(rng.choices(names, k=rng.randrange(1, 5))) for _ in range(300)} | {"./a\\b", "", "/", "a//b"})
    lists = {
        scan: rng.sample(["a", "b/", "src/**", "*.log", "*.js", "*.", "/a", "/", "/**", "a/b", "./src", "a\\b", " b ", "x.log", "*.log/", "b/**/", "//"], 3)
        for scan in "pqrstuvw"
    }
    files = spark.createDataFrame([(s, p) for s in lists for p in paths], "scan_id string, file_path string")
    patterns = spark.createDataFrame([(s, p) for s, own in lists.items() for p in own], "scan_id string, pattern string")
    got = {tuple(r) for r in ignored_paths(files, patterns).collect()}
    assert got == {(s, p) for s, own in lists.items() for p in paths if brute_ignored(p, own)}
    for scan, own in lists.items():
        column = files.where(F.col("scan_id") == scan).where(is_ignored(F.col("file_path"), own))
        assert {r.file_path for r in column.collect()} == {p for s, p in got if s == scan}
    empty = patterns.where("false")
    assert ignored_paths(files, empty).count() == 0
