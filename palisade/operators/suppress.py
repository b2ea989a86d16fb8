"""Inline suppression directives.

Read from ``//`` and ``/*`` comments, at most one of each kind per line:

* ``/* P-disable [RULE] */`` opens a block on its own line, ``/* P-enable */``
  closes it (the closing line is outside; close wins on a shared line; a later
  open replaces the rule);
* ``// P-ignore [RULE]`` covers its line;
* ``// P-disable-next-line [RULE]`` covers the next line, unless that line lies in
  a block: a block line's rules replace what was there.

An id after colon *and* space (``ignore: RULE``) is not read and means "all rules";
``strict_ids`` reads it. Everything is row-local: the few directive lines travel
with the file's findings as a small array, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import SPACE_CLASS, let, lines_of

ANY_RULE = "*"
_SPACE = f"[{SPACE_CLASS}]"


def directive_patterns(prefix: str, strict_ids: bool = False) -> dict[str, str]:
    separator = rf"(?::{_SPACE}*|{_SPACE}+)?" if strict_ids else rf"(?::|{_SPACE}+)?"
    return {
        "open": rf"/\*{_SPACE}*{prefix}-disable(?:{_SPACE}+([\w-]+))?{_SPACE}*\*/",
        "ignore": rf"(?://|/\*){_SPACE}*{prefix}-ignore{separator}([\w-]+)?",
        "next": rf"(?://|/\*){_SPACE}*{prefix}-disable-next-line{separator}([\w-]+)?",
    }


def _named(line: Column, pattern: str) -> Column:
    rule = F.regexp_extract(line, pattern, 1)
    found = F.rlike(line, F.lit(pattern))
    return F.when(found & (rule == ""), F.lit(ANY_RULE)).when(found, rule)


def directives(content: Column, prefix: str, strict_ids: bool = False) -> Column:
    """``array<struct<line,opens,block_rule,ignore_rule,next_rule>>`` in line order."""
    patterns = directive_patterns(prefix, strict_ids)
    ddl = "struct<line:int,opens:boolean,block_rule:string,ignore_rule:string,next_rule:string>"

    def parse(x: Column) -> Column:
        line = x["text"]
        opened = _named(line, patterns["open"])
        closed = F.contains(line, F.lit(f"/* {prefix}-enable */"))
        opens = F.when(closed, F.lit(False)).when(opened.isNotNull(), F.lit(True))
        return F.struct(
            x["line"].alias("line"),
            opens.alias("opens"),
            F.when(opens, opened).alias("block_rule"),
            _named(line, patterns["ignore"]).alias("ignore_rule"),
            _named(line, patterns["next"]).alias("next_rule"),
        )

    numbered = F.transform(
        lines_of(content), lambda t, i: F.struct(t.alias("text"), (i + 1).alias("line"))
    )
    marked = F.filter(numbered, lambda x: F.contains(x["text"], F.lit(prefix)))
    parsed = F.filter(
        F.transform(marked, parse),
        lambda d: F.coalesce(d["opens"].cast("string"), d["ignore_rule"], d["next_rule"])
        .isNotNull(),
    )
    return F.when(F.contains(content, F.lit(prefix)), parsed).otherwise(
        F.array().cast(f"array<{ddl}>")
    )


def is_suppressed(found: Column, line: Column, rule_id: Column) -> Column:
    def covers(rule: Column) -> Column:
        return F.coalesce(rule.isin(ANY_RULE) | (rule == rule_id), F.lit(False))

    def decide(block: Column) -> Column:
        inside = F.coalesce(block["opens"], F.lit(False))
        same = F.exists(found, lambda d: (d["line"] == line) & covers(d["ignore_rule"]))
        above = F.exists(found, lambda d: (d["line"] == line - 1) & covers(d["next_rule"]))
        return same | (inside & covers(block["block_rule"])) | (~inside & above)

    last = F.try_element_at(
        F.filter(found, lambda d: d["opens"].isNotNull() & (d["line"] <= line)), F.lit(-1)
    )
    return F.when(F.size(found) == 0, F.lit(False)).otherwise(let(last, decide))


def _block_rows(found: Column, n_lines: Column) -> Column:
    def spans(events: Column) -> Column:
        nexts = F.concat(
            F.transform(F.slice(events, F.lit(2), F.size(events)), lambda e: e["line"]),
            F.array(n_lines + 1),
        )
        return F.flatten(
            F.transform(
                F.filter(
                    F.zip_with(
                        events,
                        F.slice(nexts, F.lit(1), F.size(events)),
                        lambda e, n: F.struct(
                            e["opens"].alias("opens"), e["line"].alias("a"), (n - 1).alias("b"),
                            e["block_rule"].alias("rule_id"),
                        ),
                    ),
                    lambda s: s["opens"] & (s["b"] >= s["a"]),
                ),
                lambda s: F.transform(
                    F.sequence(s["a"], s["b"]),
                    lambda n: F.struct(n.alias("line"), s["rule_id"].alias("rule_id")),
                ),
            )
        )

    return let(F.filter(found, lambda d: d["opens"].isNotNull()), spans)


def block_suppressions(files: DataFrame, prefix: str, strict_ids: bool = False) -> DataFrame:
    """One row per line inside a disable block."""
    parsed = files.where(F.contains("content", F.lit(prefix))).select(
        "scan_id",
        F.col("file_path").alias("file"),
        directives(F.col("content"), prefix, strict_ids).alias("found"),
        F.size(lines_of(F.col("content"))).alias("n_lines"),
    )
    return parsed.select(
        "scan_id", "file", F.inline(_block_rows(F.col("found"), F.col("n_lines")))
    )


def suppressions(files: DataFrame, prefix: str, strict_ids: bool = False) -> DataFrame:
    """Effective suppressed rule ids per line (``*`` = all)."""
    parsed = files.where(F.contains("content", F.lit(prefix))).select(
        "scan_id",
        F.col("file_path").alias("file"),
        directives(F.col("content"), prefix, strict_ids).alias("found"),
        F.size(lines_of(F.col("content"))).alias("n_lines"),
    )
    found = F.col("found")

    def in_block(line: Column) -> Column:
        last = F.try_element_at(
            F.filter(found, lambda d: d["opens"].isNotNull() & (d["line"] <= line)), F.lit(-1)
        )
        return F.coalesce(last["opens"], F.lit(False))

    same = F.transform(
        F.filter(found, lambda d: d["ignore_rule"].isNotNull()),
        lambda d: F.struct(d["line"].alias("line"), d["ignore_rule"].alias("rule_id")),
    )
    above = F.transform(
        F.filter(found, lambda d: d["next_rule"].isNotNull() & ~in_block(d["line"] + 1)),
        lambda d: F.struct((d["line"] + 1).alias("line"), d["next_rule"].alias("rule_id")),
    )
    rows = F.array_distinct(F.concat(_block_rows(found, F.col("n_lines")), same, above))
    return parsed.select("scan_id", "file", F.inline(rows))
