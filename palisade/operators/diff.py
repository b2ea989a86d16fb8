"""Unified diffs: blocks, hunks, lines, added-line findings, budgeting.

A diff is one row. Hunks are cut out with regexes inside the row, and new-side
line numbers are the hunk's start plus the index among its new-side lines, so
nothing is windowed or shuffled before the findings exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.blocks import BLOCK_START, FILE_MARKER, block_array
from palisade.functions.paths import is_ignored
from palisade.functions.text import LINE_BREAK, let, lines_of, trim
from palisade.operators.scan import FINDING_COLUMNS, all_hits
from palisade.operators.suppress import is_suppressed
from palisade.settings import ScanConfig

# Unified diff syntax and the budgeting texts.
NO_FILE = "/dev/null"
DEFAULT_BUDGET = 32000
LEAST_PARTIAL = 500
TRUNCATED = "\n\n[... Remaining hunks truncated for token budget ...]"
OMITTED = "\n\n[... Additional non-critical files omitted for token budget ...]"

# The first character comes before the test of what precedes it: the regex engine then
# skips from candidate to candidate instead of looking behind at every position.
_FILE_NAME = r"\+(?<=\A\+|\n\+)\+\+ (?:b/)?([^\n]*?)\r?(?:\n|\z)"
_HUNK_HEADER = r"@(?<=\A@|\n@)@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def _named(name: Column) -> Column:
    return (name != "") & (name != NO_FILE)


def diff_blocks(diffs: DataFrame, diff_text: str = "diff_text", outer: bool = False) -> DataFrame:
    expand = F.inline_outer if outer else F.inline
    rest = [c for c in diffs.columns if c != diff_text]
    return diffs.select(*rest, expand(block_array(F.col(diff_text))))


def diff_files(diffs: DataFrame) -> DataFrame:
    """Blocks that name a file on the new side; deletions and binaries drop out."""
    named = diff_blocks(diffs).withColumn("file", F.regexp_extract("block", _FILE_NAME, 1))
    return named.where(_named(F.col("file")))


def _is_new(line: Column) -> Column:
    plus = F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++"))
    return plus | F.startswith(line, F.lit(" "))


def _is_removed(line: Column) -> Column:
    return F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---"))


def _hunk_array(block: Column) -> Column:
    """``array<struct<hunk_ord,new_start,lines>>``; lines still carry their prefix."""
    bodies = F.split(block, _HUNK_HEADER + r"[^\n]*", -1)
    starts = F.regexp_extract_all(block, F.lit(_HUNK_HEADER), F.lit(1))
    zipped = F.zip_with(
        starts,
        F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))),
        lambda s, b: F.struct(s.alias("start"), b.alias("body")),
    )
    return F.transform(
        zipped,
        lambda z, i: F.struct(
            (i + 1).alias("hunk_ord"),
            z["start"].cast("bigint").alias("new_start"),
            lines_of(z["body"]).alias("lines"),
        ),
    )


def diff_hunks(files: DataFrame, outer: bool = False) -> DataFrame:
    """Explode the hunks of ``diff_files`` rows."""
    expand = F.inline_outer if outer else F.inline
    rest = [c for c in files.columns if c != "block"]
    return files.select(*rest, expand(_hunk_array(F.col("block"))))


def diff_lines(hunks: DataFrame) -> DataFrame:
    """Every added, removed and context line with its new-side number."""
    numbered = F.transform(
        F.col("lines"), lambda t, i: F.struct(i.alias("line_ord"), t.alias("raw"))
    )

    def entry(x: Column, kind: Column, new_line: Column) -> Column:
        return F.struct(
            x["line_ord"].alias("line_ord"),
            kind.alias("type"),
            F.substr(x["raw"], F.lit(2)).alias("content"),
            new_line.cast("bigint").alias("new_line"),
        )

    new_side = F.transform(
        F.filter(numbered, lambda x: _is_new(x["raw"])),
        lambda x, i: entry(
            x,
            F.when(F.startswith(x["raw"], F.lit("+")), F.lit("add")).otherwise(F.lit("context")),
            F.col("new_start") + i,
        ),
    )
    removed = F.transform(
        F.filter(numbered, lambda x: _is_removed(x["raw"])),
        lambda x: entry(x, F.lit("del"), F.lit(None)),
    )
    rest = [c for c in hunks.columns if c not in ("lines", "new_start")]
    return hunks.select(*rest, F.inline(F.concat(new_side, removed)))


def hunk_text(hunks: DataFrame, outer: bool = False) -> DataFrame:
    """New side of each hunk as one text, with a flag per line: added or context."""
    new_side = hunks.withColumn("_new", F.filter("lines", _is_new))
    if not outer:
        new_side = new_side.where(F.size("_new") > 0)
    rest = [c for c in hunks.columns if c != "lines"]
    return new_side.select(
        *rest,
        F.array_join(F.transform("_new", lambda t: F.substr(t, F.lit(2))), "\n").alias("content"),
        F.transform("_new", lambda t: F.startswith(t, F.lit("+"))).alias("added"),
    )


def raw_diff_findings(
    diffs: DataFrame, config: ScanConfig | None = None, keep_clean: bool = False
) -> DataFrame:
    """Findings on added lines, before de-duplication.

    Directives are read per hunk. A match counts if the line it starts on was added.
    ``keep_clean`` keeps a null row for what yields nothing (a diff, a file, a hunk), so
    that files and clean diffs can be counted in the same pass.
    """
    blocks = diff_blocks(diffs.select("scan_id", "diff_text"), outer=keep_clean)
    return raw_block_findings(blocks, config, keep_clean)


def raw_block_findings(
    blocks: DataFrame, config: ScanConfig | None = None, keep_clean: bool = False
) -> DataFrame:
    """``raw_diff_findings`` from ``blocks(scan_id, block_ord, block)``."""
    config = config or ScanConfig()
    blocks = blocks.select("scan_id", "block_ord", "block").withColumn(
        "file", F.regexp_extract("block", _FILE_NAME, 1)
    )
    scanned = _named(F.col("file")) & ~is_ignored(F.col("file"), config.ignore_paths)
    if keep_clean:
        named = blocks.select(
            "scan_id",
            "block_ord",
            F.when(scanned, F.col("file")).alias("file"),
            F.when(scanned, F.col("block")).alias("block"),
        )
    else:
        named = blocks.where(scanned)
    texts = hunk_text(diff_hunks(named, outer=keep_clean), outer=keep_clean)
    keep = ("scan_id", "file", "block_ord", "hunk_ord", "new_start", "added")
    hits = all_hits(texts, config, "content", "file", keep, keep_clean).withColumn("_on_added", F.coalesce(F.get("added", F.col("line") - 1), F.lit(False)))
    if not keep_clean:
        hits = hits.where(F.col("_on_added"))
    flags = hits.withColumn(
        "suppressed", is_suppressed(F.col("_found"), F.col("line"), F.col("rule_id"))
    ).withColumn("line", (F.col("new_start") + F.col("line") - 1).cast("int"))
    kept = ("scan_id", "file", "block_ord", "hunk_ord")
    rest = [c for c in FINDING_COLUMNS if c not in kept]
    return flags.select(
        *kept, *[F.when(F.col("_on_added"), F.col(c)).alias(c) for c in rest]
    ).select("block_ord", "hunk_ord", *FINDING_COLUMNS)


def dedupe_findings(found: DataFrame) -> DataFrame:
    """First finding per (scan, file, line, rule) in diff order.

    ``min`` of a struct led by the order columns: partial aggregation applies, only
    findings (never text) are shuffled, and the choice is deterministic.
    """
    order = ("block_ord", "hunk_ord", "rule_ord", "match_ord")
    keys = ("scan_id", "file", "line", "rule_id")
    payload = [c for c in found.columns if c not in (*order, *keys)]
    first = found.groupBy(*keys).agg(F.min(F.struct(*order, *payload)).alias("first"))
    return first.select(*keys, "first.*")


def scan_diff(
    diffs: DataFrame, config: ScanConfig | None = None, keep_clean: bool = False
) -> DataFrame:
    """Findings a diff introduces; ``line`` is the line in the new file."""
    return dedupe_findings(raw_diff_findings(diffs, config, keep_clean))


def scan_blocks(
    blocks: DataFrame, config: ScanConfig | None = None, keep_clean: bool = False
) -> DataFrame:
    """``scan_diff`` of blocks, as ``read_history`` gives them."""
    return dedupe_findings(raw_block_findings(blocks, config, keep_clean))


def _budgeted(diff_text: Column, targets: Column, limit: int) -> Column:
    """The whole walk in one row: targeted blocks, then the others, until one overflows."""
    blocks = F.transform(
        F.filter(F.split(diff_text, BLOCK_START, -1), lambda b: trim(b) != ""),
        lambda b: F.concat(F.lit(FILE_MARKER), b),
    )
    flagged = F.transform(
        blocks,
        lambda b: let(
            F.get(F.split(b, LINE_BREAK, 2), F.lit(0)),
            lambda head: F.struct(
                b.alias("block"),
                F.exists(targets, lambda t: F.contains(head, t)).alias("targeted"),
            ),
        ),
    )
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def overflows(acc: Column, block: Column) -> Column:
        return F.length(acc["text"]) + 1 + F.length(block) > limit

    def cut(acc: Column, block: Column) -> Column:
        room = F.lit(limit) - F.length(acc["text"])
        part = F.substr(block, F.lit(1), room)
        tail = F.element_at(F.split(part, "\n", -1), -1)
        whole_lines = F.substr(part, F.lit(1), F.length(part) - F.length(tail) - 1)
        kept = F.when(F.contains(part, F.lit("\n")), whole_lines).otherwise(part)
        return F.when(
            room > LEAST_PARTIAL, F.concat(acc["text"], F.lit("\n"), kept, F.lit(TRUNCATED))
        ).otherwise(acc["text"])

    def state(text: Column, full: Column) -> Column:
        return F.struct(text.alias("text"), full.alias("full"))

    def add_targeted(acc: Column, x: Column) -> Column:
        glue = F.when(acc["text"] == "", F.lit("")).otherwise(F.lit("\n"))
        return (
            F.when(acc["full"], acc)
            .when(overflows(acc, x["block"]), state(cut(acc, x["block"]), F.lit(True)))
            .otherwise(state(F.concat(acc["text"], glue, x["block"]), F.lit(False)))
        )

    def add_other(acc: Column, x: Column) -> Column:
        return (
            F.when(acc["full"], acc)
            .when(
                overflows(acc, x["block"]),
                state(F.concat(acc["text"], F.lit(OMITTED)), F.lit(True)),
            )
            .otherwise(state(F.concat(acc["text"], F.lit("\n"), x["block"]), F.lit(False)))
        )

    def walk(all_blocks: Column) -> Column:
        first = F.aggregate(
            F.filter(all_blocks, lambda x: x["targeted"]), start, add_targeted,
            lambda acc: acc["text"],
        )
        return let(
            first,
            lambda text: F.aggregate(
                F.filter(all_blocks, lambda x: ~x["targeted"]),
                state(text, F.lit(False)), add_other, lambda acc: acc["text"],
            ),
        )

    return let(
        let(flagged, walk),
        lambda text: F.when(text == "", F.left(diff_text, F.lit(limit))).otherwise(text),
    )


def budget_diff(diffs: DataFrame, findings: DataFrame, limit: int = DEFAULT_BUDGET) -> DataFrame:
    """Fit each diff into ``limit`` characters, blocks of files with findings first.

    Diffs within the limit pass through untouched and are not shuffled; only the
    long ones meet their (few, one diff's worth of) target file names.
    """
    fits = F.length("diff_text") <= limit
    short = diffs.where(fits).select("scan_id", F.col("diff_text").alias("budgeted"))
    names = findings.groupBy("scan_id").agg(
        F.collect_set(F.replace("file", F.lit("\\"), F.lit("/"))).alias("targets")
    )
    long = diffs.where(~fits).join(names, "scan_id", "left")
    targets = F.coalesce("targets", F.array().cast("array<string>"))
    return short.unionByName(
        long.select("scan_id", _budgeted(F.col("diff_text"), targets, limit).alias("budgeted"))
    )
