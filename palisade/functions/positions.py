"""Position-true regex matching without UDFs.

One ``regexp_replace`` puts a noncharacter before and another after every match. The
marked text is cut into lines, so a match's line is the index of its line and its column
follows from the lengths before the marker; the matched text is what stands between the
two. Capture groups come out of the same replacement: their text is put behind the match,
after a third noncharacter, so a group is what it was in the whole text, whatever lookahead
or lookbehind stands around it. That is a single regex pass, linear in the text and in the
number of matches, row-local and without shuffle.

Valid text holds no noncharacters. Should one of the three occur anyway, it appears as
``STAND_IN`` in snippets and tokens; positions are not affected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import let, lines_of, running_sums, trim

MARK = "\uffff"
END = "\ufffe"
GROUP = "\ufdd1"
STAND_IN = "\ufdd0"
TEMPLATE = "@$0#"


def marker_template(template: str = TEMPLATE, groups: Sequence[int] = ()) -> str:
    """Replacement text; ``@`` and ``#`` say where the located text starts and ends.

    The texts of ``groups``, in their order, follow the located text."""
    behind = GROUP + "".join(f"${g}" for g in groups) if groups else ""
    return template.replace("@", MARK).replace("#", behind + END)


def mark_matches(content: Column, pattern: Column, template: Column | None = None) -> Column:
    template = F.lit(marker_template()) if template is None else template
    taken = (
        F.contains(content, F.lit(MARK)) | F.contains(content, F.lit(END))
        | F.contains(content, F.lit(GROUP))
    )
    safe = F.when(taken, F.translate(content, MARK + END + GROUP, STAND_IN * 3)).otherwise(content)
    return F.regexp_replace(safe, pattern, template)


def _plain(marked: Column) -> Column:
    return F.replace(marked, F.lit(END), F.lit(""))


def _columns(marked_line: Column) -> Column:
    def placed(pieces: Column) -> Column:
        starts = running_sums(F.transform(pieces, lambda p: F.length(p)))
        several = F.transform(
            F.slice(starts, F.lit(2), F.size(starts)), lambda s: (s + 1).cast("int")
        )
        # nearly all lines have one match
        return F.when(F.size(pieces) == 2, F.array(F.length(F.get(pieces, F.lit(0))) + 1)).otherwise(several)

    return let(F.split(_plain(marked_line), MARK, -1), placed)


def without_groups(marked: Column) -> Column:
    """The marked text less the group texts behind its matches."""
    pieces = F.transform(F.split(marked, END, -1), lambda p: F.substring_index(p, GROUP, 1))
    return F.when(F.contains(marked, F.lit(GROUP)), F.array_join(pieces, END)).otherwise(marked)


def group_texts(marked: Column) -> Column:
    """``array<string>``: the group texts of each match; its whole text where none are marked."""
    pieces = F.split(marked, END, -1)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.when(F.contains(p, F.lit(GROUP)), F.substring_index(p, GROUP, -1)).otherwise(
            F.substring_index(p, MARK, -1)
        ),
    )


def pieces_from_matches(marked: Column) -> Column:
    """The text cut at every match start; the first piece precedes the first match."""
    return F.split(_plain(marked), MARK, -1)


def matched_texts(marked: Column) -> Column:
    pieces = F.split(marked, MARK, -1)
    return F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.substring_index(p, END, 1)
    )


def hit_lines(marked: Column) -> Column:
    """``array<struct<line,snippet,cols>>``: each line on which matches start, once."""
    numbered = F.transform(
        lines_of(marked), lambda m, i: F.struct(m.alias("m"), (i + 1).alias("line"))
    )
    return F.transform(
        F.filter(numbered, lambda x: F.contains(x["m"], F.lit(MARK))),
        lambda x: F.struct(
            x["line"].alias("line"),
            trim(F.replace(_plain(x["m"]), F.lit(MARK), F.lit(""))).alias("snippet"),
            _columns(x["m"]).alias("cols"),
        ),
    )


def line_positions(lines: Column) -> Column:
    """``array<struct<line,column,nth>>``, one per match; ``nth`` indexes ``hit_lines``.

    The snippet stays out: a minified file may have thousands of matches on one line of
    megabytes, and an array repeating that line would not fit a row.
    """
    return F.flatten(
        F.transform(
            lines,
            lambda x, i: F.transform(
                x["cols"],
                lambda c: F.struct(x["line"].alias("line"), c.alias("column"), i.alias("nth")),
            ),
        )
    )


def match_positions(content: Column, pattern: Column, template: Column | None = None) -> Column:
    """All non-overlapping matches, in text order, with the lines on which they start:
    ``struct<lines array<struct<line,snippet>>, matches array<struct<line,column,nth,text>>>``.

    A match's snippet is ``lines[nth].snippet``: each line is held once, however many matches
    it has, so the column is linear in the text. Explode ``matches``, then look the line up.
    """

    def both(b: Column) -> Column:
        return F.struct(
            F.transform(b["lines"], lambda x: F.struct(x["line"], x["snippet"])).alias("lines"),
            F.zip_with(
                line_positions(b["lines"]),
                matched_texts(b["marked"]),
                lambda p, t: F.struct(
                    p["line"].alias("line"), p["column"].alias("column"), p["nth"].alias("nth"),
                    t.alias("text"),
                ),
            ).alias("matches"),
        )

    return let(
        mark_matches(content, pattern, template),
        lambda marked: let(
            F.struct(marked.alias("marked"), hit_lines(marked).alias("lines")), both
        ),
    )
