"""Text helpers: regex dialects, trimming, one-time binding inside expressions.

The rule patterns are written once, in the JavaScript flavour the rules are
specified in. ``java_regex`` and ``re2_regex`` render them for Spark and for the
DuckDB oracle. Two differences matter:

* ``\\s`` and ``\\S`` know the Unicode spaces in JavaScript but only ASCII in Java/RE2;
* Java 17's ``\\b`` and ``\\B`` are Unicode-aware (``éexec`` has no boundary before
  ``exec``) while JavaScript's are ASCII, so they become ASCII lookarounds for Spark.

RE2 has no lookarounds. ``without_lookarounds`` drops them, which can only make a pattern
match more, so the result serves as a test of which texts to look at.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript white space and line terminator characters.
SPACE_CLASS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(
    chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)

LINE_BREAK = r"\r?\n"


_WORD_CLASS = re.compile(r"\[(?:\\[dw]|[A-Za-z0-9_](?:-[A-Za-z0-9])?)+\]")
_WORD_ATOM = re.compile(r"\\[dw]|\w", re.ASCII)
_OPTIONAL = re.compile(r"[?*]|\{0")


def _class_end(pattern: str, i: int) -> int:
    """Where the character class that opens at ``i`` is over."""
    i += 1
    while i < len(pattern) and pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i + 1


def _branches(pattern: str, i: int) -> tuple[list[int], int]:
    """Starts of the branches of the group whose body begins at ``i``, and where the group is over."""
    starts, depth = [i], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            i = _class_end(pattern, i) - 1
        elif ch == "(":
            depth += 1
        elif ch == ")":
            if not depth:
                return starts, i + 1
            depth -= 1
        elif ch == "|" and not depth:
            starts.append(i + 1)
        i += 1
    return starts, i


def begins_with_word(pattern: str, i: int) -> bool:
    """Whether every match of the pattern from ``i`` on begins with an ASCII word character."""
    if found := _WORD_ATOM.match(pattern, i) or _WORD_CLASS.match(pattern, i):
        return not _OPTIONAL.match(pattern, found.end())
    if pattern.startswith("(", i) and not pattern.startswith(("(?=", "(?!", "(?<"), i):
        starts, end = _branches(pattern, i + (3 if pattern.startswith("(?:", i) else 1))
        return not _OPTIONAL.match(pattern, end) and all(begins_with_word(pattern, at) for at in starts)
    return False


def without_lookarounds(pattern: str) -> str:
    """The pattern less its lookaheads and lookbehinds: it matches wherever the pattern does."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
            i = _branches(pattern, i + (4 if pattern[i + 2] == "<" else 3))[1]
            continue
        end = i + 2 if pattern[i] == "\\" else _class_end(pattern, i) if pattern[i] == "[" else i + 1
        out.append(pattern[i:end])
        i = end
    return "".join(out)


def _render(
    pattern: str, ignore_case: bool, boundary: Callable[[bool], str], inside: str
) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        if pattern.startswith(r"[\s\S]", i):
            out.append(r"[\s\S]")
            i += 6
            continue
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE_CLASS if in_class else f"[{SPACE_CLASS}]")
        elif two == r"\S":
            if in_class:
                raise ValueError(rf"\S inside a character class is not supported: {pattern}")
            out.append(f"[^{SPACE_CLASS}]")
        elif two == r"\b" and not in_class:
            out.append(boundary(begins_with_word(pattern, i + 2)))
        elif two == r"\B" and not in_class:
            out.append(inside)
        elif two[0] == "\\":
            out.append(two)
        else:
            two = two[0]
            if two == "[":
                in_class = True
            elif two == "]":
                in_class = False
            out.append(two)
        i += len(two)
    return ("(?i)" if ignore_case else "") + "".join(out)


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    # where a word character must follow, looking back is enough
    both = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    inside = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
    return _render(pattern, ignore_case, lambda leading: r"(?<!\w)" if leading else both, inside)


def re2_regex(pattern: str, ignore_case: bool = True) -> str:
    return _render(pattern, ignore_case, lambda leading: r"\b", r"\B").replace(")++", ")+")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def lines_of(text: Column) -> Column:
    """Lines cut at ``\\r?\\n``; texts without ``\\r`` take the far faster literal split."""
    return F.when(F.contains(text, F.lit("\r")), F.split(text, LINE_BREAK, -1)).otherwise(
        F.split(text, "\n", -1)
    )


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda an outer expression is evaluated again for every element;
    passing it as the element of a one-entry array avoids that.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


CHUNK = 256


def running_sums(values: Column) -> Column:
    """Sum of the entries before each entry of an ``array<int>``, in time linear in its size.

    An array can only grow by being copied, so it grows within chunks of fixed size, and so do
    the sums of chunks and of chunks of chunks; no array that is copied holds more entries.
    """

    def grown(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(
            items,
            start,
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"])).alias("sums")
            ),
            lambda acc: acc["sums"],
        )

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def chunked(items: Column, sums_of: Callable[[Column], Column]) -> Column:
        starts = F.sequence(F.lit(1), F.size(items), F.lit(CHUNK))
        chunks = F.transform(starts, lambda at: F.slice(items, at, F.lit(CHUNK)))
        return let(
            chunks,
            lambda parts: F.flatten(
                F.zip_with(parts, sums_of(F.transform(parts, total)), grown)
            ),
        )

    def from_zero(items: Column) -> Column:
        return grown(items, F.lit(0).cast("bigint"))

    def whole(items: Column) -> Column:
        return (
            F.when(F.size(items) <= CHUNK, from_zero(items))
            .when(F.size(items) <= CHUNK * CHUNK, chunked(items, from_zero))
            .otherwise(chunked(items, lambda sums: let(sums, lambda s: chunked(s, from_zero))))
        )

    return let(values.cast("array<bigint>"), whole)


def empty(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")

