"""Argument text of a call: balanced parentheses, aware of string literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import let

# Cut after each character that can change the state; everything else is skipped.
_DELIMITERS = r"""(?<=[()"'`])"""


def closing_offset(tail: Column) -> Column:
    """Characters before the ``)`` that closes an already open call, -1 if none."""
    start = F.struct(
        F.lit(1).alias("depth"),
        F.lit("").alias("quote"),
        F.lit(0).alias("pos"),
        F.lit(-1).alias("end"),
    )

    def step(acc: Column, tok: Column) -> Column:
        last = F.right(tok, F.lit(1))
        escaped = F.substring(tok, -2, 2) == F.concat(F.lit("\\"), last)
        in_text = acc["quote"] != ""
        pos = acc["pos"] + F.length(tok)
        depth = (
            F.when(in_text, acc["depth"])
            .when(last == "(", acc["depth"] + 1)
            .when(last == ")", acc["depth"] - 1)
            .otherwise(acc["depth"])
        )
        quote = (
            F.when(in_text & (last == acc["quote"]) & ~escaped, F.lit(""))
            .when(in_text, acc["quote"])
            .when(last.isin('"', "'", "`"), last)
            .otherwise(F.lit(""))
        )
        moved = F.struct(
            depth.alias("depth"),
            quote.alias("quote"),
            pos.alias("pos"),
            F.when(depth == 0, pos - 1).otherwise(F.lit(-1)).alias("end"),
        )
        return F.when(acc["end"] >= 0, acc).otherwise(moved)

    return F.aggregate(F.split(tail, _DELIMITERS, -1), start, step, lambda acc: acc["end"])


def call_arguments(
    pieces: Column, openings: Column, then: Callable[[Column], Column] = lambda text: text
) -> Column:
    """``then(arguments)`` for every call opening of a text.

    ``pieces`` is the text cut at each opening (first entry: what precedes the first one),
    ``openings`` the matched text, ending in ``(``. The closing parenthesis is looked for
    up to the next opening first; only when it is not there (nested or unclosed call) is
    the whole rest of the text walked. ``then`` is applied call by call, so that a test on
    the arguments never holds many long texts at once.
    """

    def closed(text: Column, otherwise: Callable[[Column], Column]) -> Column:
        return let(
            text,
            lambda t: let(
                closing_offset(t),
                lambda e: F.when(e < 0, otherwise(t)).otherwise(then(F.substr(t, F.lit(1), e))),
            ),
        )

    def arguments(cut: Column) -> Column:
        numbered = F.transform(
            cut["openings"], lambda o, k: F.struct(o.alias("o"), (k + 2).alias("k"))
        )

        def one(x: Column) -> Column:
            after = F.length(x["o"]) + 1
            rest = F.array_join(F.slice(cut["pieces"], x["k"], F.size(cut["pieces"])), "")
            return closed(
                F.substr(F.get(cut["pieces"], x["k"] - 1), after),
                lambda _: closed(F.substr(rest, after), then),
            )

        return F.transform(numbered, one)

    return let(F.struct(pieces.alias("pieces"), openings.alias("openings")), arguments)
