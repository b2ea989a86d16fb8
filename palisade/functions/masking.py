"""Redaction of tokens in snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask(token: Column, hide_short: Column | bool = True) -> Column:
    """First four and last four characters; short tokens vanish if ``hide_short``."""
    short = F.length(token) <= 8
    hidden = short & (hide_short if isinstance(hide_short, Column) else F.lit(hide_short))
    ends = F.concat(F.left(token, F.lit(4)), F.lit("..."), F.right(token, F.lit(4)))
    return F.when(hidden, F.lit("***")).otherwise(ends)


def mask_first(snippet: Column, token: Column, masked: Column) -> Column:
    """Replace the first occurrence only (``replace`` would change all of them)."""
    at = F.instr(snippet, token)
    return F.when(
        at > 0,
        F.concat(
            F.substr(snippet, F.lit(1), at - 1),
            masked,
            F.substr(snippet, at + F.length(token)),
        ),
    ).otherwise(snippet)
