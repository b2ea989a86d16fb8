"""File blocks of unified diffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import trim

# Fixed value: unified diff syntax.
FILE_MARKER = "diff --git "

# The first character comes before the test of what precedes it: the regex engine then
# skips from candidate to candidate instead of looking behind at every position.
BLOCK_START = r"d(?<=\Ad|[\n\r\x{2028}\x{2029}]d)iff --git "


def block_array(diff_text: Column) -> Column:
    """Non-blank blocks with their position in the diff."""
    numbered = F.transform(
        F.split(diff_text, BLOCK_START, -1),
        lambda b, i: F.struct(i.alias("block_ord"), b.alias("block")),
    )
    return F.filter(numbered, lambda x: trim(x["block"]) != "")
