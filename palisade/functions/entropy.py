"""Shannon entropy of credential-like tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import let

# Vendor prefixes stripped, one after the other, before measuring,
# and the shortest token / stripped token that can count as random.
TOKEN_PREFIXES = (
    r"^sk-(?:proj-|admin-|ant-)?",
    r"^AIzaSy",
    r"^AKIA",
    r"^ghp_",
    r"^github_pat_",
    r"^sk_live_",
)
MIN_TOKEN_LENGTH = 12
MIN_STRIPPED_LENGTH = 8
DEFAULT_THRESHOLD = 3.2


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)


def shannon_entropy(text: Column) -> Column:
    """Bits per symbol: counts are per code point, the divisor is UTF-16 units."""

    def measured(bound: Column) -> Column:
        chars, n = bound["chars"], bound["n"]
        return F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, ch: let(
                F.size(F.filter(chars, lambda c: c == ch)) / n,
                lambda p: acc - p * F.log2(p),
            ),
        )

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(
        let(
            F.struct(F.split(text, "", -1).alias("chars"), utf16_length(text).alias("n")),
            lambda b: measured(
                F.struct(
                    F.filter(b["chars"], lambda c: c != "").alias("chars"), b["n"].alias("n")
                )
            ),
        )
    )


def strip_vendor_prefix(token: Column) -> Column:
    for prefix in TOKEN_PREFIXES:
        token = F.regexp_replace(token, "(?i)" + prefix, "")
    return token


def token_entropy(token: Column) -> Column:
    """Entropy of the token without its vendor prefix: the value that is tested."""
    return shannon_entropy(strip_vendor_prefix(token))


def is_high_entropy(token: Column, threshold: Column | float = DEFAULT_THRESHOLD) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(utf16_length(token) < MIN_TOKEN_LENGTH, F.lit(False)).otherwise(
        let(
            strip_vendor_prefix(token),
            lambda t: (utf16_length(t) >= MIN_STRIPPED_LENGTH) & (shannon_entropy(t) >= limit),
        )
    )
