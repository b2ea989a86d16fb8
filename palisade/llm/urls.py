"""URL filters: rules first, then logistic regression on hashed character n-grams.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path follows, up to ``?``, ``#`` or the end. A rule ``host/path`` fits its host and
all subdomains, if the URL's path starts with the rule's; the longest fitting rule wins.

Pages under a rule are the labelled table: the classifier is fitted on at most ``fit_rows`` of
them (those of the lowest hash of the URL, so the choice does not depend on layout), and judges the
pages that no rule fits. Its features are the 3- to 5-character n-grams of host and path, hashed
by CRC-32 to ``2 ** BITS`` weights. With labels of one class only, that class is the verdict; with
none at all, ``allow``.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule; without any n-gram
the bias alone decides. Equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 4_000
BITS = 16
SIZES = (3, 4, 5)
STEPS, RATE, DECAY = 200, 0.5, 1e-6


class Rule(NamedTuple):
    verdict: str
    pattern: str  # host, then a path that begins with a slash


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: Rule) -> Column:
    name, slash, rest = rule.pattern.partition("/")
    inside = (host == name) | host.endswith(f".{name}")
    return inside & path.startswith(slash + rest)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(pattern, verdict) of the longest fitting rule, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    found = F.lit(None)
    for rule in reversed(ordered):
        value = F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits(host, path, rule), value).otherwise(found)
    return found


def features(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each once."""
    grams = set()
    for mark, part in (("h", host), ("p", path)):
        text = f"^{part}$"
        grams.update(mark + text[i : i + n] for n in SIZES for i in range(len(text) - n + 1))
    codes = {zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for g in grams}
    return np.array(sorted(codes), dtype=np.int64)


def fit(rows: list[tuple[str, str, bool]]) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps (AdaGrad); classes weigh the same."""
    weights, bias = np.zeros(1 << BITS), 0.0
    blocked = np.array([r[2] for r in rows], dtype=np.float64)
    if not rows:
        return weights, -1.0
    if blocked.min() == blocked.max():
        return weights, 1.0 if blocked[0] else -1.0
    parts = [features(h, p) for h, p, _ in rows]
    columns = np.concatenate(parts)
    owners = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    scale = 1 / np.sqrt(np.maximum([len(p) for p in parts], 1))
    share = np.where(blocked == 1, 0.5 / blocked.sum(), 0.5 / (len(rows) - blocked.sum()))
    squares, bias_square = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(STEPS):
        score = np.bincount(owners, weights[columns], len(rows)) * scale + bias
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - blocked) * share
        slope = np.bincount(columns, (error * scale)[owners], 1 << BITS) + DECAY * weights
        squares += slope**2
        bias_square += error.sum() ** 2
        weights -= RATE * slope / np.sqrt(squares)
        bias -= RATE * error.sum() / np.sqrt(bias_square)
    return weights, float(bias)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], fit_rows: int = FIT_ROWS, key: str = "page_id",
) -> DataFrame:
    """(key, host, path, rule, verdict, block_score) for every row of ``pages`` (key, url)."""
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    parsed = pages.select(F.col(key).cast("long").alias(key), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    labelled = ruled.where("found IS NOT NULL").select(
        "host", "path", (F.col("found.verdict") == "block").alias("blocked")
    )
    sample = labelled.distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(fit_rows)
    model = spark.sparkContext.broadcast(fit([tuple(r) for r in sample.collect()]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            values = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                codes = features(host, path)
                total = bias + weights[codes].sum() / np.sqrt(max(len(codes), 1))
                values.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
            columns = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(values, pa.float64())], [key, "host", "path", "found", "block_score"]
            )

    scored = ruled.mapInArrow(
        score,
        f"`{key}` long, host string, path string, found struct<pattern:string,verdict:string>, block_score double",
    )
    guess = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        key, "host", "path", F.col("found.pattern").alias("rule"),
        F.coalesce(F.col("found.verdict"), guess).alias("verdict"), "block_score",
    )
