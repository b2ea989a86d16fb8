"""Threshold-scaled document fingerprints, with DataFrame functions only.

A fingerprint keeps every shingle hash below a fixed fraction (one in ``SCALE``) of the hash range;
if none is below, it keeps the least hash alone, so that no text with words is without one. The
rule depends on the set only, so the fingerprint of a union is the rule applied to the union of
fingerprints (``merge``), and the share of one fingerprint's hashes that another has estimates the
containment of one text in the other, however different their lengths are.

Shingles are five words (runs of characters other than blank, tab, newline, vertical tab, form
feed, return), lower-cased; fewer words: the whole sequence as one. Likeness: common hashes over
the hashes of the smaller fingerprint; both empty: 1, one empty: 0. As text, a fingerprint is its
hashes in order as 16 hexadecimal digits each.

The likeness is an estimate from one hash in ``SCALE``: with n shingles in the smaller text its
error is about sqrt(SCALE / n) / 2. Below some fifty shingles it says little (a fingerprint of one
hash gives 0 or 1), and texts as short as that need the exact sets.

The next document is found in blocks of ``BLOCK`` ids, one shuffle of the texts by block; only the
first document of each block is looked up across blocks. Rows with equal ids are ordered by text.
Null text counts as empty. A row without an id has no place in the order and no next document: the
replaced part is empty, and ``near_next`` compares with an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 8
SHINGLE = 5
BLOCK = 1024
#: Hashes are signed 64-bit numbers: one in SCALE of them is below this.
LIMIT = -(1 << 63) + (1 << 64) // SCALE


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles in order of place."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        starts = F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))
        long_text = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
        short_text = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= SHINGLE, long_text).when(n > 0, short_text).otherwise(F.array().cast("array<long>"))

    return F.get(F.transform(F.array(hashed), of), F.lit(0))


def kept(hashes: Column) -> Column:
    """The fingerprint of a set of hashes, in order."""
    below = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < LIMIT)))
    least = F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())
    return F.get(F.transform(F.array(below), lambda b: F.when(F.size(b) > 0, b).otherwise(least)), F.lit(0))


def fingerprint(text: Column) -> Column:
    return F.get(F.transform(F.array(shingle_hashes(text)), kept), F.lit(0))


def merge(one: Column, two: Column) -> Column:
    """Fingerprint of the union of both sets."""
    return kept(F.array_union(one, two))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(one: Column, two: Column) -> Column:
    smaller = F.least(F.size(one), F.size(two))
    share = F.size(F.array_intersect(one, two)) / smaller
    return F.when(smaller > 0, share).when(F.greatest(F.size(one), F.size(two)) > 0, 0.0).otherwise(1.0)


def next_blocks(blocks: DataFrame) -> DataFrame:
    """(block, next_block): the next lower block that has documents; the first again after the last.

    Blocks are ordered in groups; one task sees only the ends of the groups.
    """
    grouped = blocks.select("block", F.floor(F.col("block") / BLOCK).alias("part")).distinct()
    inside = Window.partitionBy("part").orderBy(F.desc("block"))
    stepped = grouped.select("block", "part", F.lead("block").over(inside).alias("next_block"))
    ends = grouped.groupBy("part").agg(F.max("block").alias("top"))
    across = Window.orderBy(F.desc("part"))
    first = F.max("top").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = ends.select("part", F.coalesce(F.lead("top").over(across), first).alias("after"))
    return stepped.join(tops, "part").select("block", F.coalesce("next_block", "after").alias("next_block"))


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, hashes) with next_text and next_hashes, in descending order of id."""
    placed = rows.where("doc_id IS NOT NULL").withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    order = (F.desc("doc_id"), F.asc("text"))
    inside = Window.partitionBy("block").orderBy(*order)
    own = F.struct("text", "hashes")
    stepped = placed.withColumn("following", F.lead(own).over(inside))
    # one text of each block: the group limit is applied before the shuffle
    heads = placed.select("doc_id", "text", "block", F.row_number().over(inside).alias("place")).where("place = 1")
    heads = heads.withColumn("hashes", fingerprint(F.col("text"))).select(
        F.col("block").alias("next_block"), own.alias("head")
    )
    after = next_blocks(placed).join(heads, "next_block").select("block", "head")
    # rows lie by block already, so the join moves none of them again
    whole = stepped.join(after, "block", "left").withColumn("following", F.coalesce("following", "head"))
    lost = rows.where("doc_id IS NULL").withColumn("following", F.lit(None).cast(stepped.schema["following"].dataType))
    columns = ["doc_id", "text", "hashes", "following"]
    whole = whole.select(columns).unionByName(lost.select(columns))
    return whole.select(
        "doc_id", "text", "hashes",
        F.coalesce("following.text", F.lit("")).alias("next_text"),
        F.coalesce("following.hashes", F.array().cast("array<long>")).alias("next_hashes"),
    )


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its fingerprint, that of its edited text, and both
    likenesses. The edited text has the first half of the next document in place of its own end."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("hashes", fingerprint(F.col("text")))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)
    )
    pairs = with_next(rows).withColumn("edited", edited)
    pairs = pairs.withColumn("edited_hashes", fingerprint(F.col("edited")))
    return pairs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("hashes")).alias("fingerprint"),
        as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
