"""Contiguous shards of near-equal byte size, by global prefix sums.

1. Narrow rows (order keys, size, checksum) are dealt by range of the order, and written once.
2. Each range gives one total; a running sum over the totals, one row per range, gives offsets.
3. Offset plus the running sum inside the range is a row's place in the whole.
4. The total is cut at equal targets: a row goes to the shard that its middle byte falls into.

So shards are contiguous in (doc_id, crc, size) order, no shard is off its target by more than one
row at either end, and nothing but one total per range meets in one task. Rows with equal keys
(equal texts under one id) are told apart by their place in the input, so a range never has to
hold all rows of one key. Null ids come first. Null text has no bytes. Texts in the same group
(equal texts) are not held together: the law is ``bytes``.

An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.store import saved

ORDER = ("doc_id", "text_crc32", "size", "tie")


def sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).withColumn("tie", F.monotonically_increasing_id())


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = saved(sizes(docs))
    dealt = saved(
        narrow.repartitionByRange(ranges, *ORDER).withColumn("range_no", F.spark_partition_id())
    )
    totals = dealt.groupBy("range_no").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = totals.select(
        "range_no",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("range_no").orderBy(*ORDER)
    running = dealt.select(
        "*",
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        (F.row_number().over(inside) - 1).alias("place"),
    )
    placed = running.join(offsets, "range_no").select(
        "doc_id", "size", "text_crc32",
        F.expr(f"int({shards} * cast(2 * (bytes_before + upto) - size as decimal(38, 0)) div (2 * total))").alias("shard"),
        (F.col("rows_before") + F.col("place")).alias("rank"),
    )
    placed = saved(placed)
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )
