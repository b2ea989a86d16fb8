"""Continuous diff scan: push events in, findings out, each event once.

Events carry the id of their diff; the texts stay in a table. The stream keeps no state of its
own. What has been seen is two tables beside the output, written batch by batch:

* ``ids``: the ids of all events, partitioned by the day of the event. A redelivery has the time
  of its event, so a batch is compared with the ids of its own days only, by an anti-join: an event
  that comes again a year later is told, a late event is kept, and the work of a batch does not
  grow with the age of the stream.
* ``diffs``: which diffs have been scanned, and their findings. A batch scans the diffs that are
  new to the stream, once, and joins stored findings (not texts) to its events.

Every table is written under the batch id and a batch reads only what earlier ones wrote, so a
retried batch replaces its own rows and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palisade.operators.diff import scan_diff
from palisade.operators.score import MAX_SCORE, severity_points
from palisade.settings import ScanConfig

#: Files of scanned diffs per batch are few; their findings are kept in so many buckets by id.
BUCKETS = 64
#: So many ids of new diffs (about 150 MB as a table) go to the texts; of more, the texts go to them.
MOST_SENT = 4_000_000


def _written(spark: SparkSession, path: str, ddl: str, batch_id: int) -> DataFrame:
    """Rows that earlier batches wrote to a table (none before the first)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):  # known to be empty by the plan: joins with it go
        fields = StructType.fromDDL(f"{ddl}, batch_id long").fields
        return spark.range(0).where("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    return spark.read.schema(f"{ddl}, batch_id long").parquet(path).where(F.col("batch_id") < batch_id)


def _write(frame: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Write a batch's rows; a retry replaces them, other batches are left alone."""
    (
        frame.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch_id").parquet(path)
    )


def event_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def unseen(batch: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of ``batch`` (event_id, ts, diff_id, day: that of ts), each once, that are not in ``ids``.

    Only the days of the batch are read: their list is as short as the batch's spread in time. The day
    is told again after the first of each id is taken: a text among the columns would make that a sort.
    """
    events = batch.drop("day").dropDuplicates(["event_id"]).withColumn("day", event_day(F.col("ts")))
    days = [r.day for r in batch.select("day").distinct().collect()]
    known = ids.where(F.col("day").isin(days)).select("day", "event_id")
    return events.join(known, ["day", "event_id"], "left_anti")


def scan_pushes(batch: DataFrame, diffs: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Findings per event of ``batch`` (event_id, ts, diff_id); an event is a scan of its own.

    ``diffs`` holds (diff_id, diff_text), each id once; an event whose diff is not there has no
    findings.
    """
    events = batch.select("event_id", "ts", "diff_id")
    wanted = diffs.join(events.select("diff_id").distinct(), "diff_id", "left_semi")
    return events.join(scan_diffs(wanted, config), "diff_id").drop("diff_id")


def new_diffs(diffs: DataFrame, new: DataFrame, n_new: int) -> DataFrame:
    """The rows of ``diffs`` whose ids are in ``new`` (diff_id); texts stay where they are read."""
    return diffs.join(F.broadcast(new) if n_new <= MOST_SENT else new, "diff_id", "left_semi")


def scan_diffs(diffs: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    found = scan_diff(diffs.select(F.col("diff_id").alias("scan_id"), "diff_text"), config)
    return found.withColumnRenamed("scan_id", "diff_id")


def start_push_scan(
    pushes: DataFrame,
    diffs: DataFrame,
    output: str,
    checkpoint: str,
    config: ScanConfig | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write findings of a push stream to ``output/batch_id=N``; what has been seen goes to
    ``checkpoint/seen``."""
    spark = pushes.sparkSession
    seen = f"{checkpoint}/seen"
    found_ddl = ", ".join(
        f"{name} {kind}" for name, kind in scan_diffs(diffs, config).dtypes
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        events = batch.select("event_id", "ts", "diff_id", event_day(F.col("ts")).alias("day"))
        ids = _written(spark, f"{seen}/ids", "event_id long, day string", batch_id)
        fresh = unseen(events, ids).persist()
        bucket = F.pmod(F.col("diff_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        scanned = _written(spark, f"{seen}/diffs", "diff_id long, bucket int", batch_id)
        new = fresh.select("diff_id").distinct().join(scanned.select("diff_id"), "diff_id", "left_anti").persist()
        n_new = new.count()
        if n_new:  # else no text is read
            found = scan_diffs(new_diffs(diffs, new, n_new), config)
            _write(found.withColumn("bucket", bucket).repartition("bucket"), f"{seen}/findings", batch_id, "bucket")
        stored = _written(spark, f"{seen}/findings", f"{found_ddl}, bucket int", batch_id + 1)
        joined = fresh.drop("day").join(stored.drop("bucket", "batch_id"), "diff_id").drop("diff_id")
        joined.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
        _write(new.withColumn("bucket", bucket).repartition("bucket"), f"{seen}/diffs", batch_id, "bucket")
        # ranges of days, cut also inside a day: about a file for each task and day, not for each pair of them
        ranged = fresh.select("event_id", "day").repartitionByRange("day", "event_id")
        _write(ranged, f"{seen}/ids", batch_id, "day")
        new.unpersist()
        fresh.unpersist()

    writer = pushes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def daily_risk(findings: DataFrame) -> DataFrame:
    """Active findings, points and capped risk score per (session time zone) day."""
    return (
        findings.where(~F.col("suppressed"))
        .groupBy(event_day(F.col("ts")).alias("day"))
        .agg(F.count("*").alias("findings"), F.sum(severity_points(F.col("severity"))).alias("points"))
        .select(
            "day",
            "findings",
            "points",
            F.least(F.lit(MAX_SCORE), "points").cast("int").alias("risk_score"),
        )
    )
