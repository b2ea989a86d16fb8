from datetime import datetime, timedelta
from pathlib import Path

from palisade.streaming import pushes
from palisade.streaming.pushes import daily_risk, new_diffs, scan_pushes, start_push_scan, unseen

DIFF = "diff --git a/a.ts b/a.ts\n+++ b/a.ts\n@@ -1 +1 @@\n+eval(aiOutput)\n"
DDL = "event_id long, ts timestamp, diff_id long"


def test_stream_equals_batch_and_drops_redeliveries(spark, tmp_path):
    # the last event to come is a year older than the others, and stays
    rows = [(i, datetime(2024 - (i == 11), 1, 1 + i % 3, 12), i % 2) for i in range(12)]
    batch = spark.createDataFrame(rows, DDL)
    diffs = spark.createDataFrame([(0, DIFF), (1, DIFF), (2, DIFF)], "diff_id long, diff_text string")
    source = str(tmp_path / "in")
    for part in (rows[:7], rows[5:11], rows[:2], rows[11:]):  # overlapping deliveries, several files
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    start_push_scan(stream, diffs, out, str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(out)
    key = ["event_id", "file", "line", "rule_id"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(
        map(tuple, scan_pushes(batch, diffs).select(*key).collect())
    )
    days = {r.day: (r.findings, r.risk_score) for r in daily_risk(found).collect()}
    assert days == {
        "2024-01-01": (4, 80), "2024-01-02": (4, 80), "2024-01-03": (3, 60), "2023-01-03": (1, 20)
    }
    # a second run finds nothing new
    start_push_scan(stream, diffs, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == found.count()


def test_no_state_grows_and_only_the_days_of_a_batch_are_read(spark, tmp_path):
    start = datetime(2020, 1, 1, 12)
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "state"
    diffs = spark.createDataFrame([(i, DIFF) for i in range(9)], "diff_id long, diff_text string")
    # five years of one event a day and one day, then all of the first hundred again, years late
    days = [(i, start + timedelta(days=i), i // 18 % 9) for i in range(0, 1800, 18)]
    for part in (days[:50], days[50:], days[:100]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
    start_push_scan(stream, diffs, out, str(state)).awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == found.select("event_id").distinct().count() == 100
    assert not (state / "state").exists()  # nothing in a state store
    ids = spark.read.parquet(str(state / "seen" / "ids"))
    assert ids.count() == 100  # each id once, whatever was delivered
    scanned = spark.read.parquet(str(state / "seen" / "diffs"))
    assert scanned.count() == 9  # each diff once, though three batches named it
    batch = spark.createDataFrame(days[3:5], DDL).selectExpr("*", "date_format(ts, 'yyyy-MM-dd') AS day")
    text = unseen(batch, ids)._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and str(days[3][1].date()) in filters
    assert len(list(Path(state / "seen" / "ids").glob("day=*"))) == 100


def test_batches_write_few_files_and_read_texts_for_new_diffs_only(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 1, 12)
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "state"
    diffs = spark.createDataFrame([(i, DIFF) for i in range(40)], "diff_id long, diff_text string")
    rows = [(i, start + timedelta(days=i % 30), i % 40) for i in range(1200)]
    for part in (rows[:600], rows[600:]):  # the second names no new diff
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(source)
    calls = []
    scan = pushes.scan_diffs
    monkeypatch.setattr(pushes, "scan_diffs", lambda *a: calls.append(a) or scan(*a))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source)
    start_push_scan(stream, diffs, out, str(state)).awaitTermination()
    assert spark.read.parquet(out).count() == 1200
    assert len(calls) == 2  # for the columns, and for the first batch
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for batch_id in (0, 1):
        ids = list((state / "seen" / "ids").glob(f"day=*/batch_id={batch_id}/*.parquet"))
        assert 30 <= len(ids) <= 30 + tasks
    scanned = list((state / "seen" / "diffs").glob("**/*.parquet"))
    assert len({f.parent for f in scanned}) == len(scanned)  # one file to a bucket


def test_events_are_hashed_not_sorted_and_texts_not_shuffled(spark):
    batch = spark.createDataFrame([(1, datetime(2024, 1, 1), 2)], DDL).selectExpr("*", "date_format(ts, 'yyyy-MM-dd') AS day")
    none = pushes._written(spark, "/nowhere/ids", "event_id long, day string", 0)
    plan = unseen(batch, none)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Join" not in plan
    diffs = spark.createDataFrame([(1, DIFF), (2, DIFF)], "diff_id long, diff_text string")
    met = new_diffs(diffs, spark.range(2, 9).toDF("diff_id").distinct(), 7)
    assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert [r.diff_id for r in met.collect()] == [2]
