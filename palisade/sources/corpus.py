"""Readers: source trees, exported patches, ignore files, tables of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions.blocks import FILE_MARKER, block_array
from palisade.functions.paths import is_pruned
from palisade.functions.text import lines_of, trim
from palisade.settings import DEFAULT_IGNORES, IGNORE_FILES

# Below this size a table is dealt to all cores before scanning; above it the file
# splits already give enough tasks, and moving the texts would cost more than it gains.
SPREAD_LIMIT_BYTES = 1 << 30


def spread(frame: DataFrame, limit: int = SPREAD_LIMIT_BYTES) -> DataFrame:
    """Repartition a *small* input whose file has too few row groups for the cores."""
    stats = frame._jdf.queryExecution().optimizedPlan().stats()
    if int(str(stats.sizeInBytes())) > limit:
        return frame
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)


def _path_in(spark: SparkSession, root: str) -> Column:
    """Path below ``root``, from the metadata of the file: known before the file is opened."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = system.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    # the metadata give an encoded URI; a plus sign there is a plus sign
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(whole, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.when(
        F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))
    ).otherwise(path)


def _tree(spark: SparkSession, root: str, profile: str) -> tuple[DataFrame, Column]:
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(root)
    )
    path = _path_in(spark, root)
    return raw.where(~is_pruned(path, profile)), path


def list_tree(spark: SparkSession, root: str, scan_id: str, profile: str = "cli") -> DataFrame:
    """``(scan_id, file_path)`` of a directory tree, pruned by path; no file is opened."""
    files, path = _tree(spark, root, profile)
    return files.select(F.lit(scan_id).alias("scan_id"), path.alias("file_path"))


def read_tree(spark: SparkSession, root: str, scan_id: str, profile: str = "cli") -> DataFrame:
    """``files(scan_id, file_path, content)`` of a directory tree, pruned by path.

    The test of the path is one of the file's metadata, so Spark drops pruned files from the
    list and never opens them. Unreadable files are skipped; ``with_unreadable`` brings them
    back into a scan's rows. Bytes that are no UTF-8 become replacement characters.
    """
    files, path = _tree(spark, root, profile)
    return files.select(
        F.lit(scan_id).alias("scan_id"),
        path.alias("file_path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def with_unreadable(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of a scan (``keep_clean=True``) and one row without finding for each listed file that
    gave none: files that could not be read count as scanned. Only paths are compared."""
    seen = rows.select("scan_id", "file").distinct()
    missing = listed.select("scan_id", F.col("file_path").alias("file")).join(
        seen, ["scan_id", "file"], "left_anti"
    )
    own = {"scan_id": F.col("scan_id"), "file": F.col("file"), "first_row": F.lit(True)}
    return rows.unionByName(
        missing.select(
            *[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]
        )
    )


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """``diffs(scan_id, diff_text)`` from exported patch files, each read as one text.

    For long histories see ``read_history``, which reads one file in many tasks.
    """
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("scan_id"), F.col("value").alias("diff_text")
    )


_RECORDS = pa.schema(
    [
        ("scan_id", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("text", pa.string()),
        ("before", pa.int64()), ("markers", pa.int64()), ("commit", pa.string()), ("named", pa.string()),
    ]
)
_RECORD_DDL = (
    "scan_id string, start long, nth long, text string, before long, markers long, commit string, "
    "named string"
)
_MARKED = re.compile(r"(?:\A|(?<=[\n\r\u2028\u2029]))diff --git ")
_COMMIT = re.compile(r"^commit ([0-9a-f]{7,64})", re.MULTILINE)


def _records_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the records of each file split and tell the last commit named before each.

    Records of a split come in the order of the file, and a task takes its splits one by one.
    """
    split, nth, before, commit = None, 0, 0, None
    for batch in batches:
        rows = []
        for scan, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (scan, start) != split:
                split, nth, before, commit = (scan, start), 0, 0, None
            # the reader takes the marker away, but for one at the very start of a file
            text = value if start == 0 and nth == 0 else FILE_MARKER + value
            markers = len(_MARKED.findall(text))
            named = _COMMIT.findall(text)[-1:] if "commit " in text else []
            row = (scan, start, nth, text, before, markers, commit, *(named or [None]))
            rows.append(dict(zip(_RECORDS.names, row)))
            nth, before, commit = nth + 1, before + markers, (named or [commit])[0]
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)


def read_history(spark: SparkSession, path: str, scan_id: Column | None = None) -> DataFrame:
    """``blocks(scan_id, block_ord, block, commit)`` of patch files and histories of any length.

    A file is cut at its file markers by the reader itself, so one file of many gigabytes is
    many splits, and no text is shuffled: the number of a block and the commit it belongs to are
    those in its split plus what the splits before it hold, one row per split, which is broadcast.
    The rows are those of ``diff_blocks`` over the whole texts. ``scan_id`` names a file; by
    default that is its path.
    """
    raw = spark.read.option("lineSep", "\n" + FILE_MARKER).text(path)
    name = F.col("_metadata.file_path") if scan_id is None else scan_id
    records = raw.select(
        name.alias("scan_id"), F.col("_metadata.file_block_start").alias("start"), "value"
    ).mapInArrow(_records_in_order, _RECORD_DDL)
    splits = records.groupBy("scan_id", "start").agg(
        F.sum("markers").alias("own"),
        F.max("nth").alias("last"),
        F.max_by("named", F.when(F.col("named").isNotNull(), F.col("nth"))).alias("named"),
    )
    file = Window.partitionBy("scan_id").orderBy("start")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "scan_id",
        "start",
        F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("_before"),
        F.last("named", ignorenulls=True).over(earlier).alias("_commit"),
        F.when(F.lead("start").over(file).isNull(), F.col("last")).alias("_final"),
    )
    # one row per split: no more than the driver holds anyway to schedule the tasks of this read
    placed = records.drop("named", "markers").join(F.broadcast(offsets), ["scan_id", "start"])
    # the reader takes the newline before a marker as well
    text = F.when(F.col("nth").eqNullSafe(F.col("_final")), F.col("text")).otherwise(
        F.concat("text", F.lit("\n"))
    )
    blocks = placed.select(
        "scan_id", (F.col("_before") + F.col("before")).alias("_offset"),
        F.coalesce("commit", "_commit").alias("commit"), F.inline(block_array(text)),
    )
    return blocks.select(
        "scan_id", (F.col("_offset") + F.col("block_ord")).cast("int").alias("block_ord"), "block", "commit"
    )


def ignore_patterns(files: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ignore patterns per scan, in first-seen order (``ord`` sorts them).

    Defaults, then configured patterns, then the non-comment lines of the scan's ignore
    files. First-wins is a ``min`` per (scan, pattern): nothing is collected.
    """
    name = F.element_at(F.split("file_path", "/"), -1)
    sources = files.where(name.isin(*IGNORE_FILES)).select(
        "scan_id",
        F.array_position(F.array(*[F.lit(n) for n in IGNORE_FILES]), name).cast("int").alias("src"),
        "file_path",
        F.posexplode(lines_of(F.col("content"))).alias("line_ord", "raw"),
    )
    listed = sources.select(
        "scan_id", trim(F.col("raw")).alias("pattern"),
        F.struct(F.col("src") + 1, "file_path", "line_ord").alias("ord"),
    ).where((F.col("pattern") != "") & ~F.startswith(F.col("pattern"), F.lit("#")))
    fixed = [(p, 0, i) for i, p in enumerate(DEFAULT_IGNORES)]
    fixed += [(p, 1, i) for i, p in enumerate(configured)]
    constants = F.array(
        *[
            F.struct(
                F.lit(p).alias("pattern"),
                F.struct(
                    F.lit(src).alias("src"), F.lit("").alias("file_path"), F.lit(i).alias("line")
                ).alias("ord"),
            )
            for p, src, i in fixed
        ]
    )
    scans = files.select("scan_id").distinct()
    rows = scans.select("scan_id", F.inline(constants)).union(listed)
    return rows.groupBy("scan_id", "pattern").agg(F.min("ord").alias("ord"))
