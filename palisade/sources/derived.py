"""Views over the driver's tables: files, cases, diffs, reviews, pushes.

Every view is a projection of whole base tables (whole texts, all rows); the planted
texts come in through constant arrays, so no join is needed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.corpus import spread
from palisade.sources.labelled import CASES
from palisade.sources.planted import CONFIGS, FOLDERS, PLANTED


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str | None], index: Column) -> Column:
    return F.get(F.from_json(F.lit(json.dumps(values)), "array<string>"), index.cast("int"))


def _entry(doc_id: Column) -> Column:
    return doc_id % len(PLANTED)


def file_path(doc_id: Column) -> Column:
    folder = _pick(list(FOLDERS), F.floor(doc_id / len(PLANTED)) % len(FOLDERS))
    path = _pick([p.path for p in PLANTED], _entry(doc_id))
    return F.concat(folder, F.lit("d"), doc_id.cast("string"), F.lit("/"), path)


def head(doc_id: Column) -> Column:
    return _pick([p.head for p in PLANTED], _entry(doc_id))


def tail(doc_id: Column) -> Column:
    return _pick([p.tail for p in PLANTED], _entry(doc_id))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``files(scan_id, file_path, content)``: a document between its head and tail."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    doc = F.col("doc_id")
    return docs.select(
        F.col("source").alias("scan_id"),
        file_path(doc).alias("file_path"),
        F.concat_ws("\n", head(doc), F.col("text"), tail(doc)).alias("content"),
    )


def config_files(spark: SparkSession, folder: str) -> DataFrame:
    """Configuration files of the scans, as rows of ``files``."""
    first = table(spark, folder, "documents").groupBy(F.col("source").alias("scan_id")).agg(
        F.min("doc_id").alias("d")
    )
    texts = [[{"file_path": n, "content": t} for n, t in c.files] for c in CONFIGS]
    listed = F.from_json(F.lit(json.dumps(texts)), "array<array<struct<file_path:string,content:string>>>")
    return first.select("scan_id", F.inline(F.get(listed, (F.col("d") % len(CONFIGS)).cast("int"))))


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """``(scan_id, doc_id, text)``: the diffs of a source in order, every other one with a commit line."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    doc = F.col("doc_id")
    commit = F.concat(F.lit("commit "), F.md5(F.concat(F.lit("h"), doc.cast("string"))), F.lit("\n"))
    return docs.select(
        F.col("source").alias("scan_id"), "doc_id",
        F.concat(F.when(doc % 2 == 0, commit).otherwise(F.lit("")), diff_text(doc, F.col("text"))).alias("text"),
    )


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled case per document: its code followed by the document's text."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    nth = F.col("doc_id") % len(CASES)
    return docs.select(
        F.concat_ws("-", _pick([c.case_id for c in CASES], nth), F.col("doc_id").cast("string"))
        .alias("id"),
        _pick([c.category for c in CASES], nth).alias("category"),
        _pick([c.rule_id for c in CASES], nth).isNotNull().alias("expected_vulnerability"),
        _pick([c.rule_id for c in CASES], nth).alias("expected_rule_id"),
        _pick([c.file_path for c in CASES], nth).alias("file_path"),
        F.concat_ws("\n", _pick([c.code for c in CASES], nth), F.col("text")).alias("code"),
    )


def _prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(text, F.lit("\n"), F.lit("\n" + prefix)))


def diff_text(doc_id: Column, text: Column) -> Column:
    """A commit touching the document's file: the text as context, head and tail added.

    Every seventh diff has a second hunk repeating the tail, every fifth also deletes
    a file, every third starts with commit metadata, every eleventh is a binary change.
    """
    path = file_path(doc_id)
    number = doc_id.cast("string")
    opening = F.when(
        doc_id % 3 == 0, F.concat(F.lit("commit "), F.md5(number), F.lit("\n\n    change\n\n"))
    ).otherwise(F.lit(""))
    header = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path,
        F.lit("\n+++ b/"), path, F.lit("\n"),
    )
    start = doc_id % 40 + 1
    first = F.concat(
        F.lit("@@ -1,3 +"), start.cast("string"), F.lit(",9 @@ section\n"),
        _prefixed(head(doc_id), "+"), F.lit("\n-old line\n"), _prefixed(text, " "), F.lit("\n"),
        _prefixed(tail(doc_id), "+"), F.lit("\n"),
    )
    second = F.when(
        doc_id % 7 == 0,
        F.concat(
            F.lit("@@ -900 +"), (start + 900).cast("string"), F.lit(" @@\n"),
            _prefixed(tail(doc_id), " "), F.lit("\n+eval(msg);\n\\ No newline at end of file\n"),
        ),
    ).otherwise(F.lit(""))
    deleted = F.when(
        doc_id % 5 == 0,
        F.lit("diff --git a/gone.ts b/gone.ts\n--- a/gone.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n"
              "-eval(msg)\n"),
    ).otherwise(F.lit(""))
    binary = F.when(
        doc_id % 11 == 0,
        F.lit("diff --git a/x.bin b/x.bin\nBinary files a/x.bin and b/x.bin differ\n"),
    ).otherwise(F.lit(""))
    return F.concat(opening, binary, header, first, second, deleted)


def diffs(spark: SparkSession, folder: str) -> DataFrame:
    """``diffs(scan_id, diff_text)``: one push per document."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    doc = F.col("doc_id")
    return docs.select(
        F.concat_ws("/", "source", doc.cast("string")).alias("scan_id"),
        diff_text(doc, F.col("text")).alias("diff_text"),
    )


def chat_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chat turns written out as the role / content literals of a Python prompt."""
    turns = spread(table(spark, folder, "conversations"))
    return turns.select(
        F.lit("conversations").alias("scan_id"),
        F.concat(
            F.lit("chat/c"), F.col("conv_id").cast("string"), F.lit("_"),
            F.col("turn").cast("string"), F.lit(".py"),
        ).alias("file_path"),
        F.concat(
            F.lit('m = {"role": "'), "role", F.lit('", "content": f"""'), "text",
            F.when(F.col("turn") % 2 == 0, F.lit(" {user_input}")).otherwise(F.lit(" {user_id}")),
            F.lit('"""}'),
        ).alias("content"),
    )


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "pages"))
    return pages.select(
        F.lit("pages").alias("scan_id"),
        F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html"))
        .alias("file_path"),
        F.col("html").alias("content"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Stored model responses for the diff scans, from the labels of their documents.

    Broken, empty and incomplete bodies are mixed in by document.
    """
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "source")
    doc = F.col("doc_id")
    verdict = (
        F.when(F.col("toxic") == 1, F.lit("CONFIRMED_VULNERABILITY"))
        .when(F.col("quality") == 1, F.lit("FALSE_POSITIVE"))
        .otherwise(F.lit("NEEDS_INVESTIGATION"))
    )
    rule = _pick(["AIS-002", "AIS-007", "SEC-001", "MCP-004"], doc % 4)

    def one(line: Column, patch: Column) -> Column:
        return F.concat(
            F.lit('{"ruleId":"'), rule, F.lit('","line":'), line.cast("string"),
            F.lit(',"verdict":"'), verdict, F.lit('","confidence":0.'),
            (doc % 89 + 10).cast("string"), F.lit(',"reasoning":"seen | in '),
            doc.cast("string"), F.lit('","suggestedPatch":"'), patch, F.lit('"}'),
        )

    second = F.when(
        doc % 2 == 0, F.concat(F.lit(","), one(doc % 40 + 902, F.lit("")))
    ).otherwise(F.lit(""))
    analysis = F.concat(
        F.lit('"findingsAnalysis":['), one(doc % 40 + 1, F.lit("fixed();")), second, F.lit("]")
    )
    advice = F.lit(',"architecturalRecommendations":["rotate keys","pin versions"]')
    body = (
        F.when(doc % 17 == 0, F.lit(""))
        .when(doc % 17 == 1, F.lit('{"summary": "cut'))
        .when(doc % 17 == 2, F.lit('{"summary":""}'))
        .otherwise(
            F.concat(
                F.lit('{"summary":"review of '), doc.cast("string"), F.lit('",'), analysis,
                F.when(doc % 3 == 0, F.lit("")).otherwise(advice), F.lit("}"),
            )
        )
    )
    return labels.join(docs, "doc_id").select(
        F.concat_ws("/", "source", doc.cast("string")).alias("scan_id"), body.alias("response_json")
    )


def pushes(spark: SparkSession, folder: str) -> DataFrame:
    """Push events, each naming the document whose diff it brings; every tenth comes twice."""
    events = table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id"
    )
    n_docs = table(spark, folder, "documents").agg((F.max("doc_id") + 1).alias("n_docs"))
    keyed = events.withColumn("diff_id", F.col("event_id") % n_docs.scalar())
    copies = F.when(F.col("event_id") % 10 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return keyed.withColumn("delivery", F.explode(copies))


def push_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """The diffs that ``pushes`` name: (diff_id, diff_text)."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(
        F.col("doc_id").alias("diff_id"), diff_text(F.col("doc_id"), F.col("text")).alias("diff_text")
    )
