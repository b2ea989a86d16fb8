"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Null texts are rejected by the first stage. Every stage but the last returns the columns of its
input; the last returns token counts and digests of ids and decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, contamination, jaccard, langid, paragraphs
from palisade.llm.queries import held_out
from palisade.llm.store import private, saved, text_key

#: A document goes when less than half of it, by letters and by chance, is in one language.
MIN_LANGUAGE_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, most of them in one language that the model knows."""
    model = langid.fit(docs.where(~held_out()))
    if not model.langs:  # nothing to learn from: nothing can be told, nothing goes
        return docs
    return langid.kept(docs, model, MIN_LANGUAGE_SCORE)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates; rows without an id come last in it."""
    first_id, first_row = private("id", "row")
    first = jaccard.first_rows(docs).select(F.col("doc_id").alias(first_id), F.col("row").alias(first_row))
    same = F.col("doc_id").eqNullSafe(F.col(first_id)) & (text_key() == F.col(first_row))
    return docs.join(first, same, "left_semi").dropDuplicates(["doc_id", "text"])


def trimmed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that earlier documents have are cut out."""
    return paragraphs.without_repeats(docs, paragraphs.repeats(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.without_contaminated(docs, saved(contamination.contaminated_rows(docs, items)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as digests, and that of the text decoded from them."""
    decoded = bpe.round_trip(docs)
    return decoded.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard", distinct),
    ("substring_dedup", trimmed),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]
#: Stages 1 and 5 (and the classes of 2) cannot be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
