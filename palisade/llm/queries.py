"""Registered queries over the new tables: ``QUERIES`` by name, ``ORACLES`` where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import (
    bpe, byte_bpe, chat, contamination, fingerprints, hard_negatives, jaccard, langid, oracle, paragraphs,
    prefix_trie, shards, token_counts, urls,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 2048
SHARDS = 8
CONTROL_CONVERSATION = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]
URL_RULES = (
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark, folder):
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_bpe_round_trip(spark, folder):
    encoded = bpe.encode_documents(table(spark, folder, "documents"))
    decoded = bpe.decode_documents(encoded)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op3_ngram_jaccard(spark, folder):
    return jaccard.similarity_classes(table(spark, folder, "documents"))


def op4_chat_format(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(given.unionByName(extra))
    digests = chat.read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.encode(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"),
            256,
        ).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
    return digests


def op5_fingerprints(spark, folder):
    return fingerprints.fingerprint_pairs(table(spark, folder, "documents"))


def op6_url_filter(spark, folder):
    judged = urls.judge_urls(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_paragraph_dedup(spark, folder):
    return paragraphs.repeats(table(spark, folder, "documents")).drop("row")


def op8_byte_shards(spark, folder):
    placed = shards.byte_shards(table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def held_out():
    """Rows that are not learned from; a row without an id is none of them."""
    part = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(3))
    return F.coalesce(part == 1, F.lit(False))


def op9_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark, folder):
    counted = token_counts.token_counts(table(spark, folder, "documents"))
    return counted.select("*", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_hard_negatives(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.valid_rows(table(spark, folder, "embeddings"), moved)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark, folder):
    """Every conversation opens with up to three turns of the first one of its twenty."""
    sequences = prefix_trie.turn_sequences(table(spark, folder, "conversations"))
    conv = F.col("conv_id")
    opening = F.crc32(F.encode(conv.cast("string"), "UTF-8")) % 4
    return prefix_trie.prefix_nodes(prefix_trie.with_shared_openings(sequences, conv - conv % 20, opening, 3))


def op13_byte_bpe(spark, folder):
    decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(table(spark, folder, "documents")))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_format": op4_chat_format,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filter": op6_url_filter,
    "op7_paragraph_dedup": op7_paragraph_dedup,
    "op8_byte_shards": op8_byte_shards,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = oracle.ORACLES
