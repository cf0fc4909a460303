"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import public_tokenizers
from txnrisk.llm import (
    fill_in_middle,
    language_id,
    multiset_hash,
    packing,
    prefix_trie,
    preferences,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    token_counts,
    unigram,
    url_filters,
)
from txnrisk.llm.docstats import COUNTS
from txnrisk.llm.labelled import document_statistics, is_held_out

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHARDS = 24
WINDOW = 4096
GOOD = 0.7
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), gram=3, max_bits=2)
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_digits("fingerprint").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_rules.fit(docs, table(spark, folder, "labels"))
    judged = quality_rules.judge_documents(docs, model)
    return judged.select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "score", "kept")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Packing with the production parameters, and the checksum of every piece."""
    path = WORD_BPE
    pieces = packing.pack(docs, lambda texts: packing.word_tokens(path).ids(texts), end_id=2, size=WINDOW)
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, action)")
    judged = url_filters.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    pairs = preferences.echo_pairs(table(spark, folder, "conversations"))
    made = preferences.format_pairs(pairs)

    def listed(spans: str) -> Column:
        parts = F.transform(spans, lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string")))
        return F.array_join(parts, " ").alias(spans)

    return made.select(
        "pair_id", "prompt_turns", "prompt", "chosen", "rejected", listed("chosen_spans"), listed("rejected_spans")
    )


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), PIECES)
    return counted.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > WINDOW).alias("over_limit")
    )


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    told = {"n_bytes": F.octet_length(text), "text_hash": F.xxhash64(text)}
    docs = table(spark, folder, "documents").select("doc_id", "text").withColumns(told)
    coded = unigram.encode_documents(docs, PIECES, keep=tuple(told))
    coded = coded.withColumns({"n_ids": F.size("ids").cast("long"), "ids_hash": F.xxhash64("ids")})
    back = unigram.decode_documents(coded, PIECES, keep=("n_ids", "ids_hash", *told))
    same = (F.octet_length("text") == F.col("n_bytes")) & (F.xxhash64("text") == F.col("text_hash"))
    return back.select(F.col("id").alias("doc_id"), "n_ids", "ids_hash", same.alias("round_trip"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    stats = document_statistics(table(spark, folder, "documents"))
    model = quality_classifier.fit(stats, table(spark, folder, "labels"), cut_score=GOOD)
    scored = quality_classifier.score_documents(stats, model)
    return scored.select(
        F.col("id").alias("doc_id"),
        is_held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = multiset_hash.compare_with_edits(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(rows, ["doc_id", "size", "text_crc32"], SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learn = docs.select("text", "lang", (~is_held_out("doc_id")).alias("learn"))
    prototypes = language_id.fit(learn, train="learn")
    found = language_id.predict(docs, prototypes)
    return found.select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "lang_pred", "score")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality_rules": op2_quality_rules,
        "op3_packing": op3_packing,
        "op4_url_filters": op4_url_filters,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_token_counts": op6_token_counts,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_fingerprints": op9_fingerprints,
        "op10_sharding": op10_sharding,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_language_id": op12_language_id,
        "op13_prefix_trie": op13_prefix_trie,
    }
