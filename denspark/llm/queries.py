"""The queries of this subpackage, one for each operator, and their DuckDB statements."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denspark.llm.decontamination import find_items
from denspark.llm.embeddings import near_duplicate_vectors
from denspark.llm.html import extract_main_text
from denspark.llm.jaccard import similar_documents
from denspark.llm.language import identify
from denspark.llm.language_model import score_documents
from denspark.llm.packing import pack
from denspark.llm.shards import shard
from denspark.storage import shared_folder
from denspark.llm.substrings import remove_repeats
from denspark.llm.transcripts import conversations, parse_transcripts, train_roles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary, the same file on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_documents(docs, percent=80, k=5).select("row.doc_id", "n_shingles", "component_id")


def op2_class_model_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, folds=10, held_out=0).select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = pack(docs, tokenizer_path(), size=1024, end_id=2)
    return placed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return near_duplicate_vectors(vectors, threshold=0.9).select("row.vec_id", "n_links", "component_id", "kept", "recall")


def op5_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from the compacted shards."""
    root = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    stored = shard(table(spark, sf_dir, "documents"), root, target=128 << 20, fanout=4)
    return stored.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs, min_words=20, as_is=False)
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("row.page_id", "row.url", "text", "n_chars")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as plain transcripts, their roles recovered without the role column, and rendered alike; a quarter of them isn't learned from."""
    plain = conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    model = train_roles(plain.where(~held_out))
    parsed = parse_transcripts(plain.select("conv_id", held_out.alias("held_out"), "transcript"), model)
    return parsed.select("row.conv_id", "row.held_out", F.size("roles").cast("long").alias("n_turns"), F.array_join("roles", ",").alias("roles"), "rendered")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_items(docs, table(spark, sf_dir, "benchmark")).select("row.doc_id", "item_id", "edits", "start", "end")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs, folds=4, held_out=2).select("row.doc_id", "held_out", "lang_pred", "score", "share")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_class_model_scoring": op2_class_model_scoring,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_size_tiered_sharding": op5_size_tiered_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op5_size_tiered_sharding": "select doc_id, lang, source, n_chars, octet_length(encode(text))::bigint as n_bytes, md5(text) as text_md5 from documents",
}
