"""A corpus from raw documents to packed sequences, as a chain of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denspark.llm.decontamination import count_items
from denspark.llm.jaccard import similar_documents
from denspark.llm.language import UNKNOWN, identify
from denspark.llm.packing import pack
from denspark.llm.queries import table, tokenizer_path
from denspark.storage import written
from denspark.llm.substrings import remove_repeats


#: Share of a text's bytes that the network has to label with one language; under it, the text is in none.
#: The least share of a document of the test tables is 0.45.
ONE_LANGUAGE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter go, and those of whose bytes no language has a share of ONE_LANGUAGE.

    Null texts have no letter.  Null and repeated ids are rows like others.  Without any
    labelled document all texts with a letter stay.  An empty table stays empty.
    """
    named = F.col("lang_pred") != UNKNOWN
    known = identify(docs, with_text=True).where((named & (F.col("share") >= ONE_LANGUAGE)) | (~named & F.col("text").rlike("\\p{L}")))
    return known.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id, one without an id only if none has one; ties by a hash of the row.

    Rows that share an id but no text are groups of their own; equal rows are one.  Null and
    empty texts are like nothing else.  An empty table stays empty.
    """
    keyed = docs.withColumn("row_key", F.xxhash64(*docs.columns))
    component = similar_documents(keyed.select("row_key", "doc_id", "text"), id_col="row_key")
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id").alias("doc_id"), F.col("row.row_key").alias("row_key")))
    kept = written(component.groupBy("component_id").agg(first.alias("x")).select("x.row_key"), "kept")  # so that the join can split what meets in one key
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that stand earlier; a document that is nothing else goes.

    Null texts and rows without an id stay as they are.  An empty table stays empty.
    """
    cut = remove_repeats(docs, min_words=20).where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    changed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long")}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; null and empty texts hold none. An empty table, or benchmark, changes nothing."""
    clean = count_items(docs, table(spark, sf_dir, "benchmark")).where("items = 0")
    return clean.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences; a null text is its end alone, an empty table has no piece."""
    placed = pack(docs.select("doc_id", "text"), tokenizer_path(), size=1024, end_id=2)
    return placed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL can't express a trained language model; tests hold the chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
