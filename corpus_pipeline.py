"""From raw documents to packed training sequences: quality, line and near-duplicate filters, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import kneser_ney, line_runs, mixing, near_duplicates, packing
from kinfold.llm.common import Scratch, by_merge
from kinfold.llm.queries import trusted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's bound go; those without text, or in a language without trusted text, stay.  Null
    ids are judged by their text; repeated rows go or stay together; an empty table gives no rows."""
    return kneser_ney.kept_documents(docs, trusted(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or more, and of single lines of 50 words or more, go; a document of which no word is left goes with them.
    Null texts and null ids stay as they are; of equal lines the first by id, then by hash of the text, stays."""
    out = line_runs.drop_repeated_runs(docs, long_words=50)
    out = out.where((F.col("__removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (similarity of 0.8 or more) the document with the smallest id stays.  Null and wordless texts are linked
    with nothing and stay, null ids too; rows that share an id are one document and go or stay together; an empty table gives no rows."""
    gone = near_duplicates.near_duplicates(docs, percent=80, collections=9).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(by_merge(gone), F.col("doc_id") == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; those taken in several passes stand once for each pass.  Null and wordless texts give
    no row, a null source is a source of its own, null ids are kept, rows with one id are separate documents; ties in a source's
    order go by id and text; an empty table gives no rows."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences; nulls, ties and repeated rows as in packing.pack."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL expresses neither the model nor the draws; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
