"""From raw documents to packed training sequences: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, near_dedup, packing, substring_dedup
from quarry.llm.common import crc_bucket, read, stage
from quarry.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null ones and those without a letter. Learns like op7, from three quarters of the rows."""
    model = langid.learn(docs.where(crc_bucket("doc_id", 4) != 2))
    return langid.identify(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies (five-word shingles, similarity 0.8 or more) the document of least id."""
    return near_dedup.keep_one(docs, near_dedup.near_duplicates(docs, threshold=0.8))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of 35 words or more out of the texts; n_chars follows; every row stays."""
    done = substring_dedup.remove_repeats(docs, window=35)
    changed = F.col("n_removed") > 0
    done = done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return done.select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain 0.8 or more of a benchmark item's five-word shingles."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary(), room=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", benchmark_leaks),
    ("packing", pack),
]

#: Language profiles and tokens are beyond SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
