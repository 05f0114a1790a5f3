"""From raw documents to training batches: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwatch.llm import language_id, mixing, packing, secrets, simhash, token_counts
from skeinwatch.llm.common import table, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the rank-order profiles recognise."""
    return language_id.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicated(docs, size=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources up to twice, so that sources weigh more evenly."""
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    return mixing.mixed(whole, repetition=2.0).select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in padded batches of optimal length buckets."""
    return packing.pack(docs, vocabulary=token_counts.VOCABULARY)


STAGES = [
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]
#: Rank-order profiles, XXH64 fingerprints and the length DP have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i + 1}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
