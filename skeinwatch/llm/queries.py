"""The operators' registered queries over their whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwatch.llm import ann_forest, chat, exact_topk, language_id, merkle, mixing, packing, prefix_trie, secrets, sharding, simhash, token_counts, url_filter
from skeinwatch.llm.common import table
from skeinwatch.llm.oracles import ORACLE as FIRST
from skeinwatch.llm.tree_oracles import ORACLE as TREES

EVERY = 20  # a search asks for the rows whose vec_id this divides


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_forest.nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.exact_topk(rows, rows.where(F.col("vec_id") % EVERY == 0))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def url_filter_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same judgement with redirects: every third English page has moved to its German address."""
    pages = table(spark, sf_dir, "pages")
    moved = pages.where("page_id % 3 = 0 and url like '%/en/%'").select(F.col("url").alias("src"), F.replace("url", F.lit("/en/"), F.lit("/de/")).alias("dst"))
    return url_filter.judge_urls(pages, redirects=moved)


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=token_counts.VOCABULARY)


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op10_chat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return chat.chat_digest(said.unionByName(planted))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(table(spark, sf_dir, "documents"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_digest(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f for f in (
        op1_language_id,
        op2_token_counts,
        op3_ann_forest,
        op4_simhash_golay,
        op5_exact_topk,
        op6_secret_scan,
        op7_url_filter,
        op8_length_buckets,
        op9_temperature_mix,
        op10_chat_paths,
        op11_merkle_manifest,
        op12_jump_shards,
        op13_prefix_trie,
        url_filter_redirects,
    )
}
ORACLE = {**FIRST, **TREES}
