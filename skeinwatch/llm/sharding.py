"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard follows from its key and the number of shards alone: no ring, no table. The key's columns are written out with
their lengths and hashed (60 bits of an MD5) to the state of a linear congruential generator, whose jumps over the shard
numbers end at the last one below the number of shards. With one more shard a row stays or moves into the new one, and an
n-th of the rows moves.

Null keys are keys like any other (`-`); equal keys share a shard, so one key of very many rows makes one large shard, which
is still many partitions and files here: nothing gathers a shard in one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwatch.functions.ranked import numbered
from skeinwatch.llm.common import bound, field, written

#: Fixed values of the published algorithm: the generator's multiplier and modulus, and the bits that a jump is drawn from.
MULTIPLIER, MODULUS, DRAWN = 2862933555777941757, 1 << 64, 31
KEY_DIGITS = 15  # hex digits of the key's hash
JUMPS = 48  # computed first for every row; a row that isn't done by then (about one in 10^20) goes on as far as needed


def stable_key(*columns: str) -> Column:
    """60 bits of a hash of columns, the same in every engine that knows MD5."""
    digits = F.substring(F.md5(F.concat(*(field(F.col(c)) for c in columns))), 1, KEY_DIGITS)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """The shard (from 0) of a key (a whole number from 0 below 2^64, as decimal(20,0)) among a number of shards."""
    if shards < 1:
        raise ValueError("there must be at least one shard")

    def step(at, _):
        state = (at["state"] * F.lit(Decimal(MULTIPLIER)) + 1) % F.lit(Decimal(MODULUS))
        state = state.cast("decimal(20,0)")
        drawn = F.call_function("div", state, F.lit(Decimal(1 << (64 - DRAWN)))).cast("double") + 1
        ahead = F.floor((at["next"] + 1).cast("double") * (F.lit(float(1 << DRAWN)) / drawn)).cast("long")
        moved = F.struct(state.alias("state"), at["next"].alias("shard"), ahead.alias("next"))
        return F.when(at["next"] < shards, moved).otherwise(at)

    def walk(begin, steps):
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, step)

    begin = F.struct(key.alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    done = lambda at: F.when(at["next"] >= shards, at["shard"]).otherwise(walk(at, shards)["shard"])
    return bound(walk(begin, min(shards, JUMPS)), done).cast("int")


def sharded(rows: DataFrame, keys: list[str], shards: int, name: str = "shard") -> DataFrame:
    """rows with the shard of their keys."""
    return rows.withColumn(name, jump(stable_key(*keys), shards))


def slotted(rows: DataFrame, order: list[str], shard: str = "shard", name: str = "slot") -> DataFrame:
    """rows with their place in their shard, gapless from 0 in the given order (repeated rows in any); writes the rows once."""
    return numbered(rows, order, name, [shard])


def moves(rows: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """shard_before, shard_after, n_rows: what a change of the number of shards moves and leaves."""
    both = sharded(sharded(rows, keys, before, "shard_before"), keys, after, "shard_after")
    return both.groupBy("shard_before", "shard_after").agg(F.count("*").alias("n_rows"))


def write_shards(rows: DataFrame, path: str, keys: list[str], shards: int, files: int = 1) -> None:
    """rows as Parquet, a folder `shard=i` a shard of at most `files` files each (a hash of the whole row deals them, so that
    rows of one key needn't be one file)."""
    hashed = F.pmod(F.xxhash64(*(F.to_json(F.struct(c)) for c in rows.columns)), F.lit(files))
    made = sharded(rows, keys, shards).withColumn("__file", hashed)
    made.repartition(shards * files, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of documents by doc_id. A null text has no bytes: its size is 1
    and its crc32 that of nothing, 0."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    rows = sharded(sharded(rows, ["doc_id"], shards), ["doc_id"], shards + 1, "grown_shard")
    made = slotted(written(rows, "keys"), ["doc_id", "text_crc32", "size"])  # so that texts are read once
    return made.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
