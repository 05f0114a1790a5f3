"""What several corpus operators share: written intermediate tables and text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwatch.functions.shared import scratch as scratch
from skeinwatch.functions.shared import shared_dir as shared_dir
from skeinwatch.functions.shared import written as written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a key bitmap: about eight a key, within these bounds (32 KB to 8 MB broadcast).
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 26


def _bitmap(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    """A bitmap of the keys, one bit a hash value, in rows of a bucket each (__b, __bits); which of them is a row's, and
    whether its bit is set there."""
    bits = LEAST_BITS
    while bits < min(8 * keys.count(), MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    held = keys.select(F.bitmap_bucket_number(place(key)).alias("__b"), F.bitmap_bit_position(place(key)).alias("__p"))
    held = held.groupBy("__b").agg(F.bitmap_construct_agg("__p").alias("__bits"))
    at = F.bitmap_bit_position(place(df[key])).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.broadcast(held), F.bitmap_bucket_number(place(df[key])) == F.col("__b"), F.getbit(byte, F.pmod(at, F.lit(8))) == 1


def maybe_among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df with `__maybe`: false only where its key is surely not among those of `keys` (a written table).

    One bit a hash value, so that most rows of a large table needn't be shuffled to a join with few keys. The bitmap has a
    bounded size: beyond some 10^7 keys it fills up and spares less and less, but never drops a key. Nulls are maybe among
    them only if keys hold a null.
    """
    held, bucket, found = _bitmap(df, keys, key)
    return df.join(held, bucket, "left").withColumn("__maybe", F.coalesce(found, F.lit(False))).drop("__b", "__bits")


def among_maybe(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df that maybe_among marks; the others don't leave the join."""
    held, bucket, found = _bitmap(df, keys, key)
    return df.join(held, bucket & found, "left_semi")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(items: Column, size: int) -> Column:
    """An array cut into arrays of at most size items (one empty array of none)."""
    starts = lambda r: F.sequence(F.lit(1), F.greatest(F.size(r), F.lit(1)), F.lit(size))
    return bound(items, lambda r: F.transform(starts(r), lambda i: F.slice(r, i, size)))


def folded(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
    kind: str,
    last: Callable[[Column], Column] | None = None,
    size: int = 512,
) -> Column:
    """All that step gives on the way through items: step(state, item) is the next state and an array of results (of type
    array<kind>); last(state) gives those at the end. Results are gathered in chunks, so that a text of very many matches
    doesn't copy what it has so far with each."""
    empty = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["out"], out).alias("out"))

    def chunk(acc, part):
        inner = F.aggregate(part, F.struct(acc["s"].alias("s"), empty.alias("out")), one)
        return bound(inner, lambda i: F.struct(i["s"].alias("s"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    begin = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    end = (lambda acc: F.concat(F.flatten(acc["out"]), last(acc["s"]))) if last else (lambda acc: F.flatten(acc["out"]))
    return F.aggregate(chunks(items, size), begin, chunk, end)


def cuts(text: Column, spans: Column, size: int = 128) -> Column:
    """The pieces of text at spans (start, end in code points; sorted), each found from the start of its own stretch of
    text: a substring counts characters from the start of the string that it is taken from."""

    def stretch(part):
        first, to = F.element_at(part, 1)["start"], F.element_at(part, -1)["end"]
        own = bound(
            F.substring(text, first + 1, to - first),
            lambda t: F.transform(part, lambda s: F.substring(t, s["start"] - first + 1, s["end"] - s["start"])),
        )
        return F.when(F.size(part) > 0, own).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(chunks(spans, size), stretch))


def word_count(text: Column) -> Column:
    """Words (runs of non-space characters) of a text; null and blank texts have none."""
    trimmed = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def field(value: Column) -> Column:
    """A value as text that can stand beside others: its UTF-8 byte count, a colon and the value; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(batches, rows: int = 512):
    """Arrow batches cut into smaller ones, so that what a task makes of a batch stays small beside the batch itself."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def utf8_slices(texts, budget: int):
    """Index ranges of a list of texts so that each range holds at most budget characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > budget:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
