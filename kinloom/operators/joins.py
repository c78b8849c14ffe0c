"""Joins whose hot keys are split and whose broadcasts are measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of at most so many measured bytes may be broadcast.
BROADCAST_BYTES = 48 << 20
#: A key is heavy if it has more than HEAVY_ROWS rows and more than one HEAVY_KEYS-th of all; so at most HEAVY_KEYS keys are.
HEAVY_ROWS, HEAVY_KEYS = 256, 20_000


def measured(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take: 16 and 8 a column for each, and what texts and arrays hold."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    sizes += [F.greatest(F.size(c), F.lit(0)) * 48 for c, kind in df.dtypes if kind.startswith("array")]
    return df.agg(F.sum(sum(sizes, F.lit(16 + 8 * len(df.columns))).cast("long"))).first()[0] or 0


def side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for a broadcast if it is measured to be small; else both sides of its join are shuffled."""
    return F.broadcast(df) if measured(df) <= limit else df


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, parts): the heavy keys of ``rows``, at most HEAVY_KEYS, and into how many parts each is dealt."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))
    bound = F.greatest(F.lit(HEAVY_ROWS), F.floor(F.col("_all") / HEAVY_KEYS))
    return counts.crossJoin(total).where(F.col("_n") > bound).select(key, F.ceil(F.col("_n") / bound).cast("int").alias("parts"))


def split_join(few: DataFrame, rows: DataFrame, few_key: str, key: str, heavy: DataFrame, spread: Column) -> DataFrame:
    """Inner join of ``few`` and ``rows`` on ``few_key`` = ``key``, in which heavy keys of ``rows`` are dealt out.

    ``heavy``: of heavy_keys(rows, key). ``spread``: what a heavy key's rows are dealt by; the rows of ``few`` with a heavy
    key are repeated for each of its parts, so no pair is lost or made twice.
    """
    held = F.broadcast(heavy.select(F.col(key).alias("_heavy"), "parts"))
    dealt = rows.join(held, F.col(key) == F.col("_heavy"), "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("parts", F.lit(1)))).drop("_heavy", "parts")
    copies = few.join(held, F.col(few_key) == F.col("_heavy"), "left")
    copies = copies.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("_heavy", "parts")
    return copies.join(dealt, (F.col(few_key) == F.col(key)) & (F.col("_of") == F.col("_part"))).drop("_of", "_part")


#: Bits of one bitmap (fixed: what Spark's bitmap functions make), and bits for each key of a filter.
BITMAP, BITS_A_KEY = 1 << 15, 10


def key_filter(keys: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, int] | None:
    """(_block, _bits) of the hashes of all keys and how many bits there are; None if it would take more than ``limit`` bytes.

    Bitmaps are made and merged by an aggregate. A key that is there always has its bit; another one has in about a tenth of
    cases.
    """
    bits = BITMAP * max(1, -(-keys.count() * BITS_A_KEY // BITMAP))
    if bits // 8 > limit:
        return None
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.where(F.col(key).isNotNull()).select(F.floor(place / BITMAP).alias("_block"), F.pmod(place, F.lit(BITMAP)).alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")), bits


def may_hold(rows: DataFrame, key: str, made: tuple[DataFrame, int] | None, name: str) -> DataFrame:
    """``rows`` with ``name``: false where the key is surely not among those of key_filter(); nothing is shuffled for it."""
    if made is None:
        return rows.withColumn(name, F.lit(True))
    table, bits = made
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    bit = F.pmod(place, F.lit(BITMAP)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    return rows.withColumn("_block", F.floor(place / BITMAP)).join(F.broadcast(table), "_block", "left").withColumn(name, found).drop("_block", "_bits")
