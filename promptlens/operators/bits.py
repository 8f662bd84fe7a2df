"""A filter of bounded size over a set of keys, to settle most rows without moving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2^20 words of 64 bits, 8 MB of them at most: broadcast whatever the number of keys.
WORDS = 1 << 20


def _bit(h: Column) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """One bit per key, as rows (__word, __bits)."""
    h = F.xxhash64(F.col(key))
    return (keys.select(F.pmod(h, F.lit(WORDS)).alias("__word"),
                        F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h)).alias("__bit"))
            .groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))


def maybe_in(df: DataFrame, key: str, bits: DataFrame, flag: str) -> DataFrame:
    """Adds boolean ``flag``: false where ``key`` is certainly not among the filter's keys."""
    h = F.xxhash64(F.col(key))
    return (df.withColumn("__word", F.pmod(h, F.lit(WORDS)))
            .join(F.broadcast(bits), "__word", "left")
            .withColumn(flag, F.coalesce(F.getbit(F.col("__bits"), _bit(h)) == 1, F.lit(False)))
            .drop("__word", "__bits"))
