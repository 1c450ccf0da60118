"""A blocked Bloom filter made of plain columns: built by bit_or, tested by one broadcast join.

Every key sets `BITS` bits inside one 64-bit word, so a filter is a table (word, bits) of at most
2**log2_words rows whatever the number of keys; that is the proven bound under which it is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Bits set for each key; with up to 8 keys a word about 3 % of absent keys pass.
BITS = 4
#: Words of a filter unless the caller says otherwise: 2**18 rows of 12 bytes, 3 MB.
LOG2_WORDS = 18
#: No filter may be larger than this: 2**22 rows of 12 bytes are 50 MB.
MAX_LOG2_WORDS = 22


def words_for(keys: int) -> int:
    """log2_words for so many distinct keys, 8 a word. Beyond 8 * 2**MAX_LOG2_WORDS keys the filter fills up and lets more
    and more absent keys pass; what follows it must be exact, so only its use is lost, never a row."""
    return min(MAX_LOG2_WORDS, max(10, math.ceil(math.log2(max(keys, 1) / 8))))


def _word(key: Column, log2_words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("word"), key), F.lit(1 << log2_words)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def build(keys: DataFrame, key: str, log2_words: int = LOG2_WORDS) -> DataFrame:
    """The filter of keys[key] as (bloom_word int, bloom_bits long); nulls are no keys.

    The aggregate combines on the map side, so at most 2**log2_words rows leave each task.
    An empty table gives an empty filter, in which nothing is contained.
    """
    if not 1 <= log2_words <= MAX_LOG2_WORDS:
        raise ValueError(f"log2_words must lie in 1..{MAX_LOG2_WORDS}")
    k = F.col(key)
    return keys.where(k.isNotNull()).groupBy(_word(k, log2_words).alias("bloom_word")).agg(F.bit_or(_mask(k)).alias("bloom_bits"))


def flag(rows: DataFrame, key: Column, bloom: DataFrame, into: str, log2_words: int = LOG2_WORDS) -> DataFrame:
    """rows with the boolean `into`: false only if the key is certainly not in the filter.

    A null key gives false. Keys must have the type the filter was built from.
    """
    names = rows.columns
    probe = rows.withColumn("__w", _word(key, log2_words)).withColumn("__m", _mask(key)).withColumn("__k", key.isNotNull())
    side = bloom.select(F.col("bloom_word").alias("__bw"), F.col("bloom_bits").alias("__bb"))
    joined = probe.join(F.broadcast(side), F.col("__w") == F.col("__bw"), "left")
    hit = F.col("__k") & F.coalesce(F.col("__bb").bitwiseAND(F.col("__m")) == F.col("__m"), F.lit(False))
    return joined.select(*[F.col(f"`{n}`") for n in names], hit.alias(into))
