"""A Bloom filter as a small table: drops rows that no wanted key can match, before any shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Bits per wanted key, with two places a key: about one row in 70 passes by mistake.
BITS_PER_KEY = 16
# Most 64-bit words of a filter, so 16 MB of (word, bits); more keys only make it let more through.
MAX_WORDS = 1 << 20


def _place(key: Column, nth: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(nth)), F.lit(64 * words))


def bloom_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(word, bits)`` of the keys' places, and the number of words; at most ``MAX_WORDS`` rows."""
    wanted = max(1, keys.count()) * BITS_PER_KEY / 64
    words = min(MAX_WORDS, 1 << math.ceil(math.log2(wanted)) if wanted > 1 else 1)
    places = keys.select(F.explode(F.array(*[_place(F.col(key), n, words) for n in (1, 2)])).alias("_p"))
    word, bit = F.shiftright("_p", 6), F.expr("shiftleft(cast(1 as bigint), cast(_p & 63 as int))")
    return places.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), words


def may_contain(
    df: DataFrame, key: str, keys: DataFrame, keys_column: str | None = None, filter: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """Rows whose key may be among ``keys``: all that are, and a few that are not.

    The filter's size is bounded, so it is broadcast and ``df`` does not move.  Null keys go.
    ``filter`` is the result of :func:`bloom_filter` where the caller has it.
    """
    found, words = filter or bloom_filter(keys, keys_column or key)
    out = df.filter(F.col(f"`{key}`").isNotNull())
    for nth in (1, 2):
        place = _place(F.col(f"`{key}`"), nth, words)
        named = found.select(F.col("word").alias(f"_word{nth}"), F.col("bits").alias(f"_bits{nth}"))
        out = out.withColumn(f"_place{nth}", place)
        out = out.join(F.broadcast(named), F.shiftright(f"_place{nth}", 6) == F.col(f"_word{nth}"))
        out = out.filter(F.expr(f"getbit(_bits{nth}, cast(_place{nth} & 63 as int)) = 1"))
    return out.drop(*[f"_{c}{n}" for c in ("place", "word", "bits") for n in (1, 2)])
