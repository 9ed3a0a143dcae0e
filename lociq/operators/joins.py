"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lociq.session import staged

# A side is broadcast only when Catalyst's size estimate is at or below this.
BROADCAST_BYTES = 32 * 1024 * 1024
# Rows of one key that a single task takes without being split.
HOT_KEY_ROWS = 4_000_000
# Pairs of one key that a single task makes without being split.
HOT_KEY_PAIRS = 2_000_000_000


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return estimated_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def _hot_keys(
    left: DataFrame, right: DataFrame | None, on: Sequence[str], hot_rows: int, sizes: DataFrame | None = None
) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows or ``HOT_KEY_PAIRS`` pairs, and the slices of each side.

    Every such key is listed.  They are fewer than rows / ``hot_rows`` plus the square root of
    rows squared / pairs, which is what bounds the table that is broadcast.
    """
    if sizes is None:
        sides = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        if right is not None:
            sides = sides.unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        sizes = sides.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    else:
        sizes = sizes.select(*on, "_l", F.lit(0).cast("bigint").alias("_r"))
    pairs = F.col("_l").cast("double") * F.col("_r")
    hot = sizes.filter((F.greatest("_l", "_r") > hot_rows) | (pairs > HOT_KEY_PAIRS))
    own = F.greatest(F.lit(1), F.ceil(F.col("_r") / hot_rows))
    # As many slices on the left as its rows ask for, or as the pairs ask for beyond the right's.
    by_pairs = F.least(F.col("_l"), F.ceil(pairs / HOT_KEY_PAIRS / own))
    lefts = F.greatest(F.lit(1), F.ceil(F.col("_l") / hot_rows), by_pairs)
    hot = staged(hot.select(*on, lefts.cast("int").alias("_ls"), own.cast("int").alias("_rs")), "hot-keys")
    return None if hot.isEmpty() else hot


def _with_hot(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    keys = hot.select(*[F.col(k).alias(f"_h_{k}") for k in on], "_ls", "_rs")
    match = None
    for k in on:
        same = F.equal_null(df[k], keys[f"_h_{k}"])
        match = same if match is None else match & same
    return (
        df.join(F.broadcast(keys), match, "left")
        .drop(*[f"_h_{k}" for k in on])
        .withColumns({"_ls": F.coalesce("_ls", F.lit(1)), "_rs": F.coalesce("_rs", F.lit(1))})
    )


def _row_slice(df: DataFrame, slices: Column) -> Column:
    """Slice of a row.  The input partition takes part in the hash so that copies of one row
    spread out too; partition and content are the same again when a lost task is rerun."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain], F.spark_partition_id()), slices).cast("int")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_rows: int | None = None,
    sized_by: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Shuffled equi-join with the hot keys cut into slices.

    Finding hot keys costs one pre-aggregated count over the key columns.  Where ``left`` is
    itself the result of joins, ``sized_by`` names a cheaper table with the same keys (such as
    the table it started from) to count instead.  ``sizes`` holds the count where the caller has
    it: every key of ``left`` once, with its rows as ``_l``; for joins that slice the left only.

    Inner joins slice both sides of a hot key and meet every pair of slices once.  Outer,
    semi and anti joins slice the left side only, so every left row is still seen once.
    Keys that are not hot get a single slice, which makes the extra key columns constant.
    """
    hot_rows = hot_rows or HOT_KEY_ROWS
    on = list(on)
    inner = how == "inner"
    if inner and sizes is not None:
        raise ValueError("an inner join counts both sides")
    hot = _hot_keys(left if sized_by is None else sized_by, right if inner else None, on, hot_rows, sizes)
    if hot is None:
        return left.join(right, on, how)

    lhs = _with_hot(left, hot, on)
    lhs = lhs.withColumn("_sl", _row_slice(left, F.col("_ls")))
    rhs = _with_hot(right, hot, on)
    rhs = rhs.withColumn("_sl", F.explode(F.sequence(F.lit(0), F.col("_ls") - 1)))
    if inner:
        lhs = lhs.withColumn("_sr", F.explode(F.sequence(F.lit(0), F.col("_rs") - 1)))
        rhs = rhs.withColumn("_sr", _row_slice(right, F.col("_rs")))
    else:
        lhs = lhs.withColumn("_sr", F.lit(0))
        rhs = rhs.withColumn("_sr", F.lit(0))
    helpers = ["_ls", "_rs"]
    joined = lhs.drop(*helpers).join(rhs.drop(*helpers), on + ["_sl", "_sr"], how)
    return joined.drop("_sl", "_sr")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    hot_rows: int | None = None,
    sized_by: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join a large table to a reference table.

    A right side whose estimate fits is broadcast, so the left side is not shuffled at all;
    a larger one goes through :func:`spread_join`, cut to the keys of the left first where those fit
    instead: a few rows then do not shuffle the whole reference table.  Null keys match nothing.
    """
    on = [on] if isinstance(on, str) else list(on)
    if is_small(right):
        return left.join(F.broadcast(right), on, how)
    if how in ("left", "inner", "left_semi", "left_anti") and is_small(left):
        right = right.join(F.broadcast(left.select(*on).distinct()), on, "left_semi")
    return spread_join(left, right, on, how, hot_rows, sized_by, sizes)
