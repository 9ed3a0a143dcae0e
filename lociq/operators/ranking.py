"""Keep-first, top-n, and running totals over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociq.session import use_checkpoints

# Largest group that one task sorts for a running total.
GROUP_ROWS = 2_000_000


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows per key in ``order``.

    The constant bound on ``row_number`` lets Spark cut every map task's output to n rows
    per key before the shuffle (WindowGroupLimit), so a hot key costs no more than others.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row per key."""
    return top_per_key(df, keys, order, 1)


def _largest_group(df: DataFrame, group: Sequence[str]) -> int:
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def _sliced(df: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Rows in order over many tasks, numbered slices, checkpointed: a rerun must not number anew."""
    use_checkpoints(df.sparkSession)
    return (
        df.withColumns({f"_t_{name}": value for name, value in totals.items()})
        .repartitionByRange(*order)
        .withColumn("_slice", F.spark_partition_id())
        .checkpoint()
    )


def _lifts_of_all(sliced: DataFrame, totals: Sequence[str]) -> DataFrame:
    """What the slices before each slice sum to; one row a slice, so the driver adds them up."""
    sums = sliced.groupBy("_slice").agg(*[F.sum(f"_t_{name}").alias(f"_b_{name}") for name in totals])
    rows, before = [], [None] * len(totals)
    for row in sorted(sums.collect()):
        rows.append((row[0], *before))
        before = [b if s is None else s if b is None else b + s for b, s in zip(before, row[1:])]
    return sliced.sparkSession.createDataFrame(rows, sums.withColumnRenamed("_slice", "_lift").schema)


def _lifts_of_groups(sliced: DataFrame, group: Sequence[str], totals: Sequence[str]) -> DataFrame:
    """The same within each group; a slice boundary is crossed by at most one group, so these are
    fewer rows than slices."""
    before = Window.partitionBy(*group).orderBy("_slice")
    named = [F.col(g).alias(f"_g_{g}") for g in group]
    return (
        sliced.groupBy(*group, "_slice")
        .agg(*[F.sum(f"_t_{name}").alias(f"_s_{name}") for name in totals])
        .withColumns(
            {
                f"_b_{name}": F.sum(f"_s_{name}").over(before.rowsBetween(Window.unboundedPreceding, -1))
                for name in totals
            }
        )
        .withColumn("_nth", F.row_number().over(before))
        .filter("_nth > 1")
        .select(*named, F.col("_slice").alias("_lift"), *[f"_b_{n}" for n in totals])
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    totals: dict[str, Column],
    group_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``totals`` within ``group`` along a total ``order``.

    Rows are range-partitioned by (group, order) so that a group, or the whole table where there
    are no groups, spans many tasks; each slice is summed alone and lifted by the slices before
    it.  Only where every group has at most ``group_rows`` rows, each sorts its groups in one
    task instead.  ``largest`` is the size of the largest group where already known; otherwise
    it is counted.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    group = list(group)
    if group and (_largest_group(df, group) if largest is None else largest) <= limit:
        frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(frame) for name, value in totals.items()})

    sliced = _sliced(df, [*[F.col(g) for g in group], *order], totals)
    lifts = _lifts_of_groups(sliced, group, list(totals)) if group else _lifts_of_all(sliced, list(totals))
    local = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumns({name: F.sum(f"_t_{name}").over(local) for name in totals})
    match = summed["_slice"] == lifts["_lift"]
    for g in group:
        match = match & F.equal_null(summed[g], lifts[f"_g_{g}"])
    lifted = summed.join(F.broadcast(lifts), match, "left")
    lifted = lifted.withColumns(
        {name: F.col(name) + F.coalesce(F.col(f"_b_{name}"), F.lit(0)) for name in totals}
    )
    drop = [f"_t_{n}" for n in totals] + [f"_b_{n}" for n in totals] + [f"_g_{g}" for g in group]
    return lifted.drop(*drop, "_slice", "_lift")


def rank_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    group_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Sequential rank 1..n of every row of every group."""
    ranked = running_totals(df, group, order, {name: F.lit(1)}, group_rows, largest)
    return ranked.withColumn(name, F.col(name).cast("bigint"))
