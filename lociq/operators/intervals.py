"""Interval-overlap joins on (chromosome, start, end), both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociq.functions.variants import overlap_length, ratio_if_positive
from lociq.operators import joins
from lociq.operators.joins import is_small, lookup_join, spread_join
from lociq.operators.ranking import first_per_key

# Bin widths per level: 16 kb, 256 kb, 4 Mb, 64 Mb, and one that holds any coordinate.
BIN_BITS = (14, 18, 22, 26, 40)


def _level(length: Column) -> Column:
    """Finest level whose bins are wider than the interval, so it touches at most two."""
    out = F.lit(len(BIN_BITS) - 1)
    for level in reversed(range(len(BIN_BITS) - 1)):
        out = F.when(length < (1 << BIN_BITS[level]), level).otherwise(out)
    return out


def _leveled(df: DataFrame, start: str, end: str) -> DataFrame:
    low, high = F.least(start, end), F.greatest(start, end)
    return df.withColumns({"_low": low, "_high": high, "_own": _level(high - low)})


def _levels_of(left: DataFrame, right: DataFrame) -> tuple[list[int], list[int]]:
    """Levels in use on each side, in one job; a handful of integers reach the driver."""
    sides = left.select(F.lit(0).alias("side"), "_own").unionByName(right.select(F.lit(1).alias("side"), "_own"))
    found = sides.filter(F.col("_own").isNotNull()).distinct().collect()
    return tuple(sorted(r["_own"] for r in found if r["side"] == side) for side in (0, 1))


def _binned(df: DataFrame, other_levels: list[int], own_levels: list[int]) -> DataFrame:
    """One row per bin the interval touches on each level where it can meet the other side.

    Two intervals meet on the coarser of their levels: an interval is listed on its own
    level if the other side has that level or a finer one, and on coarser levels the other
    side uses.  Being shorter than a bin, it touches its first bin and at most the next.
    """
    slots = []
    for level, bits in enumerate(BIN_BITS):
        listed = F.lit(False)
        if any(other <= level for other in other_levels):
            listed = listed | (F.col("_own") == level)
        if level in other_levels:
            listed = listed | (F.col("_own") < level)
        elif level not in own_levels:
            continue
        first, last = F.shiftright("_low", bits), F.shiftright("_high", bits)
        for bin_, when in ((first, listed), (last, listed & (last != first))):
            slot = F.struct(F.lit(level).alias("level"), bin_.alias("bin"), first.alias("first"))
            slots.append(F.when(when, slot))
    none = F.lit(None).cast("struct<level:int,bin:bigint,first:bigint>")
    return (
        df.withColumn("_slot", F.explode(F.array(none, *slots)))
        .filter(F.col("_slot").isNotNull())
        .select(
            *[c for c in df.columns if c not in ("_low", "_high")],
            F.col("_slot.level").alias("_level"),
            F.col("_slot.bin").alias("_bin"),
            F.col("_slot.first").alias("_first"),
        )
    )


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str, str],
    right_span: tuple[str, str, str],
    hot_rows: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """All pairs on one chromosome with ``r.start <= l.end`` and ``r.end >= l.start``.

    A Spark range predicate alone leaves the chromosome as the only join key.  Here the
    join key is (chromosome, level, bin).  Every interval touches at most two bins per level
    however long it is, and a pair is taken only in the first bin both touch, so nothing is
    listed twice.  A small right side is broadcast; otherwise hot bins are split on both sides.
    Column names of the two sides must differ.  Where ``left`` is costly to compute,
    ``sized_by`` is a cheaper table with the same span columns that shows the lengths in use.
    """
    lc, ls, le = left_span
    rc, rs, re = right_span
    lhs, rhs = _leveled(left, ls, le), _leveled(right, rs, re)
    lengths = lhs if sized_by is None else _leveled(sized_by, ls, le)
    left_levels, right_levels = _levels_of(lengths, rhs)
    keys = ["_chrom", "_level", "_bin"]
    lhs = (
        _binned(lhs, right_levels, left_levels)
        .withColumn("_chrom", F.col(lc))
        .withColumnsRenamed({"_own": "_lown", "_first": "_lfirst"})
    )
    rhs = (
        _binned(rhs, left_levels, right_levels)
        .withColumn("_chrom", F.col(rc))
        .withColumnsRenamed({"_own": "_rown", "_first": "_rfirst"})
    )
    # What is broadcast is the listed side: at most two bins on each level where a row can meet.
    listings = 2 * (len(left_levels) + 1)
    if is_small(right, joins.BROADCAST_BYTES // listings):
        joined = lhs.join(F.broadcast(rhs), keys)
    else:
        joined = spread_join(lhs, rhs, keys, "inner", hot_rows)
    met = (
        (F.col("_level") == F.greatest("_lown", "_rown"))
        & (F.col("_bin") == F.greatest("_lfirst", "_rfirst"))
        & (F.col(rs) <= F.col(le))
        & (F.col(re) >= F.col(ls))
    )
    return joined.filter(met).drop(*keys, "_lown", "_rown", "_lfirst", "_rfirst")


def _gene_side(genes: DataFrame) -> DataFrame:
    return genes.select(
        F.col("chromosome").alias("gene_chromosome"),
        F.col("start_position").alias("gene_start_position"),
        F.col("end_position").alias("gene_end_position"),
        "gene_symbol",
        "gene_biotype",
    )


_GENE_SPAN = ("gene_chromosome", "gene_start_position", "gene_end_position")


def _with_overlap_measures(pairs: DataFrame, start: str, end: str) -> DataFrame:
    shared = overlap_length(F.col(start), F.col(end), F.col("gene_start_position"), F.col("gene_end_position"))
    return pairs.withColumns(
        {
            "overlap_length": shared,
            "overlap_fraction_of_gene": ratio_if_positive(
                shared, F.col("gene_end_position") - F.col("gene_start_position")
            ),
            "overlap_fraction_of_deletion": ratio_if_positive(shared, F.col(end) - F.col(start)),
        }
    ).drop("gene_chromosome")


def gene_overlaps(deletions: DataFrame, genes: DataFrame, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Deletions with every gene they overlap; ``how="left"`` keeps deletions without one.

    The left form resolves each distinct interval once and joins the result back, so a
    deletion seen in many patients is searched a single time.
    """
    named = deletions.withColumnsRenamed({"start_position": "deletion_start", "end_position": "deletion_end"})
    if how == "inner":
        pairs = overlap_pairs(
            named, _gene_side(genes), ("chromosome", "deletion_start", "deletion_end"), _GENE_SPAN, hot_rows
        )
        return _with_overlap_measures(pairs, "deletion_start", "deletion_end")
    if how != "left":
        raise ValueError("how must be 'inner' or 'left'")
    span = ["chromosome", "deletion_start", "deletion_end"]
    spans = named.select(*span)
    pairs = overlap_pairs(spans.distinct(), _gene_side(genes), tuple(span), _GENE_SPAN, hot_rows, sized_by=spans)
    measured = _with_overlap_measures(pairs, "deletion_start", "deletion_end")
    out = lookup_join(named, measured, span, "left", hot_rows)
    return out.withColumn("overlap_length", F.coalesce("overlap_length", F.lit(0).cast("bigint")))


def gene_at(
    points: DataFrame,
    genes: DataFrame,
    order: str = "src_ord",
    hot_rows: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """(chromosome, position) → symbol of the first gene in table order that contains it.

    Only positions inside some gene are returned, each once.
    """
    end = F.col("position").alias("position_end")
    spots = points.select("chromosome", "position").distinct().select("*", end)
    shown = None if sized_by is None else sized_by.select("position", end)
    side = _gene_side(genes.withColumn("gene_biotype", F.col(order)))
    pairs = overlap_pairs(spots, side, ("chromosome", "position", "position_end"), _GENE_SPAN, hot_rows, shown)
    first = first_per_key(pairs, ["chromosome", "position"], ["gene_biotype", "gene_symbol"])
    return first.select("chromosome", "position", "gene_symbol")
