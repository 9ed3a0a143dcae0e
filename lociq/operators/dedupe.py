"""Keep-first and keep-best rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lociq.operators.ranking import first_per_key


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None = None
) -> DataFrame:
    """First row per key in source order, optionally cut to ``columns``."""
    kept = first_per_key(df, keys, order)
    return kept.select(*columns) if columns else kept


def most_constrained(df: DataFrame, order: str = "src_ord") -> DataFrame:
    """Per gene the row with the lowest confidence rank, missing ranks last."""
    return first_per_key(df, ["gene_symbol"], [F.asc_nulls_last("oe_lof_upper_rank"), F.asc(order)])


def most_dosage_sensitive(df: DataFrame) -> DataFrame:
    """Per deletion the gene with the highest haploinsufficiency score."""
    order = [F.desc_nulls_last("haploinsufficiency_score"), F.asc("gene_symbol"), F.asc_nulls_last("disease_name")]
    return first_per_key(df, ["variant_id"], order)
