"""Gene and variant evidence joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociq.operators.dedupe import keep_first
from lociq.operators.intervals import gene_at
from lociq.operators.joins import is_small, lookup_join
from lociq.session import staged


def with_gene_evidence(
    df: DataFrame, constraint: DataFrame, dosage: DataFrame, sized_by: DataFrame | None = None
) -> DataFrame:
    """Left joins of the one-row-per-gene constraint and dosage tables."""
    sized_by = df if sized_by is None else sized_by
    out = lookup_join(df, constraint, "gene_symbol", sized_by=sized_by)
    return lookup_join(out, dosage, "gene_symbol", sized_by=sized_by)


def first_locus(genes: DataFrame, order: str = "src_ord") -> DataFrame:
    """One locus per symbol, the first in table order, columns named for the join."""
    named = genes.filter(F.col("gene_symbol").isNotNull())
    return keep_first(named, ["gene_symbol"], [F.asc(order)]).select(
        "gene_symbol",
        F.col("start_position").alias("gene_start_position"),
        F.col("end_position").alias("gene_end_position"),
        "gene_biotype",
    )


def with_gene_locus(
    df: DataFrame, genes: DataFrame, order: str = "src_ord", sized_by: DataFrame | None = None
) -> DataFrame:
    """First locus of the gene; ``genes`` may be the result of :func:`first_locus`."""
    loci = genes if "gene_start_position" in genes.columns else first_locus(genes, order)
    return lookup_join(df, loci, "gene_symbol", sized_by=sized_by)


def with_diseases(df: DataFrame, gene_diseases: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """One row per candidate disease of the gene; genes without one stay with nulls."""
    listed = gene_diseases.filter(F.col("gene_symbol").isNotNull())
    return lookup_join(df, listed, "gene_symbol", sized_by=sized_by)


def listed_sites(known: DataFrame, order: str = "src_ord") -> DataFrame:
    """First row of each known variant, columns named for the join."""
    return keep_first(known, ["variant_id"], [F.asc(order)]).select(
        "variant_id",
        F.col("gene_symbol").alias("_listed_gene"),
        "clinvar_significance",
        "review_status",
        F.col("has_multiple_genes").alias("_multi"),
        F.lit(True).alias("_listed"),
    )


def annotate_sites(variants: DataFrame, known: DataFrame, genes: DataFrame, order: str = "src_ord") -> DataFrame:
    """Gene and significance of patient variants.

    A variant listed in ``known`` takes its first row there; the others get the first gene
    whose span contains the position.  Each distinct variant is resolved once and the result
    joined back, so a variant carried by many patients is searched a single time.  ``known`` may
    be the result of :func:`listed_sites`.

    Of a large table the distinct variants and their matches are written out: both are read
    several times, and every time would shuffle the whole table again.
    """
    key = ["variant_id", "chromosome", "position"]
    keep = (lambda df, name: df) if is_small(variants) else staged
    counted = keep(variants.groupBy(*key).agg(F.count(F.lit(1)).alias("_l")), "distinct-variants")
    # A row with a null key finds nothing below.
    distinct = counted.drop("_l").dropna(subset=key)
    listed = known if "_listed" in known.columns else listed_sites(known, order)
    matched = keep(lookup_join(distinct, listed, "variant_id"), "matched-variants")
    unlisted = matched.filter(F.col("_listed").isNull())
    located = gene_at(unlisted, genes, order, sized_by=distinct).withColumnRenamed("gene_symbol", "_located_gene")
    # Distinct variants of one position differ in their alleles only, so no position is hot here.
    resolved = matched.join(located, ["chromosome", "position"], "left")
    in_known = F.coalesce("_listed", F.lit(False))
    resolved = resolved.select(
        *key,
        F.when(in_known, F.col("_listed_gene")).otherwise(F.col("_located_gene")).alias("gene_symbol"),
        "clinvar_significance",
        "review_status",
        F.coalesce("_multi", F.lit(False)).alias("has_multiple_genes"),
        in_known.alias("in_clinvar"),
    )
    return lookup_join(variants, resolved, key, sizes=counted)


def with_features(rows: DataFrame, features: DataFrame, columns: list[str], order: list) -> DataFrame:
    """Attach one feature row per (variant, gene) to patient rows."""
    once = keep_first(features, ["variant_id", "gene_symbol"], order, columns)
    return lookup_join(rows, once, ["variant_id", "gene_symbol"])


def with_predictor_scores(rows: DataFrame, scores: DataFrame, order: str = "src_ord") -> DataFrame:
    """Attach the first score row of each variant."""
    return lookup_join(rows, keep_first(scores, ["variant_id"], [F.asc(order)]).drop(order), "variant_id")


def without_match(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``others``."""
    return lookup_join(df, others.select(key).distinct(), key, "left_anti")
