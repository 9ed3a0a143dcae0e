"""Feature matrices and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociq.operators.annotate import with_diseases, with_features, with_gene_evidence, with_gene_locus
from lociq.operators.intervals import gene_overlaps

# Feature columns kept per (variant, gene).
SNV_COLUMNS = [
    "variant_id", "chromosome", "position", "reference_allele", "alternate_allele",
    "gene_symbol", "has_multiple_genes", "clinvar_significance", "review_status",
    "oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI",
    "haploinsufficiency_score", "triplosensitivity_score",
    "gene_start_position", "gene_end_position", "gene_biotype",
]
CNV_COLUMNS = [
    "variant_id", "chromosome", "deletion_start", "deletion_end", "deletion_size",
    "allele_frequency", "gene_symbol", "gene_start_position", "gene_end_position",
    "gene_biotype", "overlap_length", "overlap_fraction_of_gene", "overlap_fraction_of_deletion",
    "oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI",
    "haploinsufficiency_score", "triplosensitivity_score",
]


def _lookup_side(df: DataFrame) -> DataFrame:
    """A reference table without its source order, which would clash in the joined table."""
    return df.drop("src_ord")


def snv_features(
    sites: DataFrame, constraint: DataFrame, dosage: DataFrame, genes: DataFrame, gene_diseases: DataFrame
) -> DataFrame:
    """Variant × gene × disease rows with gene evidence."""
    out = with_gene_evidence(sites, _lookup_side(constraint), _lookup_side(dosage))
    out = with_gene_locus(out, genes, sized_by=sites)
    return with_diseases(out, _lookup_side(gene_diseases), sized_by=sites)


def cnv_features(
    deletions: DataFrame, genes: DataFrame, constraint: DataFrame, dosage: DataFrame, gene_diseases: DataFrame
) -> DataFrame:
    """Deletion × gene × disease rows with overlap measures and gene evidence."""
    slim = deletions.select(
        "variant_id", "chromosome", "start_position", "end_position", "deletion_size", "allele_frequency"
    )
    pairs = gene_overlaps(slim, genes, "inner")
    out = with_gene_evidence(pairs, _lookup_side(constraint), _lookup_side(dosage))
    return with_diseases(out, _lookup_side(gene_diseases), sized_by=pairs)


def training_table(scored: DataFrame, features: DataFrame, kind: str) -> DataFrame:
    """Scored patient rows with one feature row per (variant, gene)."""
    columns = {"snv": SNV_COLUMNS, "cnv": CNV_COLUMNS}[kind]
    order = (["src_ord"] if "src_ord" in features.columns else []) + [F.asc_nulls_last(c) for c in columns]
    return with_features(scored, features, columns, order)


def unmatched_rows(training: DataFrame, kind: str) -> DataFrame:
    """Number of training rows that found no feature row."""
    probe = {"snv": "clinvar_significance", "cnv": "overlap_length"}[kind]
    return training.agg(F.count_if(F.col(probe).isNull()).alias("rows_without_features"))
