"""Cleaners: raw source tables to stage tables.  ``src_ord`` is carried along when present."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociq.functions import clinical
from lociq.functions.text import first_alias, parse_double, strip, title_name, title_symbol
from lociq.functions.variants import STANDARD_CHROMOSOMES, identity, strip_chr
from lociq.operators.dedupe import most_constrained

CONSTRAINT_COLUMNS = ["oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI"]


def _order(df: DataFrame) -> list[str]:
    return ["src_ord"] if "src_ord" in df.columns else []


def clean_sites(raw: DataFrame) -> DataFrame:
    """One row per variant and gene with a simplified significance."""
    symbols = clinical.gene_symbols(F.col("gene_info_raw"))
    return (
        raw.withColumn("clinvar_significance", clinical.simplify_significance(F.col("clinvar_significance_raw")))
        .filter(F.col("clinvar_significance").isNotNull())
        .withColumn("_symbols", symbols)
        .select(
            identity(
                F.col("chromosome"), F.col("position"), F.col("reference_allele"), F.col("alternate_allele")
            ).alias("variant_id"),
            "chromosome",
            "position",
            "reference_allele",
            "alternate_allele",
            F.explode("_symbols").alias("gene_symbol"),
            (F.size("_symbols") > 1).alias("has_multiple_genes"),
            "clinvar_significance",
            F.col("review_status_raw").alias("review_status"),
            *_order(raw),
        )
        .filter(F.col("gene_symbol") != "")
    )


def clean_population_deletions(raw: DataFrame) -> DataFrame:
    """Deletions that passed quality filters, with numeric columns."""
    end = parse_double(F.col("end_position_raw")).cast("bigint")
    chromosome = strip_chr(F.col("chromosome"))
    return raw.filter((F.col("sv_type_raw") == "DEL") & (F.col("variant_filter") == "PASS")).select(
        identity(chromosome, F.col("start_position"), end).alias("variant_id"),
        chromosome.alias("chromosome"),
        "start_position",
        end.alias("end_position"),
        F.abs(parse_double(F.col("sv_length_raw"))).cast("bigint").alias("deletion_size"),
        (end - F.col("start_position")).alias("deletion_size_from_coords"),
        parse_double(F.col("allele_frequency_raw")).alias("allele_frequency"),
        *_order(raw),
    )


def clean_genes(raw: DataFrame) -> DataFrame:
    """Genes with a symbol on a standard chromosome; several loci of one symbol all stay."""
    return raw.filter(F.col("gene_symbol").isNotNull() & F.col("chromosome").isin(STANDARD_CHROMOSOMES))


def clean_constraint(raw: DataFrame, order: str = "src_ord") -> DataFrame:
    """One row per gene: the one with the lowest upper-bound rank."""
    named = raw.select(F.col("gene").alias("gene_symbol"), *CONSTRAINT_COLUMNS, order)
    return most_constrained(named, order)


def clean_dosage(raw: DataFrame) -> DataFrame:
    """Dosage labels with their scores, separator rows left out."""
    gene, haplo, triplo = F.col("`GENE SYMBOL`"), F.col("HAPLOINSUFFICIENCY"), F.col("TRIPLOSENSITIVITY")
    return raw.filter(~clinical.is_junk_label(haplo, triplo, gene)).select(
        gene.alias("gene_symbol"),
        haplo.alias("haploinsufficiency_label"),
        clinical.dosage_score(haplo, "Haploinsufficiency").alias("haploinsufficiency_score"),
        triplo.alias("triplosensitivity_label"),
        clinical.dosage_score(triplo, "Triplosensitivity").alias("triplosensitivity_score"),
        *_order(raw),
    )


def clean_annotations(raw: DataFrame) -> DataFrame:
    """Disease–symptom annotations with numeric frequency and a negation flag."""
    return raw.select(
        F.col("database_id").alias("disease_id"),
        "disease_name",
        "hpo_id",
        "frequency",
        clinical.parse_frequency(F.col("frequency")).alias("frequency_numeric"),
        "onset",
        "qualifier",
        clinical.is_negated(F.col("qualifier")).alias("is_negated"),
        "aspect",
        *_order(raw),
    )


def expand_gene_diseases(raw: DataFrame) -> DataFrame:
    """One row per gene and listed phenotype, in listing order."""
    order = ["src_ord"] if "src_ord" in raw.columns else []
    listed = raw.filter(F.col("approved_gene_symbol").isNotNull()).select(
        F.col("approved_gene_symbol").alias("gene_symbol"),
        "mim_number",
        F.posexplode(F.split("phenotypes_raw", ";")).alias("_place", "_entry"),
        *order,
    )
    out = listed.filter(strip(F.col("_entry")) != "").select(
        "gene_symbol",
        "mim_number",
        clinical.disease_entry(F.col("_entry")).alias("_d"),
        *[F.struct("src_ord", "_place").alias("src_ord") for _ in order],
    )
    return out.select("gene_symbol", "mim_number", "_d.*", *order)


def clean_morbid_map(raw: DataFrame) -> DataFrame:
    """One row per phenotype with the approved (first) gene symbol."""
    kept = raw.filter(F.col("gene_symbols_raw").isNotNull() & (strip(F.col("phenotype_raw")) != ""))
    return kept.select(
        first_alias(F.col("gene_symbols_raw")).alias("gene_symbol"),
        "gene_mim_number",
        clinical.disease_entry(F.col("phenotype_raw")).alias("_d"),
        "cyto_location",
        *_order(raw),
    ).select("gene_symbol", "gene_mim_number", "_d.*", "cyto_location", *_order(raw))


def clean_mim_genes(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("gene_symbol").isNotNull())


def clean_mim_titles(raw: DataFrame) -> DataFrame:
    """Titles ``NAME; SYMBOL`` split into name and symbol."""
    title = F.col("preferred_title_raw")
    return raw.select(
        "mim_number",
        "prefix",
        title_name(title).alias("preferred_disease_name"),
        title_symbol(title).alias("preferred_symbol"),
        *_order(raw),
    )
