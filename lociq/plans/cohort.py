"""Who may enter a labelled cohort, and the cohort of given labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociq.functions import clinical
from lociq.functions.clinical import disease_id
from lociq.operators import sampling
from lociq.operators.dedupe import most_dosage_sensitive
from lociq.operators.joins import lookup_join
from lociq.operators.phenotype import disease_symptoms, similar_diseases
from lociq.operators.ranking import first_per_key, top_per_key
from lociq.session import staged

# Background rows of a patient, and symptoms that similar diseases share.
BACKGROUND = {"snv": 100, "cnv": 30}
MIN_SHARED = 2
MENDELIAN = [clinical.CONFIRMED, clinical.UNCONFIRMED]


def eligible_sites(features: DataFrame) -> DataFrame:
    """Pathogenic variants with a Mendelian disease of their gene."""
    return features.filter(
        F.col("clinvar_significance").isin(clinical.PATHOGENIC, clinical.LIKELY_PATHOGENIC)
        & F.col("disease_name").isNotNull()
        & F.col("phenotype_type").isin(MENDELIAN)
    )


def eligible_deletions(features: DataFrame) -> DataFrame:
    """One row per deletion: its most dosage-sensitive gene with a Mendelian disease."""
    return most_dosage_sensitive(
        features.filter(
            F.col("disease_name").isNotNull()
            & F.col("phenotype_type").isin(MENDELIAN)
            & F.col("haploinsufficiency_score").isNotNull()
        )
    )


def candidate_pools(known: DataFrame) -> dict[str, DataFrame]:
    """Background pools by significance; a variant may be in two of them."""
    s = F.col("clinvar_significance")
    return {
        "general": known.filter(s.isin(clinical.BENIGN, clinical.LIKELY_BENIGN, clinical.UNCERTAIN)),
        "uncertain": known.filter(s.isin(clinical.UNCERTAIN, clinical.CONFLICTING)),
        "pathogenic": known.filter(s.isin(clinical.PATHOGENIC, clinical.LIKELY_PATHOGENIC)),
    }


def gene_inheritance(gene_diseases: DataFrame, order: str = "src_ord") -> DataFrame:
    """First non-null inheritance text per gene."""
    listed = gene_diseases.filter(F.col("inheritance_modes").isNotNull() & F.col("gene_symbol").isNotNull())
    return first_per_key(listed, ["gene_symbol"], [F.asc(order)]).select("gene_symbol", "inheritance_modes")


def phenocopies(patients: DataFrame, annotations: DataFrame, gene_diseases: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """At most one variant per patient from a gene of a disease that looks like the causal one.

    The similar disease is picked first; if none of its other genes has a variant the patient
    gets none.  Of a disease's many alike each patient takes the one with the smallest hash: an
    aggregate that map tasks begin, so the pairs are neither written out nor numbered.
    """
    pairs = disease_symptoms(annotations)
    similar = similar_diseases(patients.select("disease_id"), pairs, MIN_SHARED)
    slim = patients.select("patient_id", "disease_id", "causal_gene", "causal_variant_id")
    place = sampling.order_hash(seed, F.lit("similar"), F.col("patient_id"), F.col("other_id"))
    least = (
        lookup_join(similar.select("disease_id", "other_id"), slim.select("patient_id", "disease_id"), "disease_id", "inner")
        .groupBy("patient_id")
        .agg(F.min_by("other_id", place).alias("other_id"))
    )
    chosen = lookup_join(slim, least, "patient_id", "inner")
    genes = (
        gene_diseases.filter(F.col("phenotype_mim_number").isNotNull() & F.col("gene_symbol").isNotNull())
        .select(disease_id(F.col("phenotype_mim_number")).alias("other_id"), "gene_symbol")
        .distinct()
    )
    with_variants = lookup_join(genes, known.select("gene_symbol").distinct(), "gene_symbol", "left_semi")
    options = lookup_join(chosen, with_variants, "other_id", "inner").filter(
        ~F.equal_null("gene_symbol", "causal_gene")
    )
    order = [sampling.order_hash(seed, F.col("patient_id"), F.col("gene_symbol")), F.asc("gene_symbol")]
    one_gene = staged(first_per_key(options, ["patient_id"], order), "phenocopy-genes")
    variants = known.select("variant_id", "gene_symbol").distinct()
    picked = sampling.pick_one(
        one_gene, variants, ["gene_symbol"], ["variant_id"], seed, F.lit("phenocopy"), F.col("patient_id")
    )
    return picked.filter(~F.equal_null("variant_id", "causal_variant_id")).select(
        "patient_id", "variant_id", "gene_symbol", F.lit(1).alias("_place")
    )


def labelled_cohort(rows: DataFrame, background: int, seed: int = 42) -> DataFrame:
    """Rows of the patients that have a causal one: all causal rows and ``background`` others.

    ``rows`` are given and labelled (``is_causal``, ``is_hard_negative``).  A candidate listed
    twice keeps its strongest label; hard negatives come before other rows, which follow in
    seeded order.
    """
    key = ["patient_id", "variant_id", "gene_symbol"]
    label = F.when(F.col("is_causal") == 1, 0).when(F.col("is_hard_negative") == 1, 1).otherwise(2)
    once = staged(first_per_key(rows.withColumn("_label", label), key, [F.asc("_label")]), "labelled")
    causal = once.filter("_label = 0")
    order = [F.asc("_label"), sampling.order_hash(seed, F.col("variant_id"), F.col("gene_symbol")), F.asc("variant_id"), F.asc("gene_symbol")]
    others = top_per_key(once.filter("_label > 0"), ["patient_id"], order, background)
    kept = lookup_join(others, causal.select("patient_id").distinct(), "patient_id", "left_semi")
    return causal.unionByName(kept).drop("_label")


def cohort_patients(rows: DataFrame, symptoms: DataFrame, tiers: DataFrame) -> DataFrame:
    """One row per patient of a cohort: rows by label, tier, and the patient's own symptoms."""
    counts = rows.groupBy("patient_id").agg(
        F.sum("is_causal").alias("n_causal"),
        F.sum("is_hard_negative").alias("n_hard_negative"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    sets = symptoms.groupBy("patient_id").agg(F.array_sort(F.collect_set("hpo_id")).alias("_s"))
    out = lookup_join(lookup_join(counts, sets, "patient_id"), tiers.select("patient_id", "phenotype_tier"), "patient_id")
    return out.select(
        "patient_id", "n_causal", "n_hard_negative", "n_rows", "phenotype_tier",
        F.coalesce(F.size("_s"), F.lit(0)).cast("bigint").alias("n_patient_symptoms"),
        F.array_join("_s", ";").alias("patient_hpo_terms"),
    )
