"""Column types of the stage tables.  Nothing is inferred from data."""

from __future__ import annotations

# The per-variant predictor columns and their place in the wide table.
PREDICTOR_PLACES = {
    0: "chr",
    1: "position",
    2: "ref",
    3: "alt",
    48: "SIFT_score",
    49: "SIFT_converted_rankscore",
    50: "SIFT_pred",
    54: "Polyphen2_HDIV_score",
    55: "Polyphen2_HDIV_rankscore",
    56: "Polyphen2_HDIV_pred",
    57: "Polyphen2_HVAR_score",
    58: "Polyphen2_HVAR_rankscore",
    59: "Polyphen2_HVAR_pred",
    152: "CADD_raw",
    153: "CADD_raw_rankscore",
    154: "CADD_phred",
    166: "GERP_NR",
    167: "GERP_RS",
    171: "phyloP100way_vertebrate",
    172: "phyloP100way_vertebrate_rankscore",
    177: "phastCons100way_vertebrate",
    178: "phastCons100way_vertebrate_rankscore",
}
PREDICTORS = [name for place, name in PREDICTOR_PLACES.items() if place > 3]

# Column types of every stage table, as DDL.
TABLES = {
    "clinvar_raw": (
        "chromosome string, position bigint, reference_allele string, alternate_allele string, "
        "gene_info_raw string, clinvar_significance_raw string, review_status_raw string"
    ),
    "clinvar_clean": (
        "variant_id string, chromosome string, position bigint, reference_allele string, "
        "alternate_allele string, gene_symbol string, has_multiple_genes boolean, "
        "clinvar_significance string, review_status string"
    ),
    "sv_raw": (
        "chromosome string, start_position bigint, variant_filter string, sv_type_raw string, "
        "end_position_raw string, sv_length_raw string, allele_frequency_raw string"
    ),
    "sv_clean": (
        "variant_id string, chromosome string, start_position bigint, end_position bigint, "
        "deletion_size bigint, deletion_size_from_coords bigint, allele_frequency double"
    ),
    "genes": (
        "chromosome string, start_position bigint, end_position bigint, gene_symbol string, gene_id string, "
        "gene_biotype string"
    ),
    "constraint": (
        "gene_symbol string, oe_lof double, oe_lof_lower double, oe_lof_upper double, "
        "oe_lof_upper_rank double, pLI double"
    ),
    "dosage": (
        "gene_symbol string, haploinsufficiency_label string, haploinsufficiency_score int, "
        "triplosensitivity_label string, triplosensitivity_score int"
    ),
    "hpo_terms": "HPO_ID string, Name string, Definition string, Parents string",
    "hpo_annotations": (
        "disease_id string, disease_name string, hpo_id string, frequency string, frequency_numeric double, "
        "onset string, qualifier string, is_negated boolean, aspect string"
    ),
    "gene_disease": (
        "gene_symbol string, mim_number string, disease_name string, phenotype_mim_number string, "
        "mapping_key string, phenotype_type string, inheritance_modes string"
    ),
    "morbidmap": (
        "gene_symbol string, gene_mim_number string, disease_name string, phenotype_mim_number string, "
        "mapping_key string, phenotype_type string, inheritance_modes string, cyto_location string"
    ),
    "mim2gene": (
        "mim_number string, mim_entry_type string, entrez_gene_id string, gene_symbol string, "
        "ensembl_gene_id string"
    ),
    "mim_titles": "mim_number string, prefix string, preferred_disease_name string, preferred_symbol string",
    "dbnsfp_scores": ", ".join(["variant_id string", *[f"{c} string" for c in PREDICTORS]]),
    "patients_meta": (
        "patient_id bigint, causal_variant_id string, causal_gene string, causal_disease string, "
        "causal_disease_mim string, causal_inheritance_mode string, phenotype_tier string, "
        "n_patient_symptoms bigint, patient_hpo_terms string"
    ),
    "patient_variants": (
        "patient_id bigint, variant_id string, gene_symbol string, is_causal int, is_hard_negative int, "
        "zygosity string, simulated_read_depth int, simulated_genotype_quality int, "
        "simulated_filter_status string"
    ),
}

# Header names of the published files that come without a usable header.
GENEMAP_COLUMNS = [
    "chromosome_raw", "genomic_start", "genomic_end", "cyto_location", "computed_cyto_location", "mim_number",
    "gene_symbols_raw", "gene_name", "approved_gene_symbol", "entrez_gene_id", "ensembl_gene_id", "comments",
    "phenotypes_raw", "mouse_gene_symbol",
]
MIM2GENE_COLUMNS = ["mim_number", "mim_entry_type", "entrez_gene_id", "gene_symbol", "ensembl_gene_id"]
MIM_TITLE_COLUMNS = ["prefix", "mim_number", "preferred_title_raw", "alternative_titles_raw", "included_titles_raw"]
MORBIDMAP_COLUMNS = ["phenotype_raw", "gene_symbols_raw", "gene_mim_number", "cyto_location"]
