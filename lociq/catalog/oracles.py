"""Stage tables written as plain SQL, independent of the library."""

from __future__ import annotations

from lociq.catalog.views import VIEWS

_ENTRY = r"'^(.*?),\s*(\d{6})\s*\((\d)\)(.*)$'"


def simplified(raw: str) -> str:
    tokens = f"string_split(replace(lower({raw}), '/', '|'), '|')"
    return f"""CASE WHEN {raw} IS NULL THEN NULL
        WHEN contains(lower({raw}), 'conflicting') THEN 'Conflicting'
        WHEN list_contains({tokens}, 'pathogenic') THEN 'Pathogenic'
        WHEN list_contains({tokens}, 'likely_pathogenic') THEN 'Likely_pathogenic'
        WHEN list_contains({tokens}, 'benign') THEN 'Benign'
        WHEN list_contains({tokens}, 'likely_benign') THEN 'Likely_benign'
        WHEN contains(lower({raw}), 'uncertain') THEN 'Uncertain_significance'
        ELSE 'Other' END"""


def frequency(raw: str) -> str:
    parts = f"string_split(trim({raw}), '/')"
    return f"""coalesce(
        CASE trim({raw}) WHEN 'HP:0040280' THEN 1e0 WHEN 'HP:0040281' THEN 9e-1 WHEN 'HP:0040282' THEN 55e-2
             WHEN 'HP:0040283' THEN 17e-2 WHEN 'HP:0040284' THEN 25e-3 WHEN 'HP:0040285' THEN 0e0 END,
        CASE WHEN len({parts}) = 2 THEN try_cast({parts}[1] AS DOUBLE) / nullif(try_cast({parts}[2] AS DOUBLE), 0e0) END)"""


def negated(raw: str) -> str:
    return f"coalesce(upper(trim({raw})) = 'NOT', false)"


def label_score(label: str) -> str:
    return f"""CASE WHEN {label} LIKE 'Sufficient Evidence for %' THEN 3 WHEN {label} LIKE 'Some Evidence for %' THEN 2
        WHEN {label} LIKE 'Emerging Evidence for %' THEN 1 WHEN {label} LIKE 'Little Evidence for %' THEN 1
        WHEN {label} LIKE 'No Evidence for %' THEN 0 WHEN {label} LIKE 'Dosage Sensitivity Unlikely for %' THEN 0
        WHEN {label} = 'Gene Associated with Autosomal Recessive Phenotype' THEN 0 END"""


def entry_columns(entry: str) -> str:
    """disease_name, phenotype_mim_number, mapping_key, phenotype_type, inheritance_modes"""
    e = f"trim({entry})"
    mim = f"regexp_extract({e}, {_ENTRY}, 2)"
    name = f"trim(regexp_extract({e}, {_ENTRY}, 1))"
    rest = f"regexp_extract({e}, {_ENTRY}, 4)"
    return f"""trim(CASE WHEN {mim} <> '' THEN {name} ELSE {e} END, '{{}}[]? ') AS disease_name,
        nullif({mim}, '') AS phenotype_mim_number,
        nullif(regexp_extract({e}, {_ENTRY}, 3), '') AS mapping_key,
        CASE WHEN {mim} = '' THEN 'unconfirmed_or_unmapped'
             WHEN {name} LIKE '{{%}}' THEN 'susceptibility' WHEN {name} LIKE '[%]' THEN 'nondisease'
             WHEN {name} LIKE '?%' THEN 'unconfirmed_mendelian' ELSE 'confirmed_mendelian' END AS phenotype_type,
        nullif(array_to_string([trim(x) for x in string_split({rest}, ',') if trim(x) <> ''], ';'), '') AS inheritance_modes"""


STANDARD = "(" + ", ".join(f"'{i}'" for i in [*range(1, 23), "X", "Y", "MT"]) + ")"

SQL_VIEWS: dict[str, str] = {name: view.sql for name, view in VIEWS.items()}
SQL_VIEWS |= {
    "genes": f"SELECT * FROM @genes_raw@ WHERE gene_symbol IS NOT NULL AND chromosome IN {STANDARD}",
    "gene_locus": """SELECT gene_symbol, start_position AS gene_start_position, end_position AS gene_end_position, gene_biotype
        FROM @genes@ g WHERE src_ord = (SELECT min(src_ord) FROM @genes@ h WHERE h.gene_symbol = g.gene_symbol)""",
    "sites_split": f"""SELECT *, {simplified('clinvar_significance_raw')} AS clinvar_significance,
        [string_split(x, ':')[1] for x in string_split(gene_info_raw, '|')] AS symbols FROM @sites_raw@""",
    "sites": """SELECT * FROM (SELECT concat(chromosome, '_', position, '_', reference_allele, '_', alternate_allele) AS variant_id,
        chromosome, position, reference_allele, alternate_allele, unnest(symbols) AS gene_symbol,
        len(symbols) > 1 AS has_multiple_genes, clinvar_significance, review_status_raw AS review_status, src_ord
        FROM @sites_split@ WHERE clinvar_significance IS NOT NULL) WHERE gene_symbol <> ''""",
    "population": """SELECT concat(c, '_', start_position, '_', e) AS variant_id, c AS chromosome, start_position, e AS end_position,
        abs(try_cast(sv_length_raw AS BIGINT)) AS deletion_size, e - start_position AS deletion_size_from_coords,
        try_cast(allele_frequency_raw AS DOUBLE) AS allele_frequency, src_ord
        FROM (SELECT *, regexp_replace(chromosome, '^chr', '') AS c, try_cast(end_position_raw AS BIGINT) AS e
              FROM @structural_raw@ WHERE sv_type_raw = 'DEL' AND variant_filter = 'PASS')""",
    "population_ided": """SELECT * REPLACE (CASE WHEN end_position IS NOT NULL THEN variant_id END AS variant_id) FROM @population@""",
    "constraint_table": """SELECT gene AS gene_symbol, oe_lof, oe_lof_lower, oe_lof_upper, oe_lof_upper_rank, "pLI" FROM (
        SELECT *, row_number() OVER (PARTITION BY gene ORDER BY oe_lof_upper_rank ASC NULLS LAST, src_ord) AS rn
        FROM @constraint_raw@) WHERE rn = 1""",
    "dosage": f"""SELECT "GENE SYMBOL" AS gene_symbol, haploinsufficiency AS haploinsufficiency_label,
        {label_score('haploinsufficiency')} AS haploinsufficiency_score, triplosensitivity AS triplosensitivity_label,
        {label_score('triplosensitivity')} AS triplosensitivity_score FROM @dosage_raw@
        WHERE NOT coalesce(regexp_full_match("GENE SYMBOL", '\\++'), false)
          AND NOT coalesce(regexp_full_match(haploinsufficiency, '\\++'), false)
          AND NOT coalesce(regexp_full_match(triplosensitivity, '\\++'), false)""",
    "gene_entries": """SELECT approved_gene_symbol AS gene_symbol, mim_number, src_ord, entries[i] AS entry, i FROM (
        SELECT *, string_split(phenotypes_raw, ';') AS entries, unnest(range(1, len(string_split(phenotypes_raw, ';')) + 1)) AS i
        FROM @gene_map_raw@ WHERE approved_gene_symbol IS NOT NULL AND phenotypes_raw IS NOT NULL)""",
    "gene_diseases": f"""SELECT gene_symbol, mim_number, {entry_columns('entry')}, src_ord, i
        FROM @gene_entries@ WHERE trim(entry) <> ''""",
    "annotations": f"""SELECT database_id AS disease_id, disease_name, hpo_id, frequency, {frequency('frequency')} AS frequency_numeric,
        onset, qualifier, {negated('qualifier')} AS is_negated, aspect, src_ord FROM @annotations_raw@""",
    "usable": "SELECT * FROM @annotations@ WHERE aspect = 'P' AND NOT is_negated",
    "weights": """SELECT disease_id, hpo_id, arg_max(coalesce(frequency_numeric, 3e-1), src_ord) AS weight
        FROM @usable@ GROUP BY ALL""",
    "weights_sum": """SELECT disease_id, hpo_id, sum(coalesce(frequency_numeric, 3e-1)) AS weight FROM @usable@
        GROUP BY disease_id, hpo_id""",
    "gene_ids": """SELECT gene_symbol, concat('OMIM:', phenotype_mim_number::BIGINT) AS disease_id,
        arg_min(disease_name, src_ord * 100 + i) AS disease_name, min(src_ord * 100 + i) AS ord
        FROM @gene_diseases@ WHERE phenotype_mim_number IS NOT NULL GROUP BY ALL""",
    "symptoms": "SELECT DISTINCT patient_id, hpo_id FROM @patient_symptoms@",
}


def best_scores(candidates: str, weights: str = "@weights@", symptoms: str = "@symptoms@") -> str:
    """Best disease per (patient_id, gene_symbol) of ``candidates``, scores above zero only."""
    score = "round(m.matched / t.total, 12)"
    return f"""SELECT patient_id, gene_symbol, score, disease_id, disease_name FROM (
        SELECT p.patient_id, p.gene_symbol, g.disease_id, g.disease_name, {score} AS score,
               row_number() OVER (PARTITION BY p.patient_id, p.gene_symbol ORDER BY {score} DESC, g.ord, g.disease_id) AS rn
        FROM (SELECT DISTINCT patient_id, gene_symbol FROM {candidates}) p
        JOIN @gene_ids@ g ON g.gene_symbol = p.gene_symbol
        JOIN (SELECT disease_id, sum(weight) AS total FROM {weights} GROUP BY disease_id) t ON t.disease_id = g.disease_id
        JOIN (SELECT s.patient_id, w.disease_id, sum(w.weight) AS matched FROM {symptoms} s
              JOIN {weights} w ON w.hpo_id = s.hpo_id GROUP BY ALL) m
          ON m.patient_id = p.patient_id AND m.disease_id = g.disease_id
        WHERE t.total > 0 AND {score} > 0) WHERE rn = 1"""


SQL_VIEWS |= {
    "candidate_scores": best_scores("@candidates@"),
    "deletion_overlaps": """SELECT d.patient_id, d.variant_id, d.chromosome, d.start_position AS deletion_start, d.end_position AS deletion_end,
        d.deletion_size, d.allele_frequency, d.filter_status, d.genotype_raw, d.src_ord, g.gene_symbol,
        g.start_position AS gene_start_position, g.end_position AS gene_end_position, g.gene_biotype,
        least(d.end_position, g.end_position) - greatest(d.start_position, g.start_position) AS overlap_length
        FROM @deletions@ d JOIN @genes@ g ON g.chromosome = d.chromosome
         AND g.start_position <= d.end_position AND g.end_position >= d.start_position""",
    "population_overlaps": """SELECT d.variant_id, d.chromosome, d.start_position AS deletion_start, d.end_position AS deletion_end,
        d.deletion_size, d.allele_frequency, g.gene_symbol,
        g.start_position AS gene_start_position, g.end_position AS gene_end_position, g.gene_biotype,
        least(d.end_position, g.end_position) - greatest(d.start_position, g.start_position) AS overlap_length,
        round((least(d.end_position, g.end_position) - greatest(d.start_position, g.start_position))
              / nullif(g.end_position - g.start_position, 0), 9) AS overlap_fraction_of_gene,
        round((least(d.end_position, g.end_position) - greatest(d.start_position, g.start_position))
              / nullif(d.end_position - d.start_position, 0), 9) AS overlap_fraction_of_deletion
        FROM @population_ided@ d JOIN @genes@ g ON g.chromosome = d.chromosome
         AND g.start_position <= d.end_position AND g.end_position >= d.start_position""",
    "site_features": """SELECT s.*, c.* EXCLUDE (gene_symbol), d.* EXCLUDE (gene_symbol), l.* EXCLUDE (gene_symbol),
        o.mim_number, o.disease_name, o.phenotype_mim_number, o.mapping_key, o.phenotype_type, o.inheritance_modes
        FROM @sites@ s LEFT JOIN @constraint_table@ c ON c.gene_symbol = s.gene_symbol
        LEFT JOIN @dosage@ d ON d.gene_symbol = s.gene_symbol
        LEFT JOIN @gene_locus@ l ON l.gene_symbol = s.gene_symbol
        LEFT JOIN @gene_diseases@ o ON o.gene_symbol = s.gene_symbol""",
    "deletion_features": """SELECT s.*, c.* EXCLUDE (gene_symbol), d.* EXCLUDE (gene_symbol),
        o.mim_number, o.disease_name, o.phenotype_mim_number, o.mapping_key, o.phenotype_type, o.inheritance_modes
        FROM @population_overlaps@ s LEFT JOIN @constraint_table@ c ON c.gene_symbol = s.gene_symbol
        LEFT JOIN @dosage@ d ON d.gene_symbol = s.gene_symbol
        LEFT JOIN @gene_diseases@ o ON o.gene_symbol = s.gene_symbol""",
}


def unit(seed: int, key: str) -> str:
    """The library's hashed uniform number for ``seed|key``."""
    return f"({number(seed, key)}::DOUBLE / 4503599627370496e0)"


def number(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT"


def order(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key})"


def _cohort(rows: str, background: int) -> str:
    return f"""SELECT * EXCLUDE (label, nth) FROM (SELECT r.*, row_number() OVER (PARTITION BY patient_id, label = 0
            ORDER BY label, {order(42, "variant_id || '|' || gene_symbol")}, variant_id, gene_symbol) AS nth FROM (
          SELECT DISTINCT *, CASE WHEN is_causal = 1 THEN 0 WHEN is_hard_negative = 1 THEN 1 ELSE 2 END AS label FROM {rows}) r)
        WHERE (label = 0 OR nth <= {background}) AND patient_id IN (SELECT patient_id FROM {rows} WHERE is_causal = 1)"""


_ZYGOSITY = "CASE WHEN genotype_raw IN ('1/1', '1|1') THEN 'homozygous' ELSE 'heterozygous' END AS zygosity"
SQL_VIEWS |= {
    "labelled_site_rows": f"""SELECT l.patient_id, l.variant_id, s.gene_symbol, l.is_causal, l.is_hard_negative, {_ZYGOSITY}
        FROM @labelled_sites@ l JOIN (SELECT DISTINCT variant_id, gene_symbol FROM @sites@) s ON s.variant_id = l.variant_id""",
    "labelled_deletion_rows": f"""SELECT l.patient_id, l.variant_id, g.gene_symbol, l.is_causal, l.is_hard_negative, {_ZYGOSITY}
        FROM @labelled_deletions@ l JOIN @genes@ g ON g.chromosome = l.chromosome
         AND g.start_position <= l.end_position AND g.end_position >= l.start_position""",
    "site_cohort": _cohort("@labelled_site_rows@", 100),
    "deletion_cohort": _cohort("@labelled_deletion_rows@", 30),
}
