"""Joins, aggregates, keep-first rules, top-n and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociq.catalog.oracles import best_scores, order
from lociq.catalog.registry import Tables, query
from lociq.operators import annotate, dedupe, intervals, metrics, phenotype, profile, sampling, search
from lociq.operators.joins import lookup_join
from lociq.operators.model import rank_candidates
from lociq.operators.ranking import rank_rows, top_per_key
from lociq.plans import clean, cohort, features
from lociq.session import staged


def sites(t: Tables) -> DataFrame:
    return clean.clean_sites(t.sites_raw)


def genes(t: Tables) -> DataFrame:
    return clean.clean_genes(t.genes_raw)


def constraint(t: Tables) -> DataFrame:
    return clean.clean_constraint(t.constraint_raw)


def dosage(t: Tables) -> DataFrame:
    return clean.clean_dosage(t.dosage_raw)


def gene_diseases(t: Tables) -> DataFrame:
    return clean.expand_gene_diseases(t.gene_map_raw)


def annotations(t: Tables) -> DataFrame:
    return clean.clean_annotations(t.annotations_raw)


def population(t: Tables) -> DataFrame:
    return clean.clean_population_deletions(t.structural_raw)


def site_features(t: Tables) -> DataFrame:
    return features.snv_features(sites(t), constraint(t), dosage(t), genes(t), gene_diseases(t))


def deletion_features(t: Tables) -> DataFrame:
    return features.cnv_features(population(t), genes(t), constraint(t), dosage(t), gene_diseases(t))


_CONSTRAINT = "oe_lof, oe_lof_lower, oe_lof_upper, oe_lof_upper_rank, \"pLI\""
_DOSAGE = (
    "haploinsufficiency_label, haploinsufficiency_score, triplosensitivity_label, triplosensitivity_score"
)
_DISEASE = "mim_number, disease_name, phenotype_mim_number, mapping_key, phenotype_type, inheritance_modes"
_EVIDENCE = ["oe_lof", "pLI", "haploinsufficiency_score", "triplosensitivity_score"]


# --- joins ---------------------------------------------------------------------------------


@query(
    "j1_gene_evidence",
    """SELECT s.src_ord, s.variant_id, s.gene_symbol, round(c.oe_lof, 9) AS oe_lof, round(c."pLI", 9) AS "pLI",
        d.haploinsufficiency_score, d.triplosensitivity_score FROM @sites@ s
        LEFT JOIN @constraint_table@ c ON c.gene_symbol = s.gene_symbol LEFT JOIN @dosage@ d ON d.gene_symbol = s.gene_symbol""",
)
def _(t: Tables):
    out = annotate.with_gene_evidence(sites(t), constraint(t).drop("src_ord"), dosage(t).drop("src_ord"))
    return out.select("src_ord", "variant_id", "gene_symbol", *_EVIDENCE)


@query(
    "j2_first_gene_locus",
    """SELECT s.src_ord, s.gene_symbol, l.gene_start_position, l.gene_end_position, l.gene_biotype
        FROM @sites@ s LEFT JOIN @gene_locus@ l ON l.gene_symbol = s.gene_symbol""",
)
def _(t: Tables):
    return annotate.with_gene_locus(sites(t), genes(t)).select(
        "src_ord", "gene_symbol", "gene_start_position", "gene_end_position", "gene_biotype"
    )


@query(
    "j3_disease_expansion",
    f"""SELECT s.src_ord, s.gene_symbol, {_DISEASE} FROM @sites@ s LEFT JOIN @gene_diseases@ o ON o.gene_symbol = s.gene_symbol""",
)
def _(t: Tables):
    out = annotate.with_diseases(sites(t), gene_diseases(t).drop("src_ord"))
    return out.select("src_ord", "gene_symbol", *_DISEASE.split(", "))


@query(
    "j4_site_feature_matrix",
    f"""SELECT variant_id, chromosome, position, reference_allele, alternate_allele, gene_symbol, has_multiple_genes,
        clinvar_significance, review_status, src_ord, round(oe_lof, 9) AS oe_lof, round(oe_lof_lower, 9) AS oe_lof_lower,
        round(oe_lof_upper, 9) AS oe_lof_upper, oe_lof_upper_rank, round("pLI", 9) AS "pLI", {_DOSAGE},
        gene_start_position, gene_end_position, gene_biotype, {_DISEASE} FROM @site_features@""",
)
def _(t: Tables):
    return site_features(t)


_OVERLAP_SQL = """round(overlap_length / nullif(gene_end_position - gene_start_position, 0), 9) AS overlap_fraction_of_gene,
        round(overlap_length / nullif(deletion_end - deletion_start, 0), 9) AS overlap_fraction_of_deletion"""


@query(
    "j5_interval_overlap_inner",
    f"""SELECT patient_id, variant_id, chromosome, deletion_start, deletion_end, deletion_size, round(allele_frequency, 9) AS allele_frequency,
        filter_status, genotype_raw, src_ord, gene_symbol, gene_start_position, gene_end_position, gene_biotype, overlap_length, {_OVERLAP_SQL}
        FROM @deletion_overlaps@""",
)
def _(t: Tables):
    return intervals.gene_overlaps(t.deletions, genes(t), "inner")


@query(
    "j6_interval_overlap_left",
    """SELECT d.src_ord, d.variant_id, o.gene_symbol, coalesce(o.overlap_length, 0) AS overlap_length, o.gene_start_position
        FROM @deletions@ d LEFT JOIN @deletion_overlaps@ o ON o.src_ord = d.src_ord""",
)
def _(t: Tables):
    out = intervals.gene_overlaps(t.deletions, genes(t), "left")
    return out.select("src_ord", "variant_id", "gene_symbol", "overlap_length", "gene_start_position")


_GENE_AT = """SELECT chromosome, position, arg_min(gene_symbol, src_ord) AS gene_symbol FROM (
        SELECT DISTINCT p.chromosome, p.position, g.gene_symbol, g.src_ord FROM {points} p JOIN @genes@ g
          ON g.chromosome = p.chromosome AND g.start_position <= p.position AND g.end_position >= p.position) GROUP BY ALL"""


@query("j7_gene_at_position", _GENE_AT.format(points="@patient_sites@"))
def _(t: Tables):
    return intervals.gene_at(t.patient_sites, genes(t))


@query(
    "j8_annotate_patient_sites",
    f"""WITH located AS ({_GENE_AT.format(points="@patient_sites@")}),
        listed AS (SELECT variant_id, arg_min(gene_symbol, src_ord * 10000 + place) AS gene_symbol, min(clinvar_significance) AS clinvar_significance,
            min(review_status) AS review_status, min(has_multiple_genes) AS has_multiple_genes FROM (
            SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY src_ord, gene_symbol) AS place FROM @sites@) GROUP BY variant_id)
       SELECT p.patient_id, p.variant_id, CASE WHEN l.variant_id IS NOT NULL THEN l.gene_symbol ELSE g.gene_symbol END AS gene_symbol,
        l.clinvar_significance, l.review_status, coalesce(l.has_multiple_genes, false) AS has_multiple_genes, l.variant_id IS NOT NULL AS in_clinvar
       FROM @patient_sites@ p LEFT JOIN listed l ON l.variant_id = p.variant_id
       LEFT JOIN located g ON g.chromosome = p.chromosome AND g.position = p.position""",
)
def _(t: Tables):
    known = sites(t).withColumn("src_ord", F.struct("src_ord", "gene_symbol"))
    located = genes(t).withColumn("src_ord", F.struct("src_ord", "gene_symbol"))
    out = annotate.annotate_sites(t.patient_sites, known, located)
    return out.select(
        "patient_id", "variant_id", "gene_symbol", "clinvar_significance", "review_status", "has_multiple_genes", "in_clinvar"
    )


_SITE_ROWS = "(SELECT patient_id, variant_id, 'G' || (patient_id % 700) AS gene_symbol FROM @patient_sites@)"


def _site_rows(t: Tables) -> DataFrame:
    gene = F.concat(F.lit("G"), (F.col("patient_id") % 700).cast("string"))
    return t.patient_sites.select("patient_id", "variant_id", gene.alias("gene_symbol"))


@query(
    "j9_site_training_table",
    f"""SELECT r.patient_id, r.variant_id, r.gene_symbol, f.position, f.clinvar_significance, round(f.oe_lof, 9) AS oe_lof, f.gene_start_position
        FROM {_SITE_ROWS} r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY variant_id, gene_symbol ORDER BY src_ord) AS rn FROM @site_features@) f
          ON f.variant_id = r.variant_id AND f.gene_symbol = r.gene_symbol AND f.rn = 1""",
)
def _(t: Tables):
    out = features.training_table(_site_rows(t), site_features(t), "snv")
    return out.select(
        "patient_id", "variant_id", "gene_symbol", "position", "clinvar_significance", "oe_lof", "gene_start_position"
    )


@query(
    "j9_unmatched_training_rows",
    f"""SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM @site_features@ f WHERE f.variant_id = r.variant_id AND f.gene_symbol = r.gene_symbol))
        AS rows_without_features FROM {_SITE_ROWS} r""",
)
def _(t: Tables):
    return features.unmatched_rows(features.training_table(_site_rows(t), site_features(t), "snv"), "snv")


@query(
    "j9_deletion_training_table",
    """SELECT d.patient_id, d.variant_id, d.gene_symbol, f.overlap_length, f.overlap_fraction_of_gene, f.haploinsufficiency_score
        FROM (SELECT patient_id, variant_id, gene_symbol FROM @deletion_overlaps@) d
        LEFT JOIN (SELECT DISTINCT variant_id, gene_symbol, first(overlap_length) OVER w AS overlap_length, first(overlap_fraction_of_gene) OVER w AS overlap_fraction_of_gene,
            first(haploinsufficiency_score) OVER w AS haploinsufficiency_score FROM @deletion_features@
            WINDOW w AS (PARTITION BY variant_id, gene_symbol ORDER BY chromosome, deletion_start, deletion_end, deletion_size, allele_frequency, gene_start_position)) f
          ON f.variant_id = d.variant_id AND f.gene_symbol = d.gene_symbol""",
)
def _(t: Tables):
    rows = intervals.gene_overlaps(t.deletions, genes(t)).select("patient_id", "variant_id", "gene_symbol")
    out = features.training_table(rows, deletion_features(t), "cnv")
    return out.select(
        "patient_id", "variant_id", "gene_symbol", "overlap_length", "overlap_fraction_of_gene", "haploinsufficiency_score"
    )


@query(
    "j11_predictor_scores",
    """SELECT p.patient_id, p.variant_id, s.score FROM @patient_sites@ p LEFT JOIN (
        SELECT variant_id, arg_min(clinvar_significance_raw, src_ord) FILTER (true) AS score FROM (
            SELECT concat(chromosome, '_', position, '_', reference_allele, '_', alternate_allele) AS variant_id, src_ord,
                   coalesce(clinvar_significance_raw, 'none') AS clinvar_significance_raw FROM @sites_raw@) GROUP BY 1) s ON s.variant_id = p.variant_id""",
)
def _(t: Tables):
    raw = t.sites_raw
    scores = raw.select(
        F.concat_ws("_", "chromosome", "position", "reference_allele", "alternate_allele").alias("variant_id"),
        F.coalesce("clinvar_significance_raw", F.lit("none")).alias("score"),
        "src_ord",
    )
    return annotate.with_predictor_scores(t.patient_sites, scores).select("patient_id", "variant_id", "score")


@query(
    "j12_intergenic_deletions",
    """SELECT p.variant_id, p.chromosome, p.start_position FROM @population_ided@ p WHERE NOT EXISTS (SELECT 1 FROM @population_overlaps@ o WHERE o.variant_id = p.variant_id)""",
)
def _(t: Tables):
    out = annotate.without_match(population(t), intervals.gene_overlaps(population(t), genes(t)), "variant_id")
    return out.select("variant_id", "chromosome", "start_position")


def phenotype_inputs(t: Tables, duplicates: str = "last"):
    """Symptoms, gene → disease ids and symptom weights, the last two as stage tables."""
    weights = staged(phenotype.disease_weights(annotations(t), duplicates), "weights")
    ids = staged(phenotype.gene_disease_ids(gene_diseases(t)), "gene-diseases")
    return t.patient_symptoms, ids, weights


@query(
    "j13_phenotype_scores",
    """SELECT c.patient_id, c.variant_id, c.gene_symbol, round(coalesce(s.score, 0e0), 9) AS phenotype_similarity_score,
        s.disease_id AS best_matching_disease_id, s.disease_name AS best_matching_disease
        FROM @candidates@ c LEFT JOIN @candidate_scores@ s ON s.patient_id = c.patient_id AND s.gene_symbol = c.gene_symbol""",
)
def _(t: Tables):
    out = phenotype.with_phenotype_scores(t.candidates, *phenotype_inputs(t))
    return out.select(
        "patient_id", "variant_id", "gene_symbol", "phenotype_similarity_score", "best_matching_disease_id", "best_matching_disease"
    )


@query(
    "j13_phenotype_scores_summed_duplicates",
    f"""WITH s AS ({best_scores("@candidates@", "@weights_sum@")})
        SELECT patient_id, gene_symbol, round(score, 9) AS phenotype_similarity_score, disease_name AS best_matching_disease FROM s""",
)
def _(t: Tables):
    out = phenotype.phenotype_scores(t.candidates, *phenotype_inputs(t, "sum"))
    return out.select("patient_id", "gene_symbol", "phenotype_similarity_score", "best_matching_disease")


_SHARED = 150
_SIMILAR = f"""SELECT a.disease_id, b.disease_id AS other_id, count(*) AS shared
        FROM (SELECT DISTINCT * FROM @disease_items@) a JOIN (SELECT DISTINCT * FROM @disease_items@) b
          ON a.hpo_id = b.hpo_id AND a.disease_id <> b.disease_id GROUP BY ALL HAVING count(*) >= {_SHARED}"""


@query("j14_similar_diseases", _SIMILAR)
def _(t: Tables):
    return phenotype.similar_diseases(t.disease_items, t.disease_items, _SHARED)


@query(
    "j14_similar_diseases_two_symptoms",
    """WITH p AS (SELECT DISTINCT disease_id, hpo_id FROM @usable@)
       SELECT a.disease_id, b.disease_id AS other_id, count(*) AS shared FROM p a JOIN p b
          ON a.hpo_id = b.hpo_id AND a.disease_id <> b.disease_id GROUP BY ALL HAVING count(*) >= 2""",
)
def _(t: Tables):
    pairs = phenotype.disease_symptoms(annotations(t))
    return phenotype.similar_diseases(pairs, pairs, 2)


@query(
    "j16_tier_lookup",
    """SELECT c.patient_id, c.variant_id, p.phenotype_tier FROM @candidates@ c LEFT JOIN @patient_tiers@ p ON p.patient_id = c.patient_id""",
)
def _(t: Tables):
    return lookup_join(t.candidates, t.patient_tiers, "patient_id").select("patient_id", "variant_id", "phenotype_tier")


# --- aggregates ------------------------------------------------------------------------------


@query(
    "a1_distinct_counts",
    "SELECT count(DISTINCT variant_id) AS variant_id, count(DISTINCT gene_symbol) AS gene_symbol, count(DISTINCT review_status) AS review_status FROM @sites@",
)
def _(t: Tables):
    return profile.distinct_counts(sites(t), ["variant_id", "gene_symbol", "review_status"])


@query("a2_value_counts", "SELECT clinvar_significance, count(*) AS count FROM @sites@ GROUP BY 1")
def _(t: Tables):
    return profile.value_counts(sites(t), "clinvar_significance")


@query("a2_value_counts_with_missing", "SELECT sv_type_raw, count(*) AS count FROM @structural_raw@ GROUP BY 1")
def _(t: Tables):
    return profile.value_counts(t.structural_raw, "sv_type_raw", dropna=False)


@query(
    "a3_missing_counts",
    """SELECT count(*) FILTER (end_position IS NULL) AS end_position, count(*) FILTER (allele_frequency IS NULL) AS allele_frequency,
        count(*) FILTER (deletion_size IS NULL) AS deletion_size FROM @population@""",
)
def _(t: Tables):
    return profile.missing_counts(population(t), ["end_position", "allele_frequency", "deletion_size"])


def _describe_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
        round(min({column})::DOUBLE, 6) AS min, round(quantile_cont({column}, 25e-2), 6) AS p25, round(quantile_cont({column}, 5e-1), 6) AS p50,
        round(quantile_cont({column}, 75e-2), 6) AS p75, round(max({column})::DOUBLE, 6) AS max FROM {source}"""


@query(
    "a4_describe",
    " UNION ALL ".join(_describe_sql(c, "@population@") for c in ("deletion_size", "allele_frequency")),
    digits=6,
)
def _(t: Tables):
    return profile.describe(population(t), ["deletion_size", "allele_frequency"])


@query("a4_describe_prices", _describe_sql("l_extendedprice", "lineitem"), digits=6)
def _(t: Tables):
    return profile.describe(t.lineitem, ["l_extendedprice"])


_PART = "count(*) AS rows, count(score) AS covered, round(100e0 * count(score) / count(*), 9) AS percent"


@query(
    "a5_coverage_report",
    f"""SELECT 'all' AS part, {_PART} FROM @candidates@
        UNION ALL SELECT 'unique_variants', {_PART} FROM (SELECT DISTINCT ON (variant_id) * FROM @candidates@)
        UNION ALL SELECT 'is_causal=' || is_causal, {_PART} FROM @candidates@ GROUP BY is_causal""",
)
def _(t: Tables):
    return profile.coverage_report(t.candidates, "score")


@query(
    "a5_missing_by_class",
    "SELECT priority, count(*) AS count FROM @candidates@ WHERE score IS NULL GROUP BY 1",
)
def _(t: Tables):
    return profile.value_counts(t.candidates.filter(F.col("score").isNull()), "priority")


@query("a6_mean_by_label", "SELECT is_causal, round(avg(score), 4) AS mean_score FROM @candidates@ GROUP BY 1", digits=4)
def _(t: Tables):
    return profile.mean_by_label(t.candidates, "score", "is_causal")


@query(
    "a7_symptom_sets",
    """SELECT disease_id, array_to_string(list_sort(list_distinct(list(hpo_id))), ';') AS hpo_id_set FROM @usable@ GROUP BY 1""",
)
def _(t: Tables):
    sets = phenotype.symptom_sets(phenotype.disease_symptoms(annotations(t)))
    return sets.select("disease_id", F.array_join("hpo_id_set", ";").alias("hpo_id_set"))


@query(
    "a7_diseases_per_symptom",
    """SELECT DISTINCT hpo_id, disease_id, count(DISTINCT disease_id) OVER (PARTITION BY hpo_id) AS diseases
        FROM (SELECT DISTINCT hpo_id, disease_id FROM @usable@)""",
)
def _(t: Tables):
    """The inverse index stays a pair table: a frequent symptom's diseases are not gathered in one row."""
    pairs = phenotype.disease_symptoms(annotations(t))
    sizes = pairs.groupBy("hpo_id").agg(F.count(F.lit(1)).alias("diseases"))
    return lookup_join(pairs, sizes, "hpo_id").select("hpo_id", "disease_id", "diseases")


@query("a8_symptom_weights_last", "SELECT disease_id, hpo_id, round(weight, 9) AS weight FROM @weights@")
def _(t: Tables):
    return phenotype.disease_weights(annotations(t), "last")


@query("a8_symptom_weights_sum", "SELECT disease_id, hpo_id, round(weight, 9) AS weight FROM @weights_sum@")
def _(t: Tables):
    return phenotype.disease_weights(annotations(t), "sum")


@query("a9_gene_disease_ids", "SELECT gene_symbol, disease_id, disease_name FROM @gene_ids@")
def _(t: Tables):
    return phenotype.gene_disease_ids(gene_diseases(t)).select("gene_symbol", "disease_id", "disease_name")


@query(
    "a10_gene_inheritance",
    """SELECT gene_symbol, arg_min(inheritance_modes, src_ord * 100 + i) AS inheritance_modes FROM @gene_diseases@
        WHERE inheritance_modes IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    return cohort.gene_inheritance(gene_diseases(t))


_RANKS = """(SELECT patient_id, min(rn) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
        ORDER BY score DESC NULLS LAST, variant_id) AS rn FROM @candidates@) WHERE is_causal = 1 GROUP BY 1)"""
_HITS = """count(*) AS n_patients, round(avg((rk <= 1)::INT), 9) AS top1_accuracy, round(avg((rk <= 5)::INT), 9) AS top5_accuracy,
        round(avg((rk <= 10)::INT), 9) AS top10_accuracy, round(avg(1e0 / rk), 9) AS mrr"""


def _ranks(t: Tables, ascending: bool = False) -> DataFrame:
    return metrics.first_hit_ranks(t.candidates, "patient_id", "score", "is_causal", "variant_id", ascending)


@query("a11_first_hit_ranks", f"SELECT patient_id, rk AS rank FROM {_RANKS}")
def _(t: Tables):
    return _ranks(t)


@query("a11_ranking_metrics", f"SELECT {_HITS} FROM {_RANKS}")
def _(t: Tables):
    return metrics.ranking_metrics(_ranks(t))


@query("a11_ranking_metrics_ascending", f"SELECT {_HITS} FROM {_RANKS.replace('score DESC', 'score ASC')}")
def _(t: Tables):
    return metrics.ranking_metrics(_ranks(t, ascending=True))


def _auc_sql(source: str, score: str, label: str) -> str:
    return f"""SELECT round((sum(r) FILTER ({label} = 1) - p * (p + 1) / 2e0) / (p * n), 9) AS roc_auc FROM (
        SELECT {label}, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2e0 AS r FROM {source} WHERE {score} IS NOT NULL),
        (SELECT count(*) FILTER ({label} = 1)::DOUBLE AS p, count(*) FILTER ({label} = 0)::DOUBLE AS n FROM {source} WHERE {score} IS NOT NULL)
        GROUP BY p, n"""


@query("a12_roc_auc", _auc_sql("@candidates@", "score", "is_causal"))
def _(t: Tables):
    return metrics.roc_auc(t.candidates, "score", "is_causal")


@query("a12_roc_auc_ties", _auc_sql("@tied_scores@", "score", "label"))
def _(t: Tables):
    return metrics.roc_auc(t.tied_scores, "score", "label")


@query(
    "a13_classification_metrics",
    """SELECT 25e0 AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1_score,
        tp::BIGINT AS true_positives, fp::BIGINT AS false_positives, fn::BIGINT AS false_negatives, tn::BIGINT AS true_negatives FROM (
        SELECT count(*) FILTER (score >= 25 AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= 25 AND label = 0)::DOUBLE AS fp,
               count(*) FILTER (score < 25 AND label = 1)::DOUBLE AS fn, count(*) FILTER (score < 25 AND label = 0)::DOUBLE AS tn FROM @tied_scores@)""",
)
def _(t: Tables):
    return metrics.classification_metrics(t.tied_scores, "score", "label", 25.0)


@query(
    "a13_classification_metrics_nothing_called",
    """SELECT 1e6 AS threshold, 0e0 AS precision, 0e0 AS recall, 0e0 AS f1_score, 0 AS true_positives, 0 AS false_positives,
        count(*) FILTER (label = 1) AS false_negatives, count(*) FILTER (label = 0) AS true_negatives FROM @tied_scores@""",
)
def _(t: Tables):
    return metrics.classification_metrics(t.tied_scores, "score", "label", 1e6)


@query(
    "a14_metrics_by_tier",
    f"""WITH r AS (SELECT r.rk, p.phenotype_tier FROM {_RANKS} r LEFT JOIN @patient_tiers@ p ON p.patient_id = r.patient_id)
        SELECT 'ALL' AS phenotype_tier, {_HITS} FROM r UNION ALL
        SELECT phenotype_tier, {_HITS} FROM r WHERE phenotype_tier IS NOT NULL GROUP BY phenotype_tier""",
)
def _(t: Tables):
    return metrics.ranking_metrics_by(lookup_join(_ranks(t), t.patient_tiers, "patient_id"), "phenotype_tier")


@query("a15_join_size_by_chromosome", "SELECT chromosome, count(*) AS pairs FROM @deletion_overlaps@ GROUP BY 1")
def _(t: Tables):
    return profile.join_size_by(intervals.gene_overlaps(t.deletions, genes(t)), "chromosome")


@query(
    "a16_global_importance",
    "SELECT feature, round(avg(abs(contribution)), 9) AS mean_abs_contribution FROM @contribution_rows@ GROUP BY 1",
)
def _(t: Tables):
    return metrics.global_importance(t.contribution_rows)


@query(
    "a17_duplicate_keys",
    "SELECT * FROM @genes@ WHERE gene_symbol IN (SELECT gene_symbol FROM @genes@ GROUP BY 1 HAVING count(*) > 1)",
)
def _(t: Tables):
    return profile.duplicate_rows(genes(t), ["gene_symbol"])


@query(
    "a18_unmapped_labels",
    """SELECT count(*) FILTER (haploinsufficiency_label IS NOT NULL AND haploinsufficiency_score IS NULL AND haploinsufficiency_label <> 'Not yet evaluated') AS haploinsufficiency_label,
        count(*) FILTER (triplosensitivity_label IS NOT NULL AND triplosensitivity_score IS NULL AND triplosensitivity_label <> 'Not yet evaluated') AS triplosensitivity_label FROM @dosage@""",
)
def _(t: Tables):
    labels = {f"{k}_label": f"{k}_score" for k in ("haploinsufficiency", "triplosensitivity")}
    return profile.unmapped_labels(dosage(t), labels)


@query(
    "a19_cohort_summary",
    """SELECT 'patients' AS measure, count(*)::DOUBLE AS value FROM (SELECT DISTINCT patient_id FROM @patient_symptoms@)
       UNION ALL SELECT 'patients_without_symptoms', 0e0
       UNION ALL SELECT 'variant_rows', count(*)::DOUBLE FROM @candidates@
       UNION ALL SELECT 'hard_negatives', sum(is_hard_negative)::DOUBLE FROM @candidates@
       UNION ALL SELECT 'variants_per_patient', round(count(*) / count(DISTINCT patient_id), 9) FROM @candidates@""",
)
def _(t: Tables):
    people = t.patient_symptoms.groupBy("patient_id").agg(F.count_distinct("hpo_id").alias("n_patient_symptoms"))
    return profile.cohort_summary(people, t.candidates)


# --- keep-first, ranking, top-n --------------------------------------------------------------


@query(
    "w1_keep_first",
    """SELECT gene_symbol, chromosome, start_position, src_ord FROM @genes@ g
        WHERE src_ord = (SELECT min(src_ord) FROM @genes@ h WHERE h.gene_symbol = g.gene_symbol)""",
)
def _(t: Tables):
    return dedupe.keep_first(genes(t), ["gene_symbol"], ["src_ord"], ["gene_symbol", "chromosome", "start_position", "src_ord"])


@query(
    "w2_most_reliable_constraint",
    """SELECT gene_symbol, round(oe_lof, 9) AS oe_lof, round(oe_lof_lower, 9) AS oe_lof_lower, round(oe_lof_upper, 9) AS oe_lof_upper,
        oe_lof_upper_rank, round("pLI", 9) AS "pLI" FROM @constraint_table@""",
)
def _(t: Tables):
    return constraint(t).drop("src_ord")


@query(
    "w3_most_dosage_sensitive_gene",
    """SELECT variant_id, gene_symbol, haploinsufficiency_score FROM (SELECT *, row_number() OVER (PARTITION BY variant_id
        ORDER BY haploinsufficiency_score DESC NULLS LAST, gene_symbol) AS rn FROM @deletion_features@) WHERE rn = 1""",
)
def _(t: Tables):
    return dedupe.most_dosage_sensitive(deletion_features(t)).select("variant_id", "gene_symbol", "haploinsufficiency_score")


_RANKED = """SELECT patient_id, variant_id, gene_symbol, score, row_number() OVER (PARTITION BY patient_id
        ORDER BY score DESC NULLS LAST, variant_id) AS rank FROM @candidates@"""


@query("w4_rank_candidates", _RANKED)
def _(t: Tables):
    return rank_candidates(t.candidates, score="score").select("patient_id", "variant_id", "gene_symbol", "score", "rank")


@query(
    "w4_rank_candidates_sliced",
    _RANKED.replace("PARTITION BY patient_id", "PARTITION BY is_causal").replace("SELECT patient_id,", "SELECT is_causal, patient_id,", 1),
)
def _(t: Tables):
    """Two groups only, each far above the group limit set here, so the sliced ranking runs."""
    order = [F.desc_nulls_last("score"), F.asc("variant_id")]
    ranked = rank_rows(t.candidates, ["is_causal"], order, "rank", group_rows=1000)
    return ranked.select("is_causal", "patient_id", "variant_id", "gene_symbol", "score", "rank")


@query(
    "w5_best_disease",
    "SELECT patient_id, gene_symbol, disease_id AS best_matching_disease_id FROM @candidate_scores@",
)
def _(t: Tables):
    out = phenotype.phenotype_scores(t.candidates, *phenotype_inputs(t))
    return out.select("patient_id", "gene_symbol", "best_matching_disease_id")


@query(
    "w6_top_evidence",
    """SELECT row_id, direction, feature, place, round(contribution, 9) AS contribution FROM (
        SELECT row_id, CASE WHEN contribution > 0 THEN 'supporting' ELSE 'opposing' END AS direction, feature, contribution,
          row_number() OVER (PARTITION BY row_id, contribution > 0 ORDER BY abs(contribution) DESC, feature) AS place
        FROM @contribution_rows@ WHERE contribution <> 0) WHERE place <= 2""",
)
def _(t: Tables):
    from lociq.operators.explain import top_evidence

    out = top_evidence(t.contribution_rows, ["row_id"], 2)
    return out.select("row_id", "direction", "feature", "place", "contribution")


_CAPPED = """SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42|' || o_orderkey), o_orderkey) AS nth FROM orders"""


def _capped_sql(n: int, cap: int) -> str:
    return f"""WITH capped AS (SELECT * FROM ({_CAPPED}) WHERE nth <= {cap}),
        starts AS (SELECT o_custkey, sum(size) OVER (ORDER BY md5('42|' || o_custkey), o_custkey) - size AS start
                   FROM (SELECT o_custkey, count(*) AS size FROM capped GROUP BY 1))
        SELECT c.o_custkey, c.o_orderkey, (s.start + c.nth)::BIGINT AS sample_ord FROM capped c JOIN starts s ON s.o_custkey = c.o_custkey
        WHERE s.start + c.nth <= {n}"""


@query("w7_capped_sample", _capped_sql(1000, 3))
def _(t: Tables):
    out = sampling.capped_sample(t.orders, "o_custkey", ["o_orderkey"], 1000, 3, 42)
    return out.select("o_custkey", "o_orderkey", "sample_ord")


@query(
    "w8_pick_one_per_group",
    """WITH pool AS (SELECT l_suppkey AS k, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey
          ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey) AS nth FROM lineitem),
        sizes AS (SELECT k, count(*) AS n FROM pool GROUP BY 1),
        asked AS (SELECT o_orderkey, o_custkey % 100 AS k FROM orders)
        SELECT a.o_orderkey, a.k, p.l_orderkey, p.l_linenumber, p.l_partkey FROM asked a JOIN sizes s ON s.k = a.k
        JOIN pool p ON p.k = a.k AND p.nth = ('0x' || substr(md5('7|pick|' || a.o_orderkey), 1, 13))::BIGINT % s.n + 1""",
)
def _(t: Tables):
    pool = t.lineitem.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", "l_partkey")
    asked = t.orders.select("o_orderkey", (F.col("o_custkey") % 100).alias("k"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return sampling.pick_one(asked, pool, ["k"], keys, 7, F.lit("pick"), F.col("o_orderkey"))


@query("l1_sorted_ranks", _RANKED.replace("SELECT patient_id", "SELECT DISTINCT patient_id", 1))
def _(t: Tables):
    order = [F.desc_nulls_last("score"), F.asc("variant_id")]
    ranked = rank_rows(t.candidates, ["patient_id"], order)
    return ranked.select("patient_id", "variant_id", "gene_symbol", "score", "rank").orderBy("patient_id", "rank")


def _terms(t: Tables) -> DataFrame:
    return t.part.select(
        F.concat(F.lit("HP:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("HPO_ID"),
        F.col("p_name").alias("Name"),
        F.col("p_partkey").alias("src_ord"),
    )


@query(
    "l2_term_search",
    """SELECT 'HP:' || lpad(p_partkey::VARCHAR, 7, '0') AS "HPO_ID", p_name AS "Name" FROM part WHERE p_name ILIKE '%WIDGET%'
       ORDER BY p_partkey LIMIT 15""",
)
def _(t: Tables):
    return search.search_terms(_terms(t), "WIDGET")


@query(
    "l2_term_search_regex",
    """SELECT 'HP:' || lpad(p_partkey::VARCHAR, 7, '0') AS "HPO_ID", p_name AS "Name" FROM part WHERE regexp_matches(p_name, '(?i)^(RED|blue) ')
       ORDER BY p_partkey LIMIT 15""",
)
def _(t: Tables):
    return search.search_terms(_terms(t), "^(RED|blue) ", regex=True)


@query(
    "l2_term_search_many",
    """SELECT query, "HPO_ID", "Name", place FROM (SELECT q AS query, 'HP:' || lpad(p_partkey::VARCHAR, 7, '0') AS "HPO_ID", p_name AS "Name",
        row_number() OVER (PARTITION BY q ORDER BY p_partkey) AS place FROM part, (VALUES ('ring'), ('Red'), ('ol'), ('LARGE')) v(q)
        WHERE p_name ILIKE '%' || q || '%') WHERE place <= 15""",
)
def _(t: Tables):
    return search.search_many(_terms(t), ["ring", "Red", "ol", "LARGE", "x", ""])


@query(
    "l3_head_per_pool",
    """SELECT patient_id, variant_id, place FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY md5('5|' || variant_id), variant_id) AS place
        FROM @candidates@ WHERE gene_symbol <> 'G' || patient_id) WHERE place <= 3""",
)
def _(t: Tables):
    foreign = t.candidates.filter(F.col("gene_symbol") != F.concat(F.lit("G"), F.col("patient_id").cast("string")))
    order = [sampling.order_hash(5, F.col("variant_id")), F.asc("variant_id")]
    return top_per_key(foreign, ["patient_id"], order, 3, rank="place").select("patient_id", "variant_id", "place")


@query(
    "l4_importance_order",
    """SELECT feature, row_number() OVER (ORDER BY avg(abs(contribution)) DESC, feature) AS place FROM @contribution_rows@ GROUP BY 1""",
)
def _(t: Tables):
    order = [F.desc("mean_abs_contribution"), F.asc("feature")]
    return rank_rows(metrics.global_importance(t.contribution_rows), [], order, "place").select("feature", "place")


# --- set operations --------------------------------------------------------------------------


@query(
    "u1_first_pool_wins",
    """SELECT patient_id, variant_id, pool FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, variant_id ORDER BY priority, place) AS rn FROM (
        SELECT l_suppkey AS patient_id, l_partkey AS variant_id, 'returned' AS pool, 0 AS priority, l_orderkey AS place FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT l_suppkey, l_partkey, 'accepted', 1, l_orderkey FROM lineitem WHERE l_returnflag = 'A'
        UNION ALL SELECT l_suppkey, l_partkey, 'other', 2, l_orderkey FROM lineitem)) WHERE rn = 1""",
)
def _(t: Tables):
    def pool(name: str, flag: str | None) -> DataFrame:
        rows = t.lineitem if flag is None else t.lineitem.filter(F.col("l_returnflag") == flag)
        return rows.select(
            F.col("l_suppkey").alias("patient_id"),
            F.col("l_partkey").alias("variant_id"),
            F.lit(name).alias("pool"),
            F.col("l_orderkey").alias("_place"),
        )

    return sampling.first_pool_wins([pool("returned", "R"), pool("accepted", "A"), pool("other", None)])


@query(
    "u2_leakage_check",
    f"""WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {order(42, 'o_custkey')}, o_custkey) <= ceil(2e-1 * count(*) OVER ()) AS in_test
            FROM (SELECT DISTINCT o_custkey FROM orders)),
        s AS (SELECT in_test, count(*) AS rows, count(DISTINCT o_custkey) AS groups FROM orders JOIN g USING (o_custkey) GROUP BY 1)
        SELECT sum(rows) FILTER (NOT in_test)::BIGINT AS train_rows, sum(rows) FILTER (in_test)::BIGINT AS test_rows,
          sum(groups) FILTER (NOT in_test)::BIGINT AS train_groups, sum(groups) FILTER (in_test)::BIGINT AS test_groups, 0 AS shared_groups FROM s""",
)
def _(t: Tables):
    train, test = sampling.group_split(t.orders, "o_custkey")
    return sampling.leakage_report(train, test, "o_custkey")


@query(
    "u2_shared_groups",
    "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
)
def _(t: Tables):
    status = F.col("o_orderstatus")
    return sampling.shared_groups(t.orders.filter(status == "F"), t.orders.filter(status == "P"), "o_custkey")


@query(
    "u3_hard_negative_flag",
    """SELECT patient_id, variant_id, max(hard)::BIGINT AS is_hard_negative FROM (
        SELECT l_suppkey AS patient_id, l_partkey AS variant_id, CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END AS hard FROM lineitem) GROUP BY ALL""",
)
def _(t: Tables):
    def pool(flag: str | None, hard: int) -> DataFrame:
        rows = t.lineitem if flag is None else t.lineitem.filter(F.col("l_returnflag") == flag)
        return rows.select(
            F.col("l_suppkey").alias("patient_id"),
            F.col("l_partkey").alias("variant_id"),
            F.lit(hard).alias("is_hard_negative"),
            F.lit(1).alias("_place"),
        )

    return sampling.first_pool_wins([pool("R", 1), pool("A", 1), pool(None, 0)])


_METHODS = {"by price": "score", "by hardness": "is_hard_negative"}


def _method_sql(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS method, {_HITS} FROM {_RANKS.replace('ORDER BY score', f'ORDER BY {column}')}"""


@query("u4_stacked_methods", " UNION ALL ".join(_method_sql(n, c) for n, c in _METHODS.items()))
def _(t: Tables):
    return metrics.compare_rankings(t.candidates, _METHODS)
