"""Training, evaluation, explanation and analysis jobs on labelled rows of the given tables.

Models train the library's 200 rounds.  Labelled tables, their vectors and the models lie in the
shared folder under the digest of the given files, so jobs that share it train each of them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lociq.catalog.oracles import best_scores, order
from lociq.catalog.registry import Tables, query
from lociq.catalog.relational import (
    annotations,
    constraint,
    deletion_features,
    dosage,
    gene_diseases,
    genes,
    site_features,
    sites,
)
from lociq.catalog.samples import deletion_cohort, site_cohort
from lociq.catalog.scans import patient_deletion_path, patient_site_path
from lociq.operators import annotate, explain, metrics, model, phenotype
from lociq.plans import analyze, evaluate, features
from lociq.plans.study import Study
from lociq.session import files_digest, scratch_path, staged
from lociq.sources import vcf
from lociq.streaming.arrivals import arriving_lines, rank_arrivals

_IDS = ["patient_id", "variant_id", "gene_symbol"]


def labelled_table(t: Tables, kind: str) -> DataFrame:
    """Labelled rows with phenotype score, feature columns and, for point variants, predictors."""
    rows = site_cohort(t) if kind == "snv" else deletion_cohort(t)
    scored = phenotype.with_phenotype_scores(
        rows, t.patient_symptoms, phenotype.gene_disease_ids(gene_diseases(t)), phenotype.disease_weights(annotations(t))
    ).drop("best_matching_disease_id")
    if kind == "snv":
        table = features.training_table(scored, site_features(t), kind)
        return annotate.with_predictor_scores(table, t.predictor_rows)
    matrix = features.cnv_features(t.deletions, genes(t), constraint(t), dosage(t), gene_diseases(t))
    return features.training_table(scored, matrix, kind)


def study(t: Tables, kind: str) -> Study:
    name = f"study-{kind}-{files_digest(t.spark, t.folder)}"
    return Study.of(t.spark, name, kind, lambda: labelled_table(t, kind))


_PATIENTS = {"snv": "@site_cohort@", "cnv": "@deletion_cohort@"}


def _test_patients(kind: str) -> str:
    """Patients that the split by hash puts on the test side."""
    return f"""SELECT patient_id FROM (SELECT patient_id, row_number() OVER (ORDER BY {order(42, 'patient_id')}, patient_id) AS nth, count(*) OVER () AS n
        FROM (SELECT DISTINCT patient_id FROM {_PATIENTS[kind]})) WHERE nth <= ceil(2e-1 * n)"""


def _lowest(column: str) -> str:
    return f"list_min([try_cast(x AS DOUBLE) FOR x IN string_split({column}, ';')]) AS \"{column}\""


_SITE_TABLE = f"""SELECT c.patient_id, c.variant_id, c.gene_symbol, c.is_causal, c.zygosity, round(coalesce(s.score, 0e0), 9) AS phenotype_similarity_score,
        f.has_multiple_genes, f.clinvar_significance, f.review_status, round(f.oe_lof, 9) AS oe_lof, round(f.oe_lof_lower, 9) AS oe_lof_lower,
        round(f.oe_lof_upper, 9) AS oe_lof_upper, f.oe_lof_upper_rank, round(f."pLI", 9) AS "pLI", f.haploinsufficiency_score, f.triplosensitivity_score,
        f.gene_start_position, f.gene_end_position, f.gene_biotype, p.* EXCLUDE (variant_id, src_ord, rn)
      FROM @site_cohort@ c LEFT JOIN ({best_scores("@site_cohort@")}) s ON s.patient_id = c.patient_id AND s.gene_symbol = c.gene_symbol
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY variant_id, gene_symbol ORDER BY src_ord) AS rn FROM @site_features@) f
        ON f.variant_id = c.variant_id AND f.gene_symbol = c.gene_symbol AND f.rn = 1
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY src_ord) AS rn FROM @predictor_rows@) p ON p.variant_id = c.variant_id AND p.rn = 1"""


@query(
    "g1_prepared_features",
    f"""SELECT * EXCLUDE (is_causal) REPLACE ({", ".join(_lowest(c) for c in model.MULTI_VALUE_SCORES)})
        FROM ({_SITE_TABLE}) WHERE patient_id NOT IN ({_test_patients("snv")})""",
)
def _(t: Tables):
    train = model.lowest_of_multi_values(study(t, "snv").train)
    return train.select(*_IDS, *model.feature_columns(train, model.SNV_DROP))


@query("g2_trained_scores")
def _(t: Tables):
    s = study(t, "snv")
    return s.full().score(s.test).select(*_IDS, "is_causal", "relevance_score")


@query(
    "g2_scored_rows",
    f"""SELECT patient_id, variant_id, gene_symbol, is_causal, true AS is_probability FROM @site_cohort@ WHERE patient_id IN ({_test_patients("snv")})""",
)
def _(t: Tables):
    """What has to hold of every score: each test row has one, and it is a probability."""
    s = study(t, "snv")
    scored = s.full().score(s.test)
    return scored.select(*_IDS, "is_causal", F.col("relevance_score").between(0, 1).alias("is_probability"))


@query("g3_ranked_test_candidates")
def _(t: Tables):
    s = study(t, "cnv")
    return model.rank_candidates(s.full().score(s.test)).select(*_IDS, "is_causal", "relevance_score", "rank")


@query(
    "g3_ranks_of_patients",
    f"""SELECT patient_id, count(*) AS candidates, 1 AS first_rank, count(*) AS last_rank, true AS follows_score
        FROM @deletion_cohort@ WHERE patient_id IN ({_test_patients("cnv")}) GROUP BY patient_id""",
)
def _(t: Tables):
    """Ranks are 1 to n without gaps and never go up where the score does."""
    s = study(t, "cnv")
    ranked = model.rank_candidates(s.full().score(s.test))
    listed = F.array_sort(F.collect_list(F.struct(F.col("rank"), (-F.col("relevance_score")).alias("low"))))
    by_patient = ranked.groupBy("patient_id").agg(listed.alias("_l"), F.count_distinct("rank").alias("candidates"))
    lows = F.col("_l.low")
    return by_patient.select(
        "patient_id",
        "candidates",
        F.get("_l", F.lit(0))["rank"].alias("first_rank"),
        F.element_at("_l", -1)["rank"].alias("last_rank"),
        (lows == F.array_sort(lows)).alias("follows_score"),
    )


@query("g4_baseline_comparison")
def _(t: Tables):
    s = study(t, "snv")
    return evaluate.baseline_comparison(s.train, s.test, s.full())


_SCORE_METRICS = f"""SELECT method, count(*) AS n_patients, avg((rank <= 1)::INT) AS top1_accuracy, avg((rank <= 5)::INT) AS top5_accuracy,
        avg((rank <= 10)::INT) AS top10_accuracy, round(avg(1e0 / rank), 9) AS mrr FROM (
          SELECT method, patient_id, min(nth) AS rank FROM (
            SELECT method, patient_id, is_causal, row_number() OVER (PARTITION BY method, patient_id ORDER BY score DESC NULLS LAST, variant_id) AS nth FROM (
              SELECT patient_id, variant_id, is_causal, unnest([{{'method': 'pathogenicity score alone', 'score': try_cast("CADD_phred" AS DOUBLE)}},
                {{'method': 'symptom match alone', 'score': phenotype_similarity_score}}], recursive := true)
              FROM ({_SITE_TABLE}) WHERE patient_id IN ({_test_patients("snv")})))
          WHERE is_causal = 1 GROUP BY ALL) GROUP BY method"""


@query("g4_single_score_baselines", _SCORE_METRICS)
def _(t: Tables):
    """The two rankings by one score alone, which need no model."""
    test = study(t, "snv").test.withColumn("cadd", F.col("CADD_phred").try_cast("double"))
    return metrics.compare_rankings(test, {n: c for n, c in evaluate.BASELINES.items() if n != "full model"})


def _study_facts(metrics_rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a study with what has to hold of their metrics."""
    top1, top5, top10, mrr = (F.col(c) for c in ("top1_accuracy", "top5_accuracy", "top10_accuracy", "mrr"))
    sound = (top1 <= top5) & (top5 <= top10) & (top10 <= 1) & (top1 <= mrr) & (mrr <= 1)
    patients = next(c for c in metrics_rows.columns if c.startswith("n_patients"))
    auc = F.col("roc_auc").between(0, 1) if "tier" not in keys else F.col("roc_auc").isNotNull() == (F.col("tier") == "ALL")
    return metrics_rows.select(*keys, F.col(patients).alias("n_patients"), (sound & auc).alias("sound"))


def _facts_sql(kind: str) -> str:
    names = ", ".join(f"('{n}')" for n in evaluate.ABLATIONS[kind])
    return f"""SELECT ablation, n_patients, true AS sound FROM (VALUES {names}) a(ablation), (SELECT count(DISTINCT patient_id) AS n_patients
        FROM {_PATIENTS[kind]} WHERE patient_id IN ({_test_patients(kind)}))"""


def _ablations(t: Tables, kind: str) -> DataFrame:
    s = study(t, kind)
    return evaluate.ablation_study(s.train, s.test, kind, s.models())


def _stratified(t: Tables) -> DataFrame:
    s = study(t, "snv")
    return evaluate.stratified_ablation_study(s.train, s.test, t.patient_tiers, s.models())


@query("g5_site_ablation_study")
def _(t: Tables):
    return _ablations(t, "snv")


@query("g5_deletion_ablation_study")
def _(t: Tables):
    return _ablations(t, "cnv")


@query("g5_site_ablation_facts", _facts_sql("snv"))
def _(t: Tables):
    return _study_facts(_ablations(t, "snv"), "ablation")


@query("g5_deletion_ablation_facts", _facts_sql("cnv"))
def _(t: Tables):
    return _study_facts(_ablations(t, "cnv"), "ablation")


@query("g6_stratified_ablation_study")
def _(t: Tables):
    return _stratified(t)


@query(
    "g6_stratified_ablation_facts",
    f"""SELECT ablation, tier, n_patients, true AS sound FROM (VALUES {", ".join(f"('{n}')" for n in evaluate.ABLATIONS["snv"])}) a(ablation), (
        SELECT unnest(CASE WHEN phenotype_tier IS NULL THEN ['ALL'] ELSE ['ALL', phenotype_tier] END) AS tier, count(*) AS n_patients
        FROM (SELECT DISTINCT patient_id FROM @site_cohort@ WHERE patient_id IN ({_test_patients("snv")})) p LEFT JOIN @patient_tiers@ USING (patient_id) GROUP BY 1)""",
)
def _(t: Tables):
    return _study_facts(_stratified(t), "ablation", "tier")


@query("g7_feature_contributions")
def _(t: Tables):
    s = study(t, "snv")
    return explain.contributions(s.full(), model.lowest_of_multi_values(s.test), _IDS)


@query(
    "g7_contributions_add_up",
    f"""SELECT patient_id, variant_id, gene_symbol, {len(model.SNV_FEATURES) - 3} AS features, true AS adds_up
        FROM @site_cohort@ WHERE patient_id IN ({_test_patients("snv")})""",
)
def _(t: Tables):
    """Contributions and the base value sum to the log-odds of the row's score."""
    s = study(t, "snv")
    full, test = s.full(), model.lowest_of_multi_values(s.test)
    total = explain.contributions(full, test, _IDS).groupBy(*_IDS).agg(F.sum("contribution").alias("_sum"), F.count(F.lit(1)).alias("features"))
    score = F.col("relevance_score")
    odds = F.log(score / (1 - score))
    base = explain.base_value(full, test)
    return full.score(test).join(total, _IDS).select(*_IDS, "features", (F.abs(F.col("_sum") + base - odds) < 1e-6).alias("adds_up"))


@query("g8_feature_importance")
def _(t: Tables):
    s = study(t, "cnv")
    return evaluate.explanation_report(s.train, s.test, "cnv", fitted=s.full())[0]


@query("g8_example_explanations")
def _(t: Tables):
    s = study(t, "snv")
    return evaluate.explanation_report(s.train, s.test, "snv", fitted=s.full())[1]


@query(
    "g8_explained_rows",
    f"""SELECT patient_id, variant_id, gene_symbol FROM @site_cohort@ WHERE is_causal = 1 AND patient_id IN ({_test_patients("snv")})
        ORDER BY patient_id, variant_id, gene_symbol LIMIT 3""",
)
def _(t: Tables):
    s = study(t, "snv")
    return evaluate.explanation_report(s.train, s.test, "snv", fitted=s.full())[1].select(*_IDS)


@query("e6_classification_report")
def _(t: Tables):
    s = study(t, "snv")
    return evaluate.classification_report(s.train, s.test, "snv", fitted=s.full())


@query(
    "e6_class_totals",
    f"""SELECT 'snv' AS model, 5e-1 AS threshold, count(*) FILTER (is_causal = 1) AS positives, count(*) FILTER (is_causal = 0) AS negatives
        FROM @site_cohort@ WHERE patient_id IN ({_test_patients("snv")})""",
)
def _(t: Tables):
    s = study(t, "snv")
    report = evaluate.classification_report(s.train, s.test, "snv", fitted=s.full())
    return report.select(
        "model", "threshold", F.expr("true_positives + false_negatives").alias("positives"), F.expr("true_negatives + false_positives").alias("negatives")
    )


@query("e6_evaluation")
def _(t: Tables):
    s = study(t, "snv")
    return evaluate.evaluate(evaluate.scored_test(s.full(), s.test))


@query(
    "s16_model_round_trip",
    f"SELECT patient_id, variant_id, gene_symbol, true AS same FROM @deletion_cohort@ WHERE patient_id IN ({_test_patients('cnv')})",
)
def _(t: Tables):
    """Scores of a saved and reloaded model next to the original's."""
    s = study(t, "cnv")
    fitted = s.full()
    path = scratch_path(t.spark, "model")
    fitted.save(path)
    scored = model.RankingModel.load(path).score(fitted.score(s.test, "original"), "reloaded")
    return scored.select(*_IDS, (F.col("original") == F.col("reloaded")).alias("same"))


def reference_tables(t: Tables) -> analyze.ReferenceTables:
    return analyze.ReferenceTables(
        genes(t), constraint(t), dosage(t), gene_diseases(t), annotations(t), sites(t)
    )


def _requests(t: Tables) -> DataFrame:
    """Symptoms per patient file as request text."""
    ids = F.concat_ws(",", F.array_sort(F.collect_set("hpo_id")))
    return t.patient_symptoms.groupBy(F.col("patient_id").cast("string").alias("patient_id")).agg(ids.alias("symptoms"))


_FILE_SYMPTOMS = "(SELECT patient_id::VARCHAR AS patient_id, hpo_id FROM @symptoms@)"


@query(
    "e1_scored_patient_sites",
    f"""WITH v AS (SELECT patient_id::VARCHAR AS patient_id, chromosome, start_position AS position, chromosome || '_' || start_position || '_A_G' AS variant_id
            FROM @deletions@ WHERE src_ord % 10 NOT IN (3, 7)),
        listed AS (SELECT variant_id, arg_min(gene_symbol, src_ord) AS gene_symbol, min(clinvar_significance) AS clinvar_significance FROM @sites@ GROUP BY 1),
        located AS (SELECT chromosome, position, arg_min(gene_symbol, src_ord) AS gene_symbol FROM (SELECT DISTINCT v.chromosome, v.position, g.gene_symbol, g.src_ord
            FROM v JOIN @genes@ g ON g.chromosome = v.chromosome AND g.start_position <= v.position AND g.end_position >= v.position) GROUP BY ALL),
        a AS (SELECT v.*, CASE WHEN l.variant_id IS NOT NULL THEN l.gene_symbol ELSE c.gene_symbol END AS gene_symbol, l.clinvar_significance, l.variant_id IS NOT NULL AS in_clinvar
            FROM v LEFT JOIN listed l ON l.variant_id = v.variant_id LEFT JOIN located c ON c.chromosome = v.chromosome AND c.position = v.position),
        s AS ({best_scores("a", "@weights_sum@", _FILE_SYMPTOMS)})
        SELECT a.patient_id, a.variant_id, a.gene_symbol, a.clinvar_significance, a.in_clinvar, round(coalesce(s.score, 0e0), 9) AS phenotype_similarity_score,
          s.disease_name AS best_matching_disease, l.gene_start_position, round(k.oe_lof, 9) AS oe_lof, d.haploinsufficiency_score
        FROM a LEFT JOIN s ON s.patient_id = a.patient_id AND s.gene_symbol = a.gene_symbol LEFT JOIN @gene_locus@ l ON l.gene_symbol = a.gene_symbol
        LEFT JOIN @constraint_table@ k ON k.gene_symbol = a.gene_symbol LEFT JOIN @dosage@ d ON d.gene_symbol = a.gene_symbol""",
)
def _(t: Tables):
    variants = vcf.read_patient_sites(t.spark, patient_site_path(t)).withColumnRenamed("patient_file", "patient_id")
    variants = staged(variants.drop("src_ord"), "variants")
    scored = analyze.scored_candidates(variants, analyze.symptom_rows(_requests(t)), "snv", reference_tables(t))
    return scored.select(
        "patient_id", "variant_id", "gene_symbol", "clinvar_significance", "in_clinvar", "phenotype_similarity_score",
        "best_matching_disease", "gene_start_position", "oe_lof", "haploinsufficiency_score",
    )


@query(
    "e2_scored_patient_deletions",
    f"""WITH v AS (SELECT patient_id::VARCHAR AS patient_id, variant_id, chromosome, start_position, end_position, src_ord
            FROM @deletions@ WHERE src_ord % 10 NOT IN (3, 7, 9)),
        a AS (SELECT v.patient_id, v.variant_id, o.gene_symbol, coalesce(o.overlap_length, 0) AS overlap_length
            FROM v LEFT JOIN @deletion_overlaps@ o ON o.src_ord = v.src_ord),
        s AS ({best_scores("a", "@weights_sum@", _FILE_SYMPTOMS)})
        SELECT a.patient_id, a.variant_id, a.gene_symbol, a.overlap_length, round(coalesce(s.score, 0e0), 9) AS phenotype_similarity_score,
          s.disease_name AS best_matching_disease FROM a LEFT JOIN s ON s.patient_id = a.patient_id AND s.gene_symbol = a.gene_symbol""",
)
def _(t: Tables):
    deletions = vcf.read_patient_deletions(t.spark, patient_deletion_path(t)).withColumnRenamed("patient_file", "patient_id")
    deletions = staged(deletions.drop("src_ord"), "deletions")
    scored = analyze.scored_candidates(deletions, analyze.symptom_rows(_requests(t)), "cnv", reference_tables(t))
    return scored.select(
        "patient_id", "variant_id", "gene_symbol", "overlap_length", "phenotype_similarity_score", "best_matching_disease"
    )


_RANKED_ROWS = f"""WITH v AS (SELECT patient_id::VARCHAR AS patient_id, chromosome, start_position AS position, chromosome || '_' || start_position || '_A_G' AS variant_id
            FROM @deletions@ WHERE src_ord % 10 NOT IN (3, 7) AND patient_id IN (SELECT patient_id FROM @symptoms@)),
        listed AS (SELECT variant_id, arg_min(gene_symbol, src_ord) AS gene_symbol, min(clinvar_significance) AS clinvar_significance FROM @sites@ GROUP BY 1),
        located AS (SELECT chromosome, position, arg_min(gene_symbol, src_ord) AS gene_symbol FROM (SELECT DISTINCT v.chromosome, v.position, g.gene_symbol, g.src_ord
            FROM v JOIN @genes@ g ON g.chromosome = v.chromosome AND g.start_position <= v.position AND g.end_position >= v.position) GROUP BY ALL),
        a AS (SELECT v.*, CASE WHEN l.variant_id IS NOT NULL THEN l.gene_symbol ELSE c.gene_symbol END AS gene_symbol, l.clinvar_significance, l.variant_id IS NOT NULL AS in_clinvar
            FROM v LEFT JOIN listed l ON l.variant_id = v.variant_id LEFT JOIN located c ON c.chromosome = v.chromosome AND c.position = v.position),
        s AS ({best_scores("a", "@weights_sum@", _FILE_SYMPTOMS)})
        SELECT a.patient_id, a.variant_id, a.gene_symbol, a.clinvar_significance, a.in_clinvar, round(coalesce(s.score, 0e0), 9) AS phenotype_similarity_score,
          s.disease_name AS best_matching_disease, row_number() OVER (PARTITION BY a.patient_id ORDER BY coalesce(s.score, 0e0) DESC, a.variant_id, a.gene_symbol NULLS LAST) AS rank
        FROM a LEFT JOIN s ON s.patient_id = a.patient_id AND s.gene_symbol = a.gene_symbol"""
_STATUS_ROWS = """SELECT patient_id::VARCHAR AS patient_file, 'snv' AS detected_type, 'snv' AS requested_mode, false AS type_mismatch,
        count(*) FILTER (src_ord % 10 NOT IN (3, 7)) AS n_variants_parsed, CASE WHEN n_variants_parsed = 0 THEN 'nothing parsed'
          WHEN patient_id NOT IN (SELECT patient_id FROM @symptoms@) THEN 'no symptoms' ELSE 'analysed' END AS status FROM @deletions@ GROUP BY patient_id"""


def _arrived(t: Tables, part: str) -> DataFrame:
    """The patient files arrive as a stream, 75 at a time, and are ranked by symptom match."""
    out, state = scratch_path(t.spark, "ranked"), scratch_path(t.spark, "arrivals")
    lines = arriving_lines(t.spark, patient_site_path(t), files_per_batch=75)
    symptoms = analyze.symptom_rows(_requests(t))
    rank_arrivals(lines, symptoms, "snv", reference_tables(t), None, out, state).awaitTermination()
    return t.spark.read.parquet(f"{out}/{part}").drop("batch")


@query("t1_ranked_arrivals", _RANKED_ROWS)
def _(t: Tables):
    return _arrived(t, "ranked").drop("relevance_score")


@query("t1_arrival_status", _STATUS_ROWS)
def _(t: Tables):
    return _arrived(t, "files")


def _in_order(ranked: DataFrame) -> DataFrame:
    """Adds whether a row's score is no higher than that of the row ranked before it."""
    before = F.lag("relevance_score").over(Window.partitionBy("patient_id").orderBy("rank"))
    return ranked.withColumn("follows_score", F.coalesce(before >= F.col("relevance_score"), F.col("rank") == 1))


def _analysis(t: Tables, kind: str, folder: str) -> analyze.Analysis:
    return analyze.analyze_cohort(t.spark, folder, _requests(t), kind, reference_tables(t), study(t, kind).live())


@query("e1_analyze_sites")
def _(t: Tables):
    return _analysis(t, "snv", patient_site_path(t)).results


@query("e1_file_status", _STATUS_ROWS)
def _(t: Tables):
    return _analysis(t, "snv", patient_site_path(t)).files


@query(
    "e1_analysed_rows",
    f"SELECT patient_id, variant_id, gene_symbol, clinvar_significance, in_clinvar, phenotype_similarity_score, best_matching_disease, true AS follows_score FROM ({_RANKED_ROWS})",
)
def _(t: Tables):
    """Every candidate with what the file and the tables say of it, ranked as the model's score orders them."""
    ranked = _analysis(t, "snv", patient_site_path(t)).results
    return _in_order(ranked).drop("rank", "relevance_score")


@query("e1_top_candidate_evidence")
def _(t: Tables):
    return _analysis(t, "snv", patient_site_path(t)).evidence


@query("e2_analyze_deletions")
def _(t: Tables):
    return _analysis(t, "cnv", patient_deletion_path(t)).results


@query(
    "e2_analysed_rows",
    f"""WITH v AS (SELECT patient_id::VARCHAR AS patient_id, variant_id, deletion_size, src_ord FROM @deletions@
            WHERE src_ord % 10 NOT IN (3, 7, 9) AND patient_id IN (SELECT patient_id FROM @symptoms@)),
        a AS (SELECT v.*, o.gene_symbol FROM v LEFT JOIN @deletion_overlaps@ o ON o.src_ord = v.src_ord),
        s AS ({best_scores("a", "@weights_sum@", _FILE_SYMPTOMS)})
        SELECT a.patient_id, a.variant_id, a.gene_symbol, a.deletion_size, round(coalesce(s.score, 0e0), 9) AS phenotype_similarity_score,
          s.disease_name AS best_matching_disease, true AS follows_score FROM a LEFT JOIN s ON s.patient_id = a.patient_id AND s.gene_symbol = a.gene_symbol""",
)
def _(t: Tables):
    ranked = _in_order(_analysis(t, "cnv", patient_deletion_path(t)).results)
    return ranked.drop("rank", "relevance_score", "overlap_fraction_of_gene")


@query(
    "e3_site_matrix_size",
    """SELECT count(*) AS rows, count(disease_name) AS with_disease, count(DISTINCT variant_id) AS variants FROM @site_features@""",
)
def _(t: Tables):
    return site_features(t).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("disease_name").alias("with_disease"),
        F.count_distinct("variant_id").alias("variants"),
    )


@query(
    "e4_deletion_feature_matrix",
    """SELECT variant_id, chromosome, deletion_start, deletion_end, deletion_size, allele_frequency, gene_symbol, gene_start_position, gene_end_position,
        gene_biotype, overlap_length, overlap_fraction_of_gene, overlap_fraction_of_deletion, round(oe_lof, 9) AS oe_lof, round(oe_lof_lower, 9) AS oe_lof_lower,
        round(oe_lof_upper, 9) AS oe_lof_upper, oe_lof_upper_rank, round("pLI", 9) AS "pLI", haploinsufficiency_label, haploinsufficiency_score,
        triplosensitivity_label, triplosensitivity_score, mim_number, disease_name, phenotype_mim_number, mapping_key, phenotype_type, inheritance_modes
        FROM @deletion_features@""",
)
def _(t: Tables):
    return deletion_features(t)


@query("g2_site_metrics_by_tier")
def _(t: Tables):
    s = study(t, "snv")
    return evaluate.evaluate_by_tier(evaluate.scored_test(s.full(), s.test), t.patient_tiers)
