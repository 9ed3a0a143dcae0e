"""Evaluation, baselines, ablations and explanation reports."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from lociq.operators import explain, metrics, model
from lociq.operators.joins import lookup_join
from lociq.schemas import PREDICTORS
from lociq.session import staged

# Feature groups that ablations leave out.
GENE_LEVEL = [
    "oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI",
    "haploinsufficiency_score", "triplosensitivity_score",
    "gene_start_position", "gene_end_position", "gene_biotype",
]
QUALITY = ["simulated_read_depth", "simulated_genotype_quality", "simulated_filter_status"]
STRUCTURAL = [
    "deletion_size", "allele_frequency", "overlap_length", "overlap_fraction_of_gene", "overlap_fraction_of_deletion",
]
FULL = "Full model"
ABLATIONS = {
    "snv": {
        FULL: [],
        "A1: without phenotype similarity": ["phenotype_similarity_score"],
        "A2: without zygosity (inheritance proxy)": ["zygosity"],
        "A3: without gene-level evidence": GENE_LEVEL,
        "A4: without quality features": QUALITY,
        "A5: without variant functional scores": PREDICTORS,
    },
    "cnv": {
        FULL: [],
        "A1: without phenotype similarity": ["phenotype_similarity_score"],
        "A2: without zygosity": ["zygosity"],
        "A3: without gene-level evidence": GENE_LEVEL,
        "A4: without quality features": QUALITY,
        "A5: without CNV structural features": STRUCTURAL,
    },
}
# Rankings that are compared, and the column each goes by.
BASELINES = {
    "pathogenicity score alone": "cadd",
    "symptom match alone": "phenotype_similarity_score",
    "full model": "full_model_score",
}
_DROP = {"snv": model.SNV_DROP, "cnv": model.CNV_DROP}
_CATEGORIES = {"snv": model.SNV_CATEGORIES, "cnv": model.CNV_CATEGORIES}
# Bytes of vectors that one training task holds, and the least that is worth a task of its own.
TASK_BYTES = 64 * 1024 * 1024
LEAST_TASK_BYTES = 8 * 1024 * 1024
# Models trained at the same time; a training is many short jobs, which leave most of a cluster idle.
CONCURRENT = 8


def keep_lists(features: Sequence[str], left_out: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Features of each configuration, in order."""
    return {name: [f for f in features if f not in set(out)] for name, out in left_out.items()}


def training_features(train: DataFrame, kind: str) -> list[str]:
    return model.feature_columns(model.lowest_of_multi_values(train), _DROP[kind])


def fit_assembly(train: DataFrame, kind: str):
    """Assembly of every feature of ``kind`` into one vector."""
    return model.fit_assembly(model.lowest_of_multi_values(train), training_features(train, kind), _CATEGORIES[kind], model.ALL_FEATURES)


def with_vectors(df: DataFrame, assembly) -> DataFrame:
    ready = model.lowest_of_multi_values(df)
    return assembly.transform(ready).select(*ready.columns, model.ALL_FEATURES)


def stage_vectors(train: DataFrame, assembly, name: str = "vectors") -> DataFrame:
    """Label and vector of every training row, written once for all configurations.

    Training passes over the rows several times a round, so they lie in as few partitions as
    their size asks for: on a small table a round then is a handful of one-task jobs.  A table
    that is larger than that, but has fewer than a partition per core, is dealt to the cores.
    """
    spark = train.sparkSession
    written = staged(with_vectors(train, assembly).select(model.LABEL, model.ALL_FEATURES), name)
    size = written.count() * 8 * len(assembly.stages[-1].getInputCols())
    worth = min(spark.sparkContext.defaultParallelism, -(-size // LEAST_TASK_BYTES))
    return written.coalesce(max(1, -(-size // TASK_BYTES), worth))


def fit_configurations(
    vectors: DataFrame, assembly, configurations: dict[str, list[str]], **settings
) -> dict[str, model.RankingModel]:
    """A model per configuration (name to features), trained side by side from the driver.

    Configurations of the same features, such as one that leaves out what the table lacks, share a model.
    """
    spark = vectors.sparkSession

    def one(features: tuple[str, ...]) -> model.RankingModel:
        return model.train_on_vectors(vectors, assembly, features, **settings)

    lists = list(dict.fromkeys(map(tuple, configurations.values())))
    with ThreadPoolExecutor(max(1, min(CONCURRENT, len(lists)))) as pool:
        trained = dict(zip(lists, pool.map(inheritable_thread_target(spark)(one), lists)))
    return {name: trained[tuple(features)] for name, features in configurations.items()}


def fit_ablations(train: DataFrame, kind: str, names: Sequence[str] | None = None, **settings) -> dict[str, model.RankingModel]:
    """Models of the named configurations of ``ABLATIONS``, all by default."""
    assembly = fit_assembly(train, kind)
    chosen = {n: ABLATIONS[kind][n] for n in names or ABLATIONS[kind]}
    return fit_configurations(stage_vectors(train, assembly), assembly, keep_lists(training_features(train, kind), chosen), **settings)


def fit(train: DataFrame, kind: str, **settings) -> model.RankingModel:
    """Train on every feature of ``kind``."""
    return fit_ablations(train, kind, [FULL], **settings)[FULL]


def scored_test(fitted: model.RankingModel, test: DataFrame, name: str = "relevance_score") -> DataFrame:
    """Scored test rows, written out once because every metric reads them again."""
    return staged(fitted.score(model.lowest_of_multi_values(test), name), "scored")


def scored_by_all(fitted: dict[str, model.RankingModel], test: DataFrame) -> DataFrame:
    """Patient, variant and label of every test row with its score by each model, a row per model.

    All models score the rows in one pass.
    """
    ready = model.lowest_of_multi_values(test)
    if model.ALL_FEATURES not in ready.columns:
        first = next(iter(fitted.values())).pipeline.stages
        ready = PipelineModel(first[:-2]).transform(ready).select(*ready.columns, model.ALL_FEATURES)
    columns = {name: f"_score_{k}" for k, name in enumerate(fitted)}
    keep = ["patient_id", "variant_id", "gene_symbol", model.LABEL]
    scored = ready.select(*keep, model.ALL_FEATURES)
    for name, column in columns.items():
        scored = fitted[name].score(scored, column)
    return staged(metrics.stack_scores(scored, columns, keep, "ablation"), "scored")


def evaluate(scored: DataFrame, score: str = "relevance_score", patient: str = "patient_id") -> DataFrame:
    """Ranking metrics and AUC in one row."""
    ranks = metrics.first_hit_ranks(scored, patient, score, model.LABEL, "variant_id")
    auc = metrics.roc_auc(scored, score, model.LABEL).withColumn("_row", F.lit(1))
    row = metrics.ranking_metrics(ranks).withColumn("_row", F.lit(1))
    return row.join(auc, "_row").drop("_row").withColumnRenamed("n_patients", "n_patients_evaluated")


def evaluate_by_tier(scored: DataFrame, tiers: DataFrame, score: str = "relevance_score") -> DataFrame:
    """The metrics for all patients and per phenotyping tier; AUC only for all."""
    ranks = metrics.first_hit_ranks(scored, "patient_id", score, model.LABEL, "variant_id")
    tiered = lookup_join(ranks, tiers.select("patient_id", "phenotype_tier"), "patient_id")
    by_tier = metrics.ranking_metrics_by(tiered, "phenotype_tier").withColumnRenamed("phenotype_tier", "tier")
    auc = metrics.roc_auc(scored, score, model.LABEL).withColumn("tier", F.lit("ALL"))
    return by_tier.join(auc, "tier", "left")


def ablation_study(
    train: DataFrame, test: DataFrame, kind: str, fitted: dict[str, model.RankingModel] | None = None, **settings
) -> DataFrame:
    """One row of metrics per configuration."""
    scored = scored_by_all(fitted or fit_ablations(train, kind, **settings), test)
    ranks = metrics.first_hit_ranks(scored, ["ablation", "patient_id"], "score", model.LABEL, "variant_id")
    auc = metrics.roc_auc(scored, "score", model.LABEL, by=["ablation"])
    rows = metrics.ranking_metrics(ranks, ["ablation"]).withColumnRenamed("n_patients", "n_patients_evaluated")
    return rows.join(auc, "ablation")


def stratified_ablation_study(
    train: DataFrame, test: DataFrame, tiers: DataFrame, fitted: dict[str, model.RankingModel] | None = None, **settings
) -> DataFrame:
    """Metrics per configuration and tier (point variants); AUC only for all tiers together."""
    scored = scored_by_all(fitted or fit_ablations(train, "snv", **settings), test)
    ranks = metrics.first_hit_ranks(scored, ["ablation", "patient_id"], "score", model.LABEL, "variant_id")
    tiered = lookup_join(ranks, tiers.select("patient_id", "phenotype_tier"), "patient_id")
    rows = metrics.ranking_metrics_by(tiered, "phenotype_tier", ["ablation"]).withColumnRenamed("phenotype_tier", "tier")
    auc = metrics.roc_auc(scored, "score", model.LABEL, by=["ablation"]).withColumn("tier", F.lit("ALL"))
    return rows.join(auc, ["ablation", "tier"], "left")


def baseline_comparison(train: DataFrame, test: DataFrame, fitted: model.RankingModel | None = None, **settings) -> DataFrame:
    """Full model against ranking by one score alone."""
    scored = scored_test(fitted or fit(train, "snv", **settings), test, "full_model_score")
    scored = scored.withColumn("cadd", F.col("CADD_phred").cast("string").try_cast("double"))
    return metrics.compare_rankings(scored, BASELINES)


def classification_report(
    train: DataFrame, test: DataFrame, kind: str, threshold: float = 0.5, fitted: model.RankingModel | None = None, **settings
) -> DataFrame:
    scored = scored_test(fitted or fit(train, kind, **settings), test)
    report = metrics.classification_metrics(scored, "relevance_score", model.LABEL, threshold)
    return report.select(F.lit(kind).alias("model"), "*")


def explanation_report(
    train: DataFrame, test: DataFrame, kind: str, examples: int = 3, fitted: model.RankingModel | None = None, **settings
) -> tuple[DataFrame, DataFrame]:
    """(importance per feature, evidence text of the first ``examples`` causal test rows)."""
    full = fitted or fit(train, kind, **settings)
    ready = model.lowest_of_multi_values(test)
    ids = ["patient_id", "variant_id", "gene_symbol"]
    importance = metrics.global_importance(explain.contributions(full, ready, ids))
    causal = ready.filter(F.col(model.LABEL) == 1)
    order = [F.asc("patient_id"), F.asc("variant_id"), F.asc_nulls_last("gene_symbol")]
    few = causal.orderBy(*order).limit(examples)
    shown = explain.top_evidence(explain.contributions(full, few, ids), ids)
    return importance, explain.evidence_text(shown, ids)
