"""Feature preparation, boosted trees and scoring, all with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from lociq.functions.variants import lowest_score, zygosity_from_genotype
from lociq.operators.ranking import rank_rows
from lociq.schemas import PREDICTORS
from lociq.session import use_checkpoints

LABEL = "is_causal"
MULTI_VALUE_SCORES = ["SIFT_score", "Polyphen2_HDIV_score", "Polyphen2_HVAR_score"]

# Columns that are not features, per variant type.
SNV_DROP = [
    "patient_id", "variant_id", "gene_symbol", "best_matching_disease",
    "chromosome", "position", "reference_allele", "alternate_allele",
    "is_hard_negative", "inheritance_modes",
]
CNV_DROP = [
    "patient_id", "variant_id", "gene_symbol", "best_matching_disease",
    "chromosome", "deletion_start", "deletion_end", "is_hard_negative",
]
# Features treated as categories.
SNV_CATEGORIES = [
    "clinvar_significance", "review_status", "zygosity", "gene_biotype",
    "SIFT_pred", "Polyphen2_HDIV_pred", "Polyphen2_HVAR_pred", "simulated_filter_status",
]
CNV_CATEGORIES = ["zygosity", "gene_biotype", "simulated_filter_status"]
# Model features in order.
SNV_FEATURES = [
    "zygosity", "simulated_read_depth", "simulated_genotype_quality", "simulated_filter_status",
    "phenotype_similarity_score", "has_multiple_genes", "clinvar_significance", "review_status",
    "oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI",
    "haploinsufficiency_score", "triplosensitivity_score",
    "gene_start_position", "gene_end_position", "gene_biotype",
    *PREDICTORS,
]
CNV_FEATURES = [
    "zygosity", "simulated_read_depth", "simulated_genotype_quality", "simulated_filter_status",
    "phenotype_similarity_score", "deletion_size", "allele_frequency",
    "gene_start_position", "gene_end_position", "gene_biotype",
    "overlap_length", "overlap_fraction_of_gene", "overlap_fraction_of_deletion",
    "oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI",
    "haploinsufficiency_score", "triplosensitivity_score",
]

# Stands for a missing number: below every real value, so one split sets missing rows apart.
MISSING = -1.0e9
# Training settings.
ROUNDS, STEP, DEPTH, SEED = 200, 0.05, 5, 42
MIN_BINS = 64
# Vector of every feature, from which a configuration takes its own.
ALL_FEATURES = "all_features"


def feature_columns(df: DataFrame, drop: Sequence[str], label: str = LABEL) -> list[str]:
    """Every column that is neither dropped nor the label."""
    return [c for c in df.columns if c not in set(drop) | {label}]


def lowest_of_multi_values(df: DataFrame) -> DataFrame:
    present = [c for c in MULTI_VALUE_SCORES if c in df.columns]
    return df.withColumns({c: lowest_score(F.col(c)) for c in present}) if present else df


def prepare_sites(df: DataFrame) -> DataFrame:
    """Features of live point variants: neutral defaults for what a patient file lacks."""
    absent = {c: F.lit(None).cast("string") for c in PREDICTORS if c not in df.columns}
    out = df.withColumns(
        {
            "zygosity": zygosity_from_genotype(F.col("genotype_raw")),
            "simulated_read_depth": F.lit(50),
            "simulated_genotype_quality": F.lit(60),
            "simulated_filter_status": F.coalesce("filter_status", F.lit("PASS")),
            **absent,
        }
    )
    return lowest_of_multi_values(out)


def prepare_deletions(df: DataFrame) -> DataFrame:
    """Features of live deletions; an unknown population frequency counts as 0.0001."""
    frequency = F.col("allele_frequency") if "allele_frequency" in df.columns else F.lit(None).cast("double")
    return df.withColumns(
        {
            "zygosity": zygosity_from_genotype(F.col("genotype_raw")),
            "simulated_read_depth": F.lit(50),
            "simulated_genotype_quality": F.lit(60),
            "simulated_filter_status": F.coalesce("filter_status", F.lit("PASS")),
            "allele_frequency": F.coalesce(frequency, F.lit(0.0001)),
        }
    )


@dataclass
class RankingModel:
    """A fitted pipeline and the names of its features in vector order."""

    pipeline: PipelineModel
    features: list[str]

    @property
    def trees(self):
        return self.pipeline.stages[-1]

    def _stages(self, df: DataFrame) -> list:
        """The steps a table still needs: none of the assembly if its vectors are there."""
        stages = self.pipeline.stages
        return stages[-2:] if ALL_FEATURES in df.columns and isinstance(stages[-2], VectorSlicer) else stages

    def assemble(self, df: DataFrame) -> DataFrame:
        """Add the ``features`` vector without scoring."""
        return PipelineModel(self._stages(df)[:-1]).transform(df)

    def score(self, df: DataFrame, name: str = "relevance_score") -> DataFrame:
        """Add the probability of being causal."""
        scored = PipelineModel(self._stages(df)).transform(df)
        return scored.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, name)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> RankingModel:
        return _named(PipelineModel.load(path))


def _named(pipeline: PipelineModel) -> RankingModel:
    assembler = next(s for s in pipeline.stages if isinstance(s, VectorAssembler))
    names = [c.removeprefix("_n_").removeprefix("_c_") for c in assembler.getInputCols()]
    slicer = next((s for s in pipeline.stages if isinstance(s, VectorSlicer)), None)
    return RankingModel(pipeline, [names[i] for i in slicer.getIndices()] if slicer else names)


def fit_assembly(df: DataFrame, features: Sequence[str], categories: Sequence[str], output: str = "features") -> PipelineModel:
    """Steps that put the given features of a table into one vector.

    Categories are indexed with an extra slot for unseen and missing values; missing numbers
    get a value of their own, because Spark's trees take no NaN.
    """
    categorical = [c for c in features if c in set(categories)]
    numeric = [c for c in features if c not in set(categories)]
    filled = ", ".join(
        f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {MISSING!r}D) as `_n_{c}`" for c in numeric
    )
    stages = [SQLTransformer(statement=f"select *{', ' + filled if filled else ''} from __THIS__")]
    if categorical:
        stages.append(
            StringIndexer(
                inputCols=categorical,
                outputCols=[f"_c_{c}" for c in categorical],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
    stages.append(
        VectorAssembler(
            inputCols=[f"_c_{c}" if c in set(categorical) else f"_n_{c}" for c in features], outputCol=output
        )
    )
    return Pipeline(stages=stages).fit(df)


def _trees(assembly: PipelineModel, label: str, rounds: int, depth: int, step: float, seed: int) -> GBTClassifier:
    arity = max([0, *[len(labels) + 1 for s in assembly.stages if hasattr(s, "labelsArray") for labels in s.labelsArray]])
    return GBTClassifier(
        featuresCol="features",
        labelCol=label,
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        seed=seed,
        maxBins=max(MIN_BINS, arity),
    )


def train(
    df: DataFrame,
    features: Sequence[str],
    categories: Sequence[str],
    label: str = LABEL,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    step: float = STEP,
    seed: int = SEED,
) -> RankingModel:
    """Boosted trees over the given features."""
    use_checkpoints(df.sparkSession)
    front = fit_assembly(df, features, categories)
    assembled = front.transform(df).select("features", F.col(label).cast("double").alias(label))
    return _named(PipelineModel(front.stages + [_trees(front, label, rounds, depth, step, seed).fit(assembled)]))


def train_on_vectors(
    vectors: DataFrame,
    assembly: PipelineModel,
    features: Sequence[str],
    label: str = LABEL,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    step: float = STEP,
    seed: int = SEED,
) -> RankingModel:
    """Boosted trees over some of the features that ``assembly`` put into ``ALL_FEATURES``."""
    use_checkpoints(vectors.sparkSession)
    names = [c.removeprefix("_n_").removeprefix("_c_") for c in assembly.stages[-1].getInputCols()]
    slicer = VectorSlicer(inputCol=ALL_FEATURES, outputCol="features", indices=[names.index(f) for f in features])
    sliced = slicer.transform(vectors).select("features", F.col(label).cast("double").alias(label))
    fitted = _trees(assembly, label, rounds, depth, step, seed).fit(sliced)
    return _named(PipelineModel(assembly.stages + [slicer, fitted]))


def rank_candidates(scored: DataFrame, patient: str = "patient_id", score: str = "relevance_score") -> DataFrame:
    """Rank 1..n of each patient's candidates by score, ties by variant and gene."""
    order = [F.desc_nulls_last(score), F.asc("variant_id"), F.asc_nulls_last("gene_symbol")]
    return rank_rows(scored, [patient], order, "rank")
