"""Ranking and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lociq.operators.joins import lookup_join
from lociq.operators.ranking import running_totals
from lociq.session import staged


def first_hit_ranks(
    df: DataFrame, group: str | Sequence[str], score: str, label: str, tie: str, ascending: bool = False
) -> DataFrame:
    """Position of each group's first positive row in score order, missing scores last.

    ``group`` is the patient, or several columns where rankings of one patient are compared.

    Nothing is sorted: the best positive row of a group is one aggregate, and its position is
    one more than the number of rows that come before it.
    """
    group = [group] if isinstance(group, str) else list(group)
    value = F.col(score).cast("double")
    key = F.struct(
        F.col(score).isNull().alias("missing"),
        F.coalesce(value if ascending else -value, F.lit(0.0)).alias("value"),
        F.col(tie).alias("tie"),
    )
    keyed = df.select(*group, key.alias("_key"), F.col(label).alias("_label"))
    best = keyed.filter(F.col("_label") == 1).groupBy(*group).agg(F.min("_key").alias("_best"))
    return (
        lookup_join(keyed, best, group, "inner")
        .groupBy(*group)
        .agg((F.count_if(F.col("_key") < F.col("_best")) + 1).alias("rank"))
    )


def _hit_measures(cutoffs: Sequence[int] = (1, 5, 10)) -> list[Column]:
    hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"top{k}_accuracy") for k in cutoffs]
    return [F.count("rank").alias("n_patients"), *hits, F.avg(1 / F.col("rank")).alias("mrr")]


def ranking_metrics(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Top-1/5/10 hit rate and mean reciprocal rank, one row, or one for each of ``by``."""
    return ranks.groupBy(*by).agg(*_hit_measures())


def ranking_metrics_by(ranks: DataFrame, tier: str, by: Sequence[str] = ()) -> DataFrame:
    """The same for all groups together (``ALL``) and for each non-null tier."""
    # All rows and a row's own tier, so that ``by`` needs no grouping sets of its own.
    own = F.col(tier).cast("string")
    named = F.when(own.isNull(), F.array(F.lit("ALL"))).otherwise(F.array(F.lit("ALL"), own))
    return ranks.withColumn(tier, F.explode(named)).groupBy(*by, tier).agg(*_hit_measures())


def roc_auc(
    df: DataFrame, score: str, label: str, group_rows: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve, ties counting half, as one row, or one for each of ``by``.

    Rows are reduced to distinct scores, written out once, before the running count of positives.
    """
    by = list(by)
    counts = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    counts = staged(counts, "score-counts")
    walked = running_totals(counts, by, [F.desc("score")], {"upto": F.col("pos")}, group_rows)
    above = F.col("upto").cast("double") - F.col("pos") / 2
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return walked.groupBy(*by).agg((F.sum(F.col("neg") * above) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall and F1 at ``threshold``; empty denominators give 0."""
    called = F.coalesce(F.col(score) >= threshold, F.lit(False))
    truth = F.col(label) == 1
    counts = df.agg(
        F.count_if(called & truth).alias("true_positives"),
        F.count_if(called & ~truth).alias("false_positives"),
        F.count_if(~called & truth).alias("false_negatives"),
        F.count_if(~called & ~truth).alias("true_negatives"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.select(
        F.lit(float(threshold)).alias("threshold"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        "true_positives",
        "false_positives",
        "false_negatives",
        "true_negatives",
    )


def stack_scores(df: DataFrame, scores: dict[str, str], keep: Sequence[str], name: str = "method") -> DataFrame:
    """``keep``, the name and the value (``score``) of every score column, one row each."""
    values = F.array(*[F.struct(F.lit(n).alias(name), F.col(c).cast("double").alias("score")) for n, c in scores.items()])
    return df.select(*keep, F.explode(values).alias("_v")).select(*keep, f"_v.{name}", "_v.score")


def compare_rankings(
    df: DataFrame, methods: dict[str, str], group: str = "patient_id", label: str = "is_causal", tie: str = "variant_id"
) -> DataFrame:
    """Ranking metrics of several score columns, one row per method, from one pass over the rows."""
    stacked = stack_scores(df, methods, [group, tie, label])
    return ranking_metrics(first_hit_ranks(stacked, ["method", group], "score", label, tie), ["method"])


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
        .orderBy(F.desc("mean_abs_contribution"), F.asc("feature"))
    )
