"""Metrics and summaries against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest

from lociq.operators import metrics, profile


def scored(spark, seed=1, n=400):
    rng = random.Random(seed)
    data = [
        (rng.randrange(25) if i % 3 else 99, f"v{i:04d}", rng.choice([None, *[x / 4 for x in range(12)]]), int(rng.random() < 0.2))
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "patient_id int, variant_id string, score double, is_causal int").repartition(5)


def naive_ranks(data, ascending=False):
    out = {}
    for p in {d[0] for d in data}:
        group = sorted(
            (d for d in data if d[0] == p), key=lambda d: (d[2] is None, (d[2] or 0) * (1 if ascending else -1), d[1])
        )
        hits = [i + 1 for i, d in enumerate(group) if d[3] == 1]
        if hits:
            out[p] = hits[0]
    return out


def naive_auc(data):
    pos = [d[2] for d in data if d[3] == 1 and d[2] is not None]
    neg = [d[2] for d in data if d[3] == 0 and d[2] is not None]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ascending", [False, True])
def test_first_hit_ranks(spark, ascending):
    data, df = scored(spark)
    got = metrics.first_hit_ranks(df, "patient_id", "score", "is_causal", "variant_id", ascending)
    assert {r.patient_id: r["rank"] for r in got.collect()} == naive_ranks(data, ascending)


def test_metrics_in_large_mode(spark, large_mode):
    data, df = scored(spark, 2)
    ranks = metrics.first_hit_ranks(df, "patient_id", "score", "is_causal", "variant_id")
    assert {r.patient_id: r["rank"] for r in ranks.collect()} == naive_ranks(data)
    assert metrics.roc_auc(df, "score", "is_causal", group_rows=3).first()[0] == pytest.approx(naive_auc(data))


def test_ranking_metrics_and_auc(spark):
    data, df = scored(spark, 3)
    ranks = list(naive_ranks(data).values())
    row = metrics.ranking_metrics(metrics.first_hit_ranks(df, "patient_id", "score", "is_causal", "variant_id")).first()
    assert row.n_patients == len(ranks)
    assert row.top5_accuracy == pytest.approx(np.mean([r <= 5 for r in ranks]))
    assert row.mrr == pytest.approx(np.mean([1 / r for r in ranks]))
    assert metrics.roc_auc(df, "score", "is_causal").first()[0] == pytest.approx(naive_auc(data))


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert metrics.roc_auc(df, "score", "label").first()[0] is None


def test_tier_metrics_keep_null_tier_out(spark):
    ranks = spark.createDataFrame([(1, 1, "a"), (2, 7, "a"), (3, 2, None)], "patient_id int, rank int, tier string")
    got = {r.tier: r.n_patients for r in metrics.ranking_metrics_by(ranks, "tier").collect()}
    assert got == {"ALL": 3, "a": 2}


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 1), (None, 0)], "p double, y int")
    row = metrics.classification_metrics(df, "p", "y").first()
    assert (row.true_positives, row.false_positives, row.false_negatives, row.true_negatives) == (1, 1, 1, 1)
    assert (row.precision, row.recall, row.f1_score) == (0.5, 0.5, 0.5)


@pytest.mark.parametrize("group_rows", [None, 10])
def test_describe(spark, group_rows):
    rng = random.Random(5)
    data = [rng.choice([None, rng.randrange(40) / 8]) for _ in range(300)]
    kept = [v for v in data if v is not None]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    row = profile.describe(df, ["v"], group_rows).first()
    assert row["count"] == len(kept) and row["min"] == min(kept) and row["max"] == max(kept)
    assert row["std"] == pytest.approx(np.std(kept, ddof=1))
    assert (row.p25, row.p50, row.p75) == pytest.approx(tuple(np.percentile(kept, [25, 50, 75])))


def test_duplicate_rows_and_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, x int")
    assert sorted(r.x for r in profile.duplicate_rows(df, ["k"]).collect()) == [1, 2]
    assert {r.k: r["count"] for r in profile.value_counts(df, "k", dropna=False).collect()} == {"a": 2, "b": 1, None: 2}
    assert profile.missing_counts(df, ["k", "x"]).first() == (2, 0)


def test_all_columns_are_described_from_one_staged_table(spark, monkeypatch):
    written, real = [], profile.staged
    monkeypatch.setattr(profile, "staged", lambda df, name: written.append(name) or real(df, name))
    data = [(1.5, 7, None), (2.5, 7, None), (4.0, None, None), (4.0, -1, None), (None, 3, None)]
    df = spark.createDataFrame(data, "a double, b long, c double")
    got = {r["column"]: r for r in profile.describe(df, ["a", "b", "c"]).collect()}
    assert written == ["values"]
    frame = pd.DataFrame(data, columns=["a", "b", "c"]).astype(float).describe()
    for column in ("a", "b"):
        row = got[column]
        assert [row["count"], row["mean"], row["std"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]] == pytest.approx(list(frame[column]))
    assert tuple(got["c"]) == ("c", 0, None, None, None, None, None, None, None)
