"""Studies: whole models, trained side by side, once for all jobs that share a folder."""

import pytest
from pyspark.sql import functions as F

from lociq.catalog import QUERIES, models
from lociq.catalog.registry import Tables
from lociq.operators import model
from lociq.plans import evaluate
from lociq.plans.study import LIVE, Study
from lociq.session import exists, kept, kept_path


@pytest.fixture
def trained(monkeypatch):
    """What each training was asked for; one shallow round stands for it, so the test stays short."""
    asked, real = [], model.train_on_vectors

    def train(vectors, assembly, features, rounds=model.ROUNDS, **settings):
        asked.append((tuple(features), rounds))
        return real(vectors, assembly, features, rounds=1, depth=1, **settings)

    monkeypatch.setattr(model, "train_on_vectors", train)
    return asked


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).withColumns(
        {
            "patient_id": (F.col("id") / 8).cast("int"),
            "variant_id": F.format_string("v%d", "id"),
            "gene_symbol": F.format_string("G%d", F.col("id") % 9),
            "is_causal": (F.col("id") % 8 == 0).cast("int"),
            "is_hard_negative": F.lit(0),
            "phenotype_similarity_score": F.rand(3) + (F.col("id") % 8 == 0).cast("int"),
            "zygosity": F.when(F.col("id") % 3 > 0, "heterozygous"),
            "oe_lof": F.when(F.col("id") % 5 > 0, F.rand(4)),
            "deletion_size": F.rand(6),
            "CADD_phred": F.rand(5).cast("string"),
        }
    ).drop("id").cache()


def test_each_configuration_is_trained_once_with_every_round(spark, folder, trained, rows, monkeypatch):
    monkeypatch.setattr(models, "study", lambda t, kind: Study.of(t.spark, f"once-{kind}", kind, lambda: rows))
    names = [n for n in QUERIES if n.startswith(("g2_", "g3_", "g4_", "g5_", "g6_", "g7_", "g8_", "e6_", "s16_"))]
    assert len(names) == 22
    for name in names:
        QUERIES[name](spark, folder)
    assert {rounds for _, rounds in trained} == {200}
    assert len(trained) == sum(len(a) for a in evaluate.ABLATIONS.values())
    for kind in ("snv", "cnv"):
        models.study(Tables(spark, folder), kind).live()
    assert [rounds for _, rounds in trained[-2:]] == [200, 200] and len(trained) == 14


def test_side_by_side_equals_one_by_one(spark, rows):
    """A slice of the common vectors is the vector of the configuration's own features."""
    study = Study.of(spark, "side", "snv", lambda: rows)
    together = study.models(rounds=3, depth=3)
    assert list(together) == list(evaluate.ABLATIONS["snv"])
    for name in ("Full model", "A2: without zygosity (inheritance proxy)"):
        alone = model.train(study.train, study.features(name), model.SNV_CATEGORIES, rounds=3, depth=3)
        assert together[name].features == alone.features == study.features(name)
        scored = alone.score(together[name].score(study.test, "sliced"), "own")
        assert scored.filter("abs(sliced - own) > 1e-9").isEmpty()
        # Rows without vectors are assembled first.
        raw = study.test.drop(model.ALL_FEATURES)
        assert together[name].score(raw).select("relevance_score").exceptAll(scored.select("sliced")).isEmpty()
    assert study.features(LIVE) == ["zygosity", "phenotype_similarity_score", "oe_lof", "CADD_phred"]


def test_training_vectors_lie_in_one_partition_when_small(spark, rows):
    assembly = evaluate.fit_assembly(rows, "snv")
    assert evaluate.stage_vectors(rows.repartition(9), assembly).rdd.getNumPartitions() == 1


def test_training_vectors_are_dealt_to_the_cores_when_larger(spark, rows, monkeypatch):
    monkeypatch.setattr(evaluate, "LEAST_TASK_BYTES", 40 * 8 * 2)
    assembly = evaluate.fit_assembly(rows, "snv")
    vectors = evaluate.stage_vectors(rows.repartition(40), assembly)
    assert 1 < vectors.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert vectors.count() == rows.count()


def test_no_feature_follows_from_a_label(spark, folder):
    """No column of the labelled views or the predictors but the labels reads what the labels are made of."""
    t = Tables(spark, folder)
    for name, label in (("labelled_sites", "o_orderstatus"), ("labelled_deletions", "event_type")):
        from lociq.catalog.views import VIEWS

        other = [c for c in VIEWS[name].columns + VIEWS["predictor_rows"].columns if label in c and " as is_" not in c]
        assert other == []
    assert set(t.labelled_sites.columns) == {"patient_id", "variant_id", "genotype_raw", "is_causal", "is_hard_negative"}


def test_kept_builds_once_and_survives_a_broken_build(spark):
    built = []

    def build(path):
        built.append(path)
        spark.range(3).write.parquet(path)

    def broken(path):
        spark.range(3).write.parquet(path)
        raise OSError("lost")

    with pytest.raises(OSError):
        kept(spark, "kept/one", broken)
    first = kept(spark, "kept/one", build)
    assert kept(spark, "kept/one", build) == first == kept_path(spark, "kept/one") and len(built) == 1

    def beaten(path):
        build(path)
        kept(spark, "kept/two", build)

    assert spark.read.parquet(kept(spark, "kept/two", beaten)).count() == 3 and len(built) == 3


def test_configurations_of_the_same_features_share_a_training(spark, rows, trained):
    """Without simulated columns, leaving the quality features out is the full model: five trainings for six names."""
    study = Study.of(spark, "shared-trainings", "snv", lambda: rows)
    fitted = study.models()
    assert list(fitted) == list(evaluate.ABLATIONS["snv"]) and len(trained) == 5
    assert fitted[evaluate.FULL].features == fitted["A4: without quality features"].features


def test_a_study_keeps_its_rows_once(spark, rows):
    study = Study.of(spark, "rows-once", "snv", lambda: rows)
    assert not exists(spark, f"{kept_path(spark, 'rows-once')}/data/table")
    assert study.train.count() + study.test.count() == rows.count()
