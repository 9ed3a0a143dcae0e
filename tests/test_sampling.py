"""Invariants of samples, splits and cohorts."""

import random

import pytest
from pyspark.sql import functions as F

from lociq.operators import sampling
from lociq.plans import cohort


def test_split_keeps_groups_whole(spark):
    df = spark.range(1000).select((F.col("id") % 53).alias("patient_id"), "id")
    train, test = sampling.group_split(df, "patient_id", 0.2, 42)
    assert sampling.shared_groups(train, test, "patient_id").isEmpty()
    assert test.select("patient_id").distinct().count() == 11
    assert train.count() + test.count() == 1000
    again = sampling.group_split(df.repartition(7), "patient_id", 0.2, 42)[1]
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in test.collect())


def test_split_with_many_groups(spark, large_mode):
    df = spark.range(1000).select((F.col("id") % 53).alias("patient_id"), "id")
    train, test = sampling.group_split(df, "patient_id", 0.2, 42)
    assert test.select("patient_id").distinct().count() == 11 and train.count() + test.count() == 1000


def test_capped_sample(spark):
    df = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 40).alias("g"), "id")
    out = sampling.capped_sample(df, "g", ["id"], 50, 3, 1)
    assert out.count() == 50
    assert out.groupBy("g").count().agg(F.max("count")).first()[0] <= 3
    assert sorted(r.sample_ord for r in out.collect()) == list(range(1, 51))


def test_draws_are_distinct_and_foreign(spark):
    patients = spark.range(30).select(
        F.col("id").alias("patient_id"), F.concat(F.lit("G"), F.col("id") % 3).alias("causal_gene"), F.lit("v1").alias("causal_variant_id")
    )
    pool = spark.range(60).select(F.concat(F.lit("v"), "id").alias("variant_id"), F.concat(F.lit("G"), F.col("id") % 5).alias("gene_symbol"))
    out = sampling.foreign_draws(patients, pool, ["variant_id", "gene_symbol"], 4, 7, "t")
    joined = out.join(patients, "patient_id")
    assert joined.filter("gene_symbol = causal_gene or variant_id = 'v1'").isEmpty()
    sizes = out.groupBy("patient_id").agg(F.count("*").alias("n"), F.count_distinct("variant_id").alias("d")).collect()
    assert len(sizes) == 30 and all(r.n == r.d == 4 for r in sizes)


def test_draws_from_a_pool_smaller_than_asked(spark):
    patients = spark.createDataFrame([(1, "A", "x")], "patient_id long, causal_gene string, causal_variant_id string")
    pool = spark.createDataFrame([("v1", "B"), ("v2", "A")], "variant_id string, gene_symbol string")
    out = sampling.foreign_draws(patients, pool, ["variant_id", "gene_symbol"], 5, 7, "t")
    assert [r.variant_id for r in out.collect()] == ["v1"]
    assert sampling.foreign_draws(patients, pool.limit(0), ["variant_id", "gene_symbol"], 5, 7, "t").isEmpty()


def test_every_patient_gets_all_that_is_asked(spark):
    """Half of the pool is the causal gene's, and the causal variant stands under other genes too."""
    patients = spark.range(200).select(
        F.col("id").alias("patient_id"), F.lit("G").alias("causal_gene"), F.lit("v3").alias("causal_variant_id")
    )
    pool = spark.range(40).select(
        F.concat(F.lit("v"), F.when(F.col("id") < 6, 3).otherwise(F.col("id"))).alias("variant_id"),
        F.when(F.col("id") % 2 == 0, "G").when(F.col("id") < 39, F.concat(F.lit("F"), "id")).alias("gene_symbol"),
    )
    for n in (3, 17, 30):
        sizes = sampling.foreign_draws(patients, pool, ["variant_id", "gene_symbol"], n, 7, "t").groupBy("patient_id")
        sizes = sizes.agg(F.count("*").alias("n"), F.count_distinct("variant_id").alias("d")).collect()
        assert len(sizes) == 200 and all(r.n == r.d == min(n, 17) for r in sizes)


def tables(spark, seed=4):
    rng = random.Random(seed)
    classes = ["Pathogenic", "Benign", "Uncertain_significance", "Conflicting", "Likely_pathogenic", "Other"]
    known = [(f"v{i}", f"G{(i // 6) % 12 if i % 5 else 0}", classes[i % 6]) for i in range(600)]
    gene_diseases = [
        (f"G{i}", f"D{i}", str(100000 + i), "confirmed_mendelian", ["Autosomal recessive", "Autosomal dominant", None][i % 3], i)
        for i in range(12)
    ]
    annotations = [
        (f"OMIM:{100000 + i}", f"HP:{(i * 3 + j) % 14}", rng.choice([None, 0.9, 0.5]), "P", False, i * 10 + j)
        for i in range(11)
        for j in range(1 + i % 6)
    ]
    k = spark.createDataFrame(known, "variant_id string, gene_symbol string, clinvar_significance string")
    g = spark.createDataFrame(
        gene_diseases,
        "gene_symbol string, disease_name string, phenotype_mim_number string, phenotype_type string, inheritance_modes string, src_ord int",
    )
    a = spark.createDataFrame(
        annotations, "disease_id string, hpo_id string, frequency_numeric double, aspect string, is_negated boolean, src_ord int"
    )
    return k, g, a


def test_labelled_cohort(spark):
    rows = [(p, f"v{p}_{i % 14}", f"G{i % 3}", int(i == 0 and p != 3), int(i in (1, 2)), "heterozygous") for p in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "patient_id int, variant_id string, gene_symbol string, is_causal int, is_hard_negative int, zygosity string")
    out = cohort.labelled_cohort(df.unionByName(df.limit(50)), 6, 1).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, cohort.labelled_cohort(df.repartition(7), 6, 1).collect()))
    by = {p: [r for r in out if r.patient_id == p] for p in range(5)}
    assert by[3] == [] and all(len(by[p]) == 7 for p in (0, 1, 2, 4))
    for p in (0, 1, 2, 4):
        assert sum(r.is_causal for r in by[p]) == 1 and sum(r.is_hard_negative for r in by[p]) == 2
        assert len({(r.variant_id, r.gene_symbol) for r in by[p]}) == 7
    assert {tuple(r)[1:3] for r in by[0]} != {tuple(r)[1:3] for r in by[1]}


def test_weighted_symptoms_keep_share(spark):
    _, _, annotations = tables(spark)
    patients = spark.range(50).select(
        F.col("id").alias("patient_id"), F.concat(F.lit("OMIM:"), (100000 + F.col("id") % 11).cast("string")).alias("disease_id"), F.lit(0.5).alias("keep_fraction")
    )
    out = sampling.weighted_symptoms(patients, annotations, 3).groupBy("patient_id").count().collect()
    sizes = {r.patient_id: r["count"] for r in out}
    assert all(sizes[p] == max(1, int((1 + (p % 11) % 6) * 0.5)) for p in range(50))


def test_heavier_symptoms_are_kept_more_often(spark):
    annotations = spark.createDataFrame(
        [("OMIM:1", "HP:heavy", 1.0, 1), ("OMIM:1", "HP:light", 0.0, 2)], "disease_id string, hpo_id string, frequency_numeric double, src_ord int"
    )
    patients = spark.range(400).select(F.col("id").alias("patient_id"), F.lit("OMIM:1").alias("disease_id"), F.lit(0.5).alias("keep_fraction"))
    out = sampling.weighted_symptoms(patients, annotations, 5)
    assert out.filter("hpo_id = 'HP:heavy'").count() > 380 and out.count() == 400


@pytest.mark.parametrize("seed", [1, 2])
def test_tier_shares(spark, seed):
    df = spark.range(3000).select(sampling.assign_tier(seed, F.col("id")).alias("t"))
    share = {r.t: r["count"] / 3000 for r in df.groupBy("t").count().collect()}
    assert share["moderately_phenotyped"] == pytest.approx(0.4, abs=0.04)
    assert share["poorly_phenotyped"] == pytest.approx(0.3, abs=0.04)


def test_draws_of_two_patients_meet_by_chance_only(spark):
    """Rows that pairs of patients share, against what independent draws would share."""
    pool = spark.range(200).select(F.col("id").alias("row"), F.concat(F.lit("HP:"), "id").alias("hpo_id"))
    numbered, size = sampling.number_pool(pool, ["row"], 3)
    drawn = sampling.draw(spark.range(150).select(F.col("id").alias("patient_id")), numbered, size, F.lit(20), 3, "t")
    sets = {}
    for r in drawn.collect():
        sets.setdefault(r.patient_id, set()).add(r.row)
    assert all(len(s) == 20 for s in sets.values()) and len(sets) == 150
    shared = [len(sets[a] & sets[b]) for a in sets for b in sets if a < b]
    assert sum(shared) / len(shared) == pytest.approx(20 * 20 / 200, rel=0.1)
    # Runs from near starts would share ten rows or more for one pair in ten.
    assert sum(s >= 10 for s in shared) / len(shared) < 0.04
