"""Every query with an oracle against the same result from DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Queries run a second time with every side too large to broadcast and every key hot.
LARGE = [
    "j1_gene_evidence", "j4_site_feature_matrix", "j5_interval_overlap_inner", "j6_interval_overlap_left", "j7_gene_at_position",
    "j8_annotate_patient_sites", "j9_site_training_table", "j11_predictor_scores", "j12_intergenic_deletions", "j13_phenotype_scores",
    "j15_phenocopy_variants", "a4_describe", "a11_ranking_metrics", "a12_roc_auc", "a17_duplicate_keys", "w4_rank_candidates",
    "w7_capped_sample", "w8_pick_one_per_group", "m2_weighted_symptom_sample", "m3_noise_symptoms", "m4_hard_negative_draws",
    "m7_split_by_patient", "s5_preamble_csv", "s12_wide_table_probe", "e2_scored_patient_deletions",
]


@pytest.fixture(scope="module")
def engine(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.7g}"
    return str(value)


def compare(spark, engine, folder, name):
    df = entry_points.queries()[name](spark, folder)
    cursor = engine.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    wanted = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert got == wanted


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_oracle(spark, engine, folder, name, short_training):
    compare(spark, engine, folder, name)


@pytest.mark.parametrize("name", LARGE)
def test_oracle_in_large_mode(spark, engine, folder, name, large_mode):
    compare(spark, engine, folder, name)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
