"""Hot keys, hot groups, and the plans that keep them apart."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from lociq.operators import joins
from lociq.operators.joins import lookup_join, spread_join
from lociq.operators.ranking import rank_rows, running_totals, top_per_key


def skewed(spark, n=600, seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * (n // 3) + [None] * (n // 6) + [f"k{rng.randrange(40)}" for _ in range(n // 2)]
    return spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)], "k string, x int").repartition(4)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5), ("zzz", 6)], "k string, y int")
    plain = left.join(right, ["k"], how)
    spread = spread_join(left, right, ["k"], how, hot_rows=20)
    assert rows(spread.select(*plain.columns)) == rows(plain)


def test_spread_join_hot_on_both_sides_and_copies(spark):
    left = spark.range(300).select(F.lit("hot").alias("k"), F.lit(1).alias("x")).repartition(5)
    right = spark.range(120).select(F.lit("hot").alias("k"), F.lit(2).alias("y")).repartition(3)
    assert spread_join(left, right, ["k"], "inner", hot_rows=25).count() == 300 * 120


def test_spread_join_splits_the_hot_key(spark):
    left = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id")).repartition(8)
    right = spark.createDataFrame([("hot", 1)], "k string, y int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(left, right, ["k"], "left", hot_rows=100)
        parts = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert len(parts) >= 6 and max(p["count"] for p in parts) < 2000


def test_lookup_join_both_ways(spark, large_mode):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("k1", 3)], "k string, y int")
    out = lookup_join(left, right, "k")
    assert out.count() == left.count()
    assert out.filter("y = 1").count() == 200


def test_top_per_key_is_cut_before_the_shuffle(spark):
    top = top_per_key(spark.range(100).select((F.col("id") % 3).alias("k"), "id"), ["k"], ["id"], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
    assert rows(top) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]


@pytest.mark.parametrize("group", [["g"], []])
def test_sliced_running_totals_equal_plain_ones(spark, group):
    rng = random.Random(3)
    data = [("big" if i % 3 else f"g{i % 9}", rng.randrange(50), i, rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(data, "g string, s int, id int, w int").repartition(6)
    order = [F.desc("s"), F.asc("id")]
    totals = {"n": F.lit(1), "w_sum": F.col("w")}
    plain = running_totals(df, group, order, totals, group_rows=10**6)
    sliced = running_totals(df, group, order, totals, group_rows=50)
    assert rows(sliced.select(*plain.columns)) == rows(plain)


def test_ranks_are_consecutive_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("b", 1.0, 4)], "g string, s double, id int")
    ranked = rank_rows(df, ["g"], [F.desc_nulls_last("s"), F.asc("id")], group_rows=1)
    assert rows(ranked.select("g", "id", "rank")) == [("a", 1, 3), ("a", 2, 1), ("a", 3, 2), ("b", 4, 1)]


def test_every_hot_key_is_split(spark, monkeypatch):
    """More hot keys than any list of the largest would hold, and keys that are hot by their pairs alone."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    left = spark.range(6000).select((F.col("id") % 1500).alias("k"), "id")
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = joins._hot_keys(left, right, ["k"], 3)
    assert hot.count() == 1500 and {(r._ls, r._rs) for r in hot.collect()} == {(2, 1)}
    assert joins.spread_join(left, right, ["k"], hot_rows=3).count() == 6000
    monkeypatch.setattr(joins, "HOT_KEY_PAIRS", 8)
    both = spark.range(30).select(F.lit(1).alias("k"), "id")
    hot = joins._hot_keys(both, both.withColumnRenamed("id", "v"), ["k"], 1000).first()
    assert hot._ls * hot._rs >= 30 * 30 // 8 // 4 and hot._ls <= 30
    got = joins.spread_join(both, both.withColumnRenamed("id", "v"), ["k"], hot_rows=1000)
    assert got.count() == got.distinct().count() == 900


def test_ungrouped_totals_never_meet_in_one_task(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("x"), (F.col("id") % 5).cast("double").alias("w"))
    out = running_totals(df, [], [F.asc("x")], {"n": F.lit(1), "w_upto": F.col("w")})
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.n, r.w_upto) for r in out.orderBy("x").collect()]
    values = [r.w for r in df.orderBy("x").collect()]
    assert got == [(i + 1, sum(values[: i + 1])) for i in range(2000)]
    assert running_totals(df.limit(0), [], [F.asc("x")], {"n": F.lit(1)}).count() == 0


def test_known_sizes_spare_the_count(spark, large_mode):
    left = spark.range(40).select(F.when(F.col("id") > 3, F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k long, w string")
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("_l"))
    assert rows(lookup_join(left, right, "k", sizes=sizes)) == rows(left.join(right, "k", "left"))
    with pytest.raises(ValueError, match="counts both sides"):
        spread_join(left, right, ["k"], "inner", sizes=sizes)


def test_distinct_variants_are_resolved_once(spark, large_mode, monkeypatch):
    from lociq.operators import annotate

    written = []
    real = annotate.staged
    monkeypatch.setattr(annotate, "staged", lambda df, name: written.append(name) or real(df, name))
    variants = spark.createDataFrame(
        [(p, v, c, x) for p in range(9) for v, c, x in [("a", "1", 5), ("b", "1", 50), (None, "1", 5), ("a", None, 5), ("d", "2", 7)]],
        "patient_id long, variant_id string, chromosome string, position long",
    )
    known = spark.createDataFrame([("a", "GA", "Benign", "r", True, 1)], "variant_id string, gene_symbol string, clinvar_significance string, review_status string, has_multiple_genes boolean, src_ord long")
    genes = spark.createDataFrame([("1", 40, 60, "GB", "x", 1)], "chromosome string, start_position long, end_position long, gene_symbol string, gene_biotype string, src_ord long")
    found = annotate.annotate_sites(variants, known, genes).select("variant_id", "chromosome", "gene_symbol", "in_clinvar")
    expected = [("a", "1", "GA", True), ("b", "1", "GB", False), (None, "1", None, None), ("a", None, None, None), ("d", "2", None, False)]
    assert rows(found) == sorted(expected * 9, key=repr)
    assert written == ["distinct-variants", "matched-variants"]


def test_few_rows_cut_a_large_lookup_table(spark):
    """A large reference table is cut to the keys of a small left side before it is shuffled."""
    left = spark.sql("SELECT * FROM VALUES (1L, 'a'), (1L, 'b'), (CAST(NULL AS BIGINT), 'c'), (-5L, 'd') AS t(k, v)")
    right = spark.range(6_000_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    out = joins.lookup_join(left, right, "k")
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.select("v", "w").collect())) == [("a", 2), ("b", 2), ("c", None), ("d", None)]
    assert joins.lookup_join(left, right, "k", "left_anti").count() == 2
