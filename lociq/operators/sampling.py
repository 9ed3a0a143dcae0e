"""Seeded sampling and splitting.

Every choice is an md5 order or an md5 index, so a rerun, a retried task or another engine
picks the same rows.  Draws from a pool join on a row number instead of pairing every
patient with the pool.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from lociq.functions.hashing import hash_number, order_hash, unit_hash
from lociq.operators.joins import lookup_join
from lociq.operators.ranking import first_per_key, rank_rows, running_totals, top_per_key
from lociq.session import staged

# Phenotyping tiers with share, kept symptom fraction and number of noise symptoms.
PHENOTYPE_TIERS = {
    "well_phenotyped": {"probability": 0.3, "keep_fraction": (0.7, 0.9), "noise_symptoms": (0, 1)},
    "moderately_phenotyped": {"probability": 0.4, "keep_fraction": (0.4, 0.7), "noise_symptoms": (1, 3)},
    "poorly_phenotyped": {"probability": 0.3, "keep_fraction": (0.15, 0.4), "noise_symptoms": (2, 5)},
}

#: Primes just below 2**40, more than any pool has rows.
STEPS = [2**40 - 87, 2**40 - 167, 2**40 - 195, 2**40 - 203]


def capped_sample(
    df: DataFrame, group: str, row_key: Sequence[str], n: int, max_per_group: int, seed: int, place: str = "sample_ord"
) -> DataFrame:
    """At most ``max_per_group`` rows per group, whole groups in random order until ``n`` rows.

    ``place`` is the row's position 1..n in the sample.
    """
    keys = [F.col(k) for k in row_key]
    order = [order_hash(seed, *keys), *keys]
    capped = staged(top_per_key(df, [group], order, max_per_group, rank="_nth"), "capped")
    sizes = capped.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    walked = running_totals(sizes, [], [order_hash(seed, F.col(group)), F.col(group)], {"_upto": F.col("_size")})
    starts = walked.select(group, (F.col("_upto") - F.col("_size")).alias("_start")).filter(F.col("_start") < n)
    return (
        lookup_join(capped, starts, group, "inner")
        .withColumn(place, F.col("_start") + F.col("_nth"))
        .filter(F.col(place) <= n)
        .drop("_start", "_nth")
    )


def pick_one(left: DataFrame, pool: DataFrame, on: Sequence[str], pool_key: Sequence[str], seed: int, *who: Column) -> DataFrame:
    """Join one uniformly chosen pool row with the same ``on`` to every left row (inner).

    The pool is numbered within its key; a left row looks up one number, so a key with many
    pool rows is not expanded.
    """
    on = list(on)
    keys = [F.col(k) for k in pool_key]
    numbered = rank_rows(pool, on, [order_hash(seed, *keys), *keys], "_nth")
    sizes = pool.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    asked = lookup_join(left, sizes, on, "inner")
    asked = asked.withColumn("_nth", hash_number(seed, *who) % F.col("_size") + 1)
    return lookup_join(asked, numbered, on + ["_nth"], "inner").drop("_nth", "_size")


def number_pool(pool: DataFrame, row_key: Sequence[str], seed: int) -> tuple[DataFrame, int]:
    """The pool with ``_nth`` 0..n-1 in random order, and n."""
    keys = [F.col(k) for k in row_key]
    size = pool.count()
    numbered = rank_rows(pool, [], [order_hash(seed, *keys), *keys], "_nth", largest=size)
    return numbered.withColumn("_nth", F.col("_nth") - 1), size


def _step(seed: int, tag: str) -> Column:
    """One of ``STEPS`` for each patient."""
    nth = hash_number(seed, F.lit("step"), F.lit(tag), F.col("patient_id")) % len(STEPS) + 1
    return F.element_at(F.array(*[F.lit(s) for s in STEPS]), nth.cast("int"))


def draw(patients: DataFrame, numbered: DataFrame, size: int, count: Column, seed: int, tag: str) -> DataFrame:
    """``count`` different pool rows per patient: a hashed start and multiples of one of ``STEPS``.

    Patients that start near each other step differently, so their rows meet by chance only.
    Adds ``_draw`` 0..count-1 and the pool's columns.
    """
    if size == 0:
        return patients.withColumn("_draw", F.lit(0)).withColumn("_nth", F.lit(0).cast("bigint")).limit(0).join(
            numbered, "_nth"
        ).drop("_nth")
    wanted = F.least(count.cast("int"), F.lit(size))
    asked = (
        patients.withColumn("_want", wanted)
        .filter("_want > 0")
        .withColumn("_draw", F.explode(F.sequence(F.lit(0), F.col("_want") - 1)))
        .withColumn("_nth", (hash_number(seed, F.lit(tag), F.col("patient_id")) + F.col("_draw") * _step(seed, tag)) % F.lit(size))
    )
    return lookup_join(asked.drop("_want"), numbered, ["_nth"], "inner").drop("_nth")


def assign_category(shares: dict[str, float], seed: int, *key: Column) -> Column:
    """Category by cumulative share."""
    u = unit_hash(seed, *key)
    out, upto = None, 0.0
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(names[0]) if out is None else out.otherwise(names[-1])


def assign_tier(seed: int, *key: Column) -> Column:
    return assign_category({k: v["probability"] for k, v in PHENOTYPE_TIERS.items()}, seed, *key)


def between(low: Column, high: Column, seed: int, *key: Column) -> Column:
    """Uniform number in [low, high)."""
    return low + unit_hash(seed, *key) * (high - low)


def between_int(low: Column, high: Column, seed: int, *key: Column) -> Column:
    """Uniform integer in [low, high]."""
    return (low + hash_number(seed, *key) % (high - low + 1)).cast("int")


def weighted_symptoms(patients: DataFrame, annotations: DataFrame, seed: int, order: str = "src_ord") -> DataFrame:
    """Weighted sample without replacement of each patient's disease symptoms.

    ``patients`` carries patient_id, disease_id and keep_fraction.  The share kept is
    ``max(1, floor(symptoms * keep_fraction))``; keys -ln(u)/w order the symptoms.  A patient's
    list is never longer than the longest disease, which is all the ranking needs to know.
    """
    listed = first_per_key(annotations, ["disease_id", "hpo_id"], [F.asc(order)]).select(
        "disease_id", "hpo_id", (F.coalesce("frequency_numeric", F.lit(0.3)) + 0.01).alias("_w")
    )
    listed = staged(listed, "symptom-weights")
    sizes = listed.groupBy("disease_id").agg(F.count(F.lit(1)).alias("_n"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    asked = lookup_join(patients.select("patient_id", "disease_id", "keep_fraction"), sizes, "disease_id", "inner")
    asked = asked.withColumn(
        "_keep", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("keep_fraction"))).cast("bigint")
    )
    listed = lookup_join(asked, listed, "disease_id", "inner")
    u = F.lit(1.0) - unit_hash(seed, F.lit("symptom"), F.col("patient_id"), F.col("hpo_id"))
    keyed = listed.withColumn("_key", -F.log(u) / F.col("_w"))
    ranked = rank_rows(keyed, ["patient_id"], [F.asc("_key"), F.asc("hpo_id")], "_rank", largest=longest)
    return ranked.filter("_rank <= _keep").select("patient_id", "hpo_id")


def noise_symptoms(patients: DataFrame, pool: DataFrame, seed: int, row_key: Sequence[str]) -> DataFrame:
    """``n_noise`` rows of the annotation pool per patient."""
    numbered, size = number_pool(pool.select("hpo_id", *[k for k in row_key if k != "hpo_id"]), row_key, seed)
    drawn = draw(patients.select("patient_id", "n_noise"), numbered, size, F.col("n_noise"), seed, "noise")
    return drawn.select("patient_id", "hpo_id").distinct()


def _null_safe(text: str) -> Column:
    """A join key under which nulls meet."""
    return F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit(""))


def foreign_draws(patients: DataFrame, pool: DataFrame, row_key: Sequence[str], n: int, seed: int, tag: str) -> DataFrame:
    """``n`` pool rows per patient outside the causal gene and variant, or all of them if fewer.

    The pool is numbered gene by gene, so what a patient may draw is all places but one block.
    Places are a hashed start and multiples of one of ``STEPS``: a prime above the number of
    places meets none twice.  The causal variant may be listed under other genes too; as many
    more places are drawn as it has rows, and its rows left out.
    """
    keys = [F.col(k) for k in row_key]
    size = pool.count()
    gened = pool.withColumn("_gene", _null_safe("gene_symbol"))
    numbered = rank_rows(gened, [], [F.asc("_gene"), order_hash(seed, *keys), *keys], "_nth", largest=size)
    numbered = staged(numbered.withColumn("_nth", F.col("_nth") - 1), "pool")
    blocks = numbered.groupBy("_gene").agg(F.min("_nth").alias("_start"), F.count(F.lit(1)).alias("_length"))
    listed = numbered.groupBy(_null_safe("variant_id").alias("_variant")).agg(F.count(F.lit(1)).alias("_listed"))
    asked = patients.select("patient_id", "causal_variant_id", _null_safe("causal_gene").alias("_gene"), _null_safe("causal_variant_id").alias("_variant"))
    asked = lookup_join(lookup_join(asked, blocks, "_gene"), listed, "_variant").na.fill(0, ["_start", "_length", "_listed"])
    asked = asked.withColumn("_places", F.lit(size) - F.col("_length")).filter("_places > 0")
    drawn = asked.withColumn("_draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(n) + F.col("_listed"), F.col("_places")) - 1)))
    place = (hash_number(seed, F.lit(tag), F.col("patient_id")) + F.col("_draw") * _step(seed, tag)) % F.col("_places")
    drawn = drawn.withColumn("_nth", place).withColumn("_nth", F.col("_nth") + F.when(F.col("_nth") < F.col("_start"), 0).otherwise(F.col("_length")))
    found = lookup_join(drawn.select("patient_id", "causal_variant_id", "_draw", "_nth"), numbered, ["_nth"], "inner")
    foreign = found.filter(~F.equal_null("variant_id", "causal_variant_id"))
    return top_per_key(foreign, ["patient_id"], [F.asc("_draw")], n, rank="_place").select(
        "patient_id", "variant_id", "gene_symbol", "_place"
    )


def first_pool_wins(pools: Sequence[DataFrame], total: int | None = None) -> DataFrame:
    """Union of pools; a variant listed for a patient by several pools stays in the first.

    With ``total``, the first so many of a patient's variants stay, earlier pools first.
    """
    out = None
    for priority, pool in enumerate(pools):
        tagged = pool.withColumn("_priority", F.lit(priority))
        out = tagged if out is None else out.unionByName(tagged)
    order = [F.asc("_priority"), F.asc("_place")]
    kept = first_per_key(out, ["patient_id", "variant_id"], order)
    if total is not None:
        kept = top_per_key(kept, ["patient_id"], [*order, F.asc("variant_id")], total, rank="_nth").drop("_nth")
    return kept.drop("_priority", "_place")


def group_split(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly ``ceil(share * groups)`` whole groups go to test."""
    groups = df.select(group).distinct()
    n = groups.count()
    ranked = rank_rows(groups, [], [order_hash(seed, F.col(group)), F.col(group)], "_nth", largest=n)
    chosen = ranked.filter(F.col("_nth") <= ceil(share * n)).select(group)
    return lookup_join(df, chosen, group, "left_anti"), lookup_join(df, chosen, group, "left_semi")


def shared_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups found on both sides; must be empty."""
    return train.select(group).intersect(test.select(group))


def leakage_report(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """One row: rows and groups of either side, and groups found on both, which must be none."""
    sides = train.select(group, F.lit(1).alias("_train")).unionByName(test.select(group, F.lit(0).alias("_train")))
    groups = sides.groupBy(group).agg(F.sum("_train").alias("_in_train"), F.count(F.lit(1)).alias("_rows"))
    in_train, in_test = F.col("_in_train") > 0, F.col("_rows") > F.col("_in_train")
    return groups.agg(
        F.coalesce(F.sum("_in_train"), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.col("_rows") - F.col("_in_train")), F.lit(0)).alias("test_rows"),
        F.count_if(in_train).alias("train_groups"),
        F.count_if(in_test).alias("test_groups"),
        F.count_if(in_train & in_test).alias("shared_groups"),
    )
