"""Counts and summaries that describe a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lociq.functions.clinical import NOT_EVALUATED
from lociq.functions.variants import STANDARD_CHROMOSOMES
from lociq.operators.dedupe import keep_first
from lociq.operators.joins import lookup_join
from lociq.operators.ranking import running_totals
from lociq.session import staged


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, exact or by sketch."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns])


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    kept = df.filter(F.col(column).isNotNull()) if dropna else df
    return kept.groupBy(column).count().orderBy(F.desc("count"), F.asc(column))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def describe(df: DataFrame, columns: Sequence[str], group_rows: int | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, exact linear quartiles and maximum per column.

    One pass turns all columns into counted (column, value) rows, written out once; every measure
    is read off those.  Quartiles come from running counts along the values of a column, not from
    one collected list.
    """
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(values).alias("_v")).select("_v.column", "_v.value").filter(F.col("value").isNotNull())
    counts = staged(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("times")), "values")
    weighed = F.col("value") * F.col("times")
    # One row per column of the table.
    means = F.broadcast(counts.groupBy("column").agg(F.sum("times").alias("count"), (F.sum(weighed) / F.sum("times")).alias("mean")))
    walked = running_totals(counts, ["column"], [F.asc("value")], {"upto": F.col("times")}, group_rows).join(means, "column")
    quartiles = {}
    for name, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        place = F.lit(share) * (F.col("count") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(place), F.col("value")))
        high = F.min(F.when(F.col("upto") > F.ceil(place), F.col("value")))
        part = F.first(place - F.floor(place))
        quartiles[name] = low + (high - low) * part
    spread = F.sum(F.col("times") * F.pow(F.col("value") - F.col("mean"), F.lit(2)))
    measured = walked.groupBy("column").agg(
        F.first("count").alias("count"),
        F.first("mean").alias("mean"),
        F.sqrt(spread / F.nullif(F.first("count") - 1, F.lit(0))).alias("std"),
        F.min("value").alias("min"),
        *[value.alias(name) for name, value in quartiles.items()],
        F.max("value").alias("max"),
    )
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(measured, "column", "left").na.fill(0, ["count"])


def mean_by_label(df: DataFrame, value: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.avg(value).alias(f"mean_{value}"))


def join_size_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once.  The keys are counted, not windowed."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return lookup_join(df, repeated, list(keys), "left_semi")


def unmapped_labels(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Per label column, rows whose label is given but has no score."""
    return df.agg(
        *[
            F.count_if(F.col(l).isNotNull() & F.col(s).isNull() & (F.col(l) != NOT_EVALUATED)).alias(l)
            for l, s in pairs.items()
        ]
    )


def dropped_gene_rows(genes: DataFrame) -> DataFrame:
    """How many gene rows the cleaner leaves out, and why."""
    has_symbol = F.col("gene_symbol").isNotNull()
    standard = F.coalesce(F.col("chromosome").isin(STANDARD_CHROMOSOMES), F.lit(False))
    return genes.agg(
        F.count_if(~has_symbol).alias("dropped_no_symbol"),
        F.count_if(has_symbol & ~standard).alias("dropped_alt_contigs"),
        F.count_if(has_symbol & standard).alias("kept"),
    )


def dropped_deletion_rows(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Low-quality drops of the raw table next to missing values of the cleaned one."""
    drops = raw.agg(
        F.count_if((F.col("sv_type_raw") == "DEL") & ~F.equal_null("variant_filter", F.lit("PASS"))).alias("rows")
    ).select(F.lit("dropped_low_quality").alias("measure"), "rows")
    missing = missing_counts(cleaned, ["end_position", "allele_frequency", "deletion_size"])
    stacked = missing.unpivot([], missing.columns, "measure", "rows").select(
        F.concat(F.lit("missing_"), F.col("measure")).alias("measure"), "rows"
    )
    return drops.unionByName(stacked)


def coverage_report(df: DataFrame, score: str, label: str = "is_causal", order: str = "variant_id") -> DataFrame:
    """Rows with a score and their percentage: all rows, distinct variants, and per class."""
    measures = [F.count(F.lit(1)).alias("rows"), F.count(score).alias("covered")]
    unique = keep_first(df, ["variant_id"], [F.asc(order)])
    parts = [
        df.agg(*measures).select(F.lit("all").alias("part"), "*"),
        unique.agg(*measures).select(F.lit("unique_variants").alias("part"), "*"),
        df.groupBy(label)
        .agg(*measures)
        .select(F.concat(F.lit(f"{label}="), F.col(label).cast("string")).alias("part"), "rows", "covered"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("percent", 100.0 * F.col("covered") / F.col("rows"))


def cohort_summary(patients: DataFrame, variants: DataFrame) -> DataFrame:
    """Patients, rows, rows per patient, hard negatives and patients without symptoms, as measures."""
    people = patients.agg(
        F.count(F.lit(1)).cast("double").alias("patients"),
        F.count_if(F.col("n_patient_symptoms") == 0).cast("double").alias("patients_without_symptoms"),
    )
    rows = variants.agg(
        F.count(F.lit(1)).cast("double").alias("variant_rows"),
        F.sum("is_hard_negative").cast("double").alias("hard_negatives"),
        (F.count(F.lit(1)) / F.count_distinct("patient_id")).alias("variants_per_patient"),
    )
    long = [d.unpivot([], d.columns, "measure", "value") for d in (people, rows)]
    return long[0].unionByName(long[1])
