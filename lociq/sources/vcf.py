"""Variant call files: population sites, structural variants and patient files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociq.functions.text import genotype, info_value, parse_long
from lociq.functions.variants import identity, strip_chr
from lociq.operators.ranking import top_per_key
from lociq.sources.lines import at, data_lines, fields, read_lines

# Fixed value: data lines looked at to tell deletions from point variants.
PROBE_LINES = 51


def parse_sites(lines: DataFrame) -> DataFrame:
    """Population point variants: position, alleles and three INFO entries."""
    split = data_lines(lines).withColumn("_f", fields(F.col("value")))
    info = at(F.col("_f"), 7)
    return split.select(
        at(F.col("_f"), 0).alias("chromosome"),
        at(F.col("_f"), 1).cast("bigint").alias("position"),
        at(F.col("_f"), 3).alias("reference_allele"),
        at(F.col("_f"), 4).alias("alternate_allele"),
        info_value(info, "GENEINFO").alias("gene_info_raw"),
        info_value(info, "CLNSIG").alias("clinvar_significance_raw"),
        info_value(info, "CLNREVSTAT").alias("review_status_raw"),
        "src_ord",
    )


def read_sites(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_sites(read_lines(spark, path))


def parse_structural(lines: DataFrame) -> DataFrame:
    """Population structural variants with raw END, SVLEN and AF text."""
    split = data_lines(lines).withColumn("_f", fields(F.col("value")))
    info = at(F.col("_f"), 7)
    return split.select(
        at(F.col("_f"), 0).alias("chromosome"),
        at(F.col("_f"), 1).cast("bigint").alias("start_position"),
        at(F.col("_f"), 6).alias("variant_filter"),
        info_value(info, "SVTYPE").alias("sv_type_raw"),
        info_value(info, "END").alias("end_position_raw"),
        info_value(info, "SVLEN").alias("sv_length_raw"),
        info_value(info, "AF").alias("allele_frequency_raw"),
        "src_ord",
    )


def read_structural(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_structural(read_lines(spark, path))


def file_name(path: Column) -> Column:
    """Patient key of a file: its ``patient=<id>`` folder if it lies in one, else its name."""
    folder = F.regexp_extract(path, "/patient=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.substring_index(path, "/", -1))


def _genotype(parts: Column) -> Column:
    return F.when(F.size(parts) >= 10, genotype(at(parts, 8), at(parts, 9)))


def parse_patient_sites(lines: DataFrame) -> DataFrame:
    """Point variants of patient files; ``patient_file`` names the file.

    Rows with fewer than 8 fields or a position that is not an integer are left out.
    """
    split = data_lines(lines).withColumn("_f", fields(F.col("value"))).filter(F.size("_f") >= 8)
    f = F.col("_f")
    chromosome = strip_chr(at(f, 0))
    return (
        split.withColumn("position", parse_long(at(f, 1)))
        .filter(F.col("position").isNotNull())
        .select(
            file_name(F.col("file_path")).alias("patient_file"),
            chromosome.alias("chromosome"),
            "position",
            at(f, 3).alias("reference_allele"),
            at(f, 4).alias("alternate_allele"),
            at(f, 6).alias("filter_status"),
            _genotype(f).alias("genotype_raw"),
            identity(chromosome, F.col("position"), at(f, 3), at(f, 4)).alias("variant_id"),
            "src_ord",
        )
    )


def read_patient_sites(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_patient_sites(read_lines(spark, path))


def parse_patient_deletions(lines: DataFrame) -> DataFrame:
    """Deletions of patient files: SVTYPE is DEL and both ends are integers."""
    split = data_lines(lines).withColumn("_f", fields(F.col("value"))).filter(F.size("_f") >= 8)
    f = F.col("_f")
    chromosome = strip_chr(at(f, 0))
    return (
        split.withColumns({"start_position": parse_long(at(f, 1)), "end_position": parse_long(info_value(at(f, 7), "END"))})
        .filter(
            (info_value(at(f, 7), "SVTYPE") == "DEL")
            & F.col("start_position").isNotNull()
            & F.col("end_position").isNotNull()
        )
        .select(
            file_name(F.col("file_path")).alias("patient_file"),
            chromosome.alias("chromosome"),
            "start_position",
            "end_position",
            F.abs(F.col("end_position") - F.col("start_position")).alias("deletion_size"),
            F.lit(None).cast("double").alias("allele_frequency"),
            at(f, 6).alias("filter_status"),
            _genotype(f).alias("genotype_raw"),
            identity(chromosome, F.col("start_position"), F.col("end_position")).alias("variant_id"),
            "src_ord",
        )
    )


def read_patient_deletions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_patient_deletions(read_lines(spark, path))


def detect_types(lines: DataFrame, requested: str | None = None) -> DataFrame:
    """``cnv`` for files with a deletion among the first data lines, else ``snv``.

    Every file in the scan gets a row, also one with header lines only.
    """
    data = ~F.startswith("value", F.lit("#"))
    marked = lines.select(
        file_name(F.col("file_path")).alias("patient_file"),
        data.alias("_data"),
        (data & F.contains("value", F.lit("SVTYPE=DEL"))).alias("_del"),
        "src_ord",
    )
    # One pass: header lines come last, so a file without data lines still has rows.
    probe = top_per_key(marked, ["patient_file"], [F.desc("_data"), F.asc("src_ord")], PROBE_LINES)
    out = probe.groupBy("patient_file").agg(F.when(F.bool_or("_del"), "cnv").otherwise("snv").alias("detected_type"))
    if requested:
        out = out.withColumns(
            {"requested_mode": F.lit(requested), "type_mismatch": F.col("detected_type") != requested}
        )
    return out


def file_status(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per file: header seen, rows parsed, and whether it is a readable variant file."""
    name = file_name(F.col("file_path")).alias("patient_file")
    headers = lines.select(name, F.startswith("value", F.lit("#CHROM")).alias("_h"), F.lit(0).alias("_n"))
    rows = parsed.select("patient_file", F.lit(False).alias("_h"), F.lit(1).alias("_n"))
    return (
        headers.unionByName(rows)
        .groupBy("patient_file")
        .agg(F.bool_or("_h").alias("has_header"), F.sum("_n").alias("n_variants_parsed"))
        .withColumn("is_valid", F.col("has_header") | (F.col("n_variants_parsed") > 0))
    )
