"""Gene annotation, delimited tables and stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociq import schemas
from lociq.functions.text import attribute_value, empty_to_null
from lociq.sources.lines import at, data_lines, fields, line_order, read_lines, whole_records, without_first_lines


def parse_gene_annotation(lines: DataFrame) -> DataFrame:
    """Rows of feature ``gene`` with symbol, id and biotype."""
    split = data_lines(lines).withColumn("_f", fields(F.col("value"))).filter(at(F.col("_f"), 2) == "gene")
    f = F.col("_f")
    return split.select(
        at(f, 0).alias("chromosome"),
        at(f, 3).cast("bigint").alias("start_position"),
        at(f, 4).cast("bigint").alias("end_position"),
        attribute_value(at(f, 8), "gene_name").alias("gene_symbol"),
        attribute_value(at(f, 8), "gene_id").alias("gene_id"),
        attribute_value(at(f, 8), "gene_biotype").alias("gene_biotype"),
        "src_ord",
    )


def read_gene_annotation(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gene_annotation(read_lines(spark, path))


def _quoted(columns: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _records(lines: DataFrame, columns: list[str], sep: str) -> DataFrame:
    record = F.from_csv("value", _quoted(columns), {"sep": sep, "escape": '"'})
    return lines.select(record.alias("_r"), "src_ord").select(
        *[empty_to_null(F.col(f"_r.`{c}`")).alias(c) for c in columns], "src_ord"
    )


def _header(lines: DataFrame, sep: str) -> list[str]:
    """Column names, which all files must share; at most two lines reach the driver."""
    first = lines.filter(F.col("src_ord.block") == 0).groupBy("file_path").agg(F.min_by("value", "src_ord").alias("_line"))
    found = first.select("_line").distinct().limit(2).collect()
    if not found:
        raise ValueError("file has no header line")
    if len(found) > 1:
        raise ValueError("files differ in their header lines")
    return [name.strip().strip('"') for name in found[0][0].split(sep)]


def read_constraint(spark: SparkSession, path: str) -> DataFrame:
    """Header TSV of gene constraint; the needed columns as numbers."""
    lines = read_lines(spark, path)
    table = _records(whole_records(without_first_lines(lines, 1)), _header(lines, "\t"), "\t")
    numeric = ["oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI"]
    value = {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in numeric}
    return table.withColumns(value)


def read_dosage(spark: SparkSession, path: str, preamble: int = 4) -> DataFrame:
    """CSV with descriptive lines before its header; quoted fields may hold line breaks."""
    lines = without_first_lines(read_lines(spark, path), preamble)
    return _records(whole_records(without_first_lines(lines, 1)), _header(lines, ","), ",")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Disease–symptom TSV: ``#`` comments, header, every column text."""
    lines = data_lines(read_lines(spark, path))
    columns = _header(lines, "\t")
    return _records(lines.filter(F.col("value") != "\t".join(columns)), columns, "\t")


def read_headerless(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """TSV whose header is itself a ``#`` comment; every column text."""
    return _records(data_lines(read_lines(spark, path)).filter("trim(value) != ''"), columns, "\t")


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    return read_headerless(spark, path, schemas.GENEMAP_COLUMNS)


def read_mim_genes(spark: SparkSession, path: str) -> DataFrame:
    return read_headerless(spark, path, schemas.MIM2GENE_COLUMNS)


def read_mim_titles(spark: SparkSession, path: str) -> DataFrame:
    return read_headerless(spark, path, schemas.MIM_TITLE_COLUMNS)


def read_morbid_map(spark: SparkSession, path: str) -> DataFrame:
    return read_headerless(spark, path, schemas.MORBIDMAP_COLUMNS)


def read_stage(spark: SparkSession, path: str, table: str, form: str = "parquet") -> DataFrame:
    """Stage table with its fixed schema, from parquet or headed CSV."""
    schema = schemas.TABLES[table]
    if form == "parquet":
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def read_ontology(spark: SparkSession, path: str, include_self: bool = False) -> DataFrame:
    """One row per ontology term with its direct parents ``;``-joined."""
    stanza = F.col("value")
    lines = (
        spark.read.option("lineSep", "\n\n")
        .text(path)
        .select(
            F.translate("value", "\r", "").alias("value"),
            line_order(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("src_ord"),
        )
        .filter(F.ltrim(F.col("value")).startswith("[Term]") | F.contains(stanza, F.lit("\n[Term]\n")))
    )

    def tag(name: str) -> Column:
        return empty_to_null(F.regexp_extract(stanza, rf"(?m)^{name}: ([^\n]*)$", 1))

    term = tag("id")
    parents = F.regexp_extract_all(stanza, F.lit(r"(?m)^is_a: ([^\s!{]+)"), F.lit(1))
    listed = F.concat(F.array(term), parents) if include_self else parents
    return lines.select(
        term.alias("HPO_ID"),
        tag("name").alias("Name"),
        empty_to_null(F.regexp_extract(stanza, r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1)).alias("Definition"),
        F.array_join(listed, ";").alias("Parents"),
        "src_ord",
    ).filter(F.col("HPO_ID").isNotNull())
