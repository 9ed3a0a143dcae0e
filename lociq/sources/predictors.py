"""The wide predictor table: probed as text, or converted once to a bucketed stage table.

The text has several hundred columns, of which the key and eighteen scores are used.  A probe cuts
the key from the front of the line, drops lines that a Bloom filter of the wanted keys rules out,
takes the few wanted cells from the rest, and only then joins: no line of text is ever shuffled.
The stage table holds those columns alone, bucketed and sorted by variant, so joins by variant
leave it where it lies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lociq import schemas
from lociq.operators.bloom import bloom_filter, may_contain
from lociq.operators.joins import lookup_join
from lociq.session import staged
from lociq.sources.lines import at, read_lines, without_first_lines

# Bytes of text behind one bucket; about a twentieth of them are kept.
BUCKET_BYTES = 2 << 30


@dataclass(frozen=True)
class StagedTable:
    """The converted table and its number of buckets."""

    rows: DataFrame
    buckets: int


def needed_keys(variants: DataFrame) -> DataFrame:
    """Join keys of variant ids; ids that do not have exactly four parts are ignored."""
    return (
        variants.select("variant_id")
        .distinct()
        .filter(F.size(F.split("variant_id", "_")) == 4)
        .select("variant_id", F.translate("variant_id", "_", "\t").alias("_key"))
    )


def _scores(lines: DataFrame, places: dict[int, str]) -> DataFrame:
    """Key and score cells of each line; ``.`` becomes null."""
    split = lines.withColumn("_f", F.split("value", "\t", max(places) + 2))
    cells = [F.nullif(at(F.col("_f"), place), F.lit(".")).alias(name) for place, name in places.items() if place > 3]
    return split.select("_key", *cells, "src_ord")


def _keyed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = without_first_lines(read_lines(spark, path), 1)
    return lines.withColumn("_key", F.substring_index("value", "\t", 4))


def probe_wide_table(
    spark: SparkSession, path: str | list[str], needed: DataFrame, places: dict[int, str] | None = None
) -> DataFrame:
    """Rows of the text table whose (chr, pos, ref, alt) is asked for."""
    return probe_wide_slices(spark, [path], needed, places)


def probe_wide_slices(
    spark: SparkSession, slices: Iterable[str | list[str]], needed: DataFrame, places: dict[int, str] | None = None
) -> DataFrame:
    """The same for a table that comes in slices, each read once.

    What the filter lets through of a slice is written out, so a slice may go when the next is
    asked for; one join at the end keeps what is really wanted of all of them.
    """
    places = places or schemas.PREDICTOR_PLACES
    keys = staged(needed_keys(needed), "needed-keys")
    words, n = bloom_filter(keys, "_key")
    found = (staged(words, "needed-filter"), n)
    scores = None
    for path in slices:
        hits = staged(_scores(may_contain(_keyed_lines(spark, path), "_key", keys, filter=found), places), "probed")
        scores = hits if scores is None else scores.unionByName(hits)
    return lookup_join(scores, keys, "_key", "inner").select("variant_id", *[c for c in scores.columns if c != "_key"])


def _text_bytes(spark: SparkSession, path: str | list[str]) -> int:
    total = 0
    for p in [path] if isinstance(path, str) else path:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += files.getContentSummary(place).getLength()
    return total


def _table_name(target: str) -> str:
    return "lociq_predictors_" + hashlib.md5(target.encode()).hexdigest()


def stage_wide_table(
    spark: SparkSession,
    path: str | list[str],
    target: str,
    places: dict[int, str] | None = None,
    buckets: int | None = None,
    append: bool = False,
) -> StagedTable:
    """Convert the text once: ``variant_id``, the scores and ``src_ord``, bucketed by variant under ``target``.

    Cells are cut out before rows move to their buckets.  The number of buckets follows from the
    size of the text.  With ``append`` the rows, a further slice of the text, join those that are there
    in as many buckets.
    """
    places = places or schemas.PREDICTOR_PLACES
    buckets = buckets or max(1, math.ceil(_text_bytes(spark, path) / BUCKET_BYTES))
    scores = _scores(_keyed_lines(spark, path), places)
    rows = scores.select(F.translate("_key", "\t", "_").alias("variant_id"), *[c for c in scores.columns if c != "_key"])
    name = _table_name(target)
    (
        rows.repartition(buckets, "variant_id")
        .write.bucketBy(buckets, "variant_id")
        .sortBy("variant_id")
        .option("path", f"{target}/buckets={buckets}")
        .mode("append" if append else "overwrite")
        .saveAsTable(name)
    )
    return StagedTable(spark.table(name), buckets)


def open_staged_table(spark: SparkSession, target: str, places: dict[int, str] | None = None) -> StagedTable:
    """A stage table that another session wrote, with its buckets."""
    places = places or schemas.PREDICTOR_PLACES
    name = _table_name(target)
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = files.listStatus(place)[0].getPath()
    buckets = int(folder.getName().split("=")[1])
    cells = ", ".join(f"`{n}` string" for p, n in places.items() if p > 3)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (variant_id string, {cells}, src_ord struct<file: string, block: bigint, row: bigint>) "
        f"USING parquet CLUSTERED BY (variant_id) SORTED BY (variant_id) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return StagedTable(spark.table(name), buckets)


def probe_staged_table(table: StagedTable, needed: DataFrame) -> DataFrame:
    """Rows of the stage table that are asked for; the wanted ids move to its buckets, nothing else."""
    ids = staged(needed_keys(needed).select("variant_id"), "needed-ids")
    return may_contain(table.rows, "variant_id", ids).join(ids.repartition(table.buckets, "variant_id"), "variant_id")
