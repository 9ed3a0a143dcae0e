"""Text lines with a source order that needs no shuffle.

Spark reads a file split front to back in one task.  File path, split offset and the
row counter inside the task therefore order all lines the way the files list them.
A ``.gz`` file is one split; a ``.bgz`` file is first copied under a ``.gz`` name, as Spark goes by
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociq.operators.ranking import running_totals
from lociq.session import files_digest, kept

_ROW_BITS = (1 << 33) - 1
# Listing tasks per core.
LISTING_TASKS = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def line_order(path: Column, block: Column) -> Column:
    """Place of a line: file, split offset, and the row counter inside the split's task."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return F.struct(path.alias("file"), block.alias("block"), row.alias("row"))


def _unpackable(spark: SparkSession, path: str) -> list[str]:
    """The path, with ``.bgz`` files in it replaced by copies that Spark unpacks.

    A copy lies in the shared folder under the digest of the file it was made of, and is made by
    the file system once for all jobs.  Blocked gzip is gzip in several members, so it is only the
    name that has to change.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    if not path.endswith(".bgz"):
        return [path]
    out = []
    for status in files.globStatus(place) or []:
        found = status.getPath()

        def copy(target: str, found=found) -> None:
            to = jvm.org.apache.hadoop.fs.Path(target)
            jvm.org.apache.hadoop.fs.FileUtil.copy(files, found, to.getFileSystem(conf), to, False, conf)

        name = found.getName().removesuffix(".bgz") + ".gz"
        out.append(kept(spark, f"unpackable/{files_digest(spark, str(found))}/{name}", copy))
    return out or [path]


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders listed many to a task: by default each folder of up to 10,000 is a task of its own."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, min(int(before), LISTING_TASKS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``, ``file_path`` and the sortable ``src_ord`` of every line."""
    paths = [q for p in ([path] if isinstance(path, str) else path) for q in _unpackable(spark, str(p))]
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    with _few_listing_tasks(spark):
        text = spark.read.text(paths)
    return text.select("value", file.alias("file_path"), line_order(file, block).alias("src_ord"))


def whole_records(lines: DataFrame) -> DataFrame:
    """Lines put together where a quoted field holds line breaks.

    A line begins a record if the quotes of the lines before it pair up, which running counts of
    quotes along the line order tell; no file has to fit one task.  Only files that hold such a
    line are looked at, others pass as they are.  Raises ValueError where a quote is never closed.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    marked = lines.withColumn("_odd", quotes % 2)
    # One row per file, as the file listing has.
    files = marked.groupBy("file_path").agg(F.sum("_odd").alias("_breaks")).filter("_breaks > 0")
    broken = {r["file_path"]: r["_breaks"] for r in files.collect()}
    if not broken:
        return lines
    unclosed = sorted(f for f, n in broken.items() if n % 2)
    if unclosed:
        raise ValueError(f"a quoted field is never closed in {unclosed[0]}")
    named = F.broadcast(files.select("file_path"))
    walked = running_totals(marked.join(named, "file_path", "left_semi"), ["file_path"], [F.asc("src_ord")], {"_upto": F.col("_odd")})
    begins = ((F.col("_upto") - F.col("_odd")) % 2 == 0).cast("int")
    numbered = running_totals(walked.withColumn("_begins", begins), ["file_path"], [F.asc("src_ord")], {"_record": F.col("_begins")})
    parts = F.array_sort(F.collect_list(F.struct("src_ord", "value")))
    joined = numbered.groupBy("file_path", "_record").agg(parts.alias("_p")).select(
        F.array_join(F.col("_p.value"), "\n").alias("value"), "file_path", F.get("_p", F.lit(0))["src_ord"].alias("src_ord")
    )
    return lines.join(named, "file_path", "left_anti").select("value", "file_path", "src_ord").unionByName(joined)


def without_first_lines(lines: DataFrame, n: int) -> DataFrame:
    """Leave out the first ``n`` lines of every file.

    They sit in the split that starts at offset 0, so one small aggregate per file finds them.
    It has one row per file, no more than the file listing the driver holds anyway, and is
    broadcast: the lines themselves never move.
    """
    starts = (
        lines.filter(F.col("src_ord.block") == 0)
        .groupBy("file_path")
        .agg(F.min("src_ord.row").alias("_first"))
    )
    marked = lines.join(F.broadcast(starts), "file_path", "left")
    keep = (F.col("src_ord.block") > 0) | (F.col("src_ord.row") >= F.col("_first") + n)
    return marked.filter(keep).drop("_first")


def data_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.startswith("value", F.lit("#")))


def fields(value: Column) -> Column:
    """Tab-separated fields of a line, outer whitespace removed."""
    return F.split(F.btrim(value, F.lit(" \t\r\n")), "\t")


def at(parts: Column, place: int) -> Column:
    return F.get(parts, F.lit(place))
