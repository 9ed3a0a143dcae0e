"""Helpers shared by the operators: words, text hygiene, stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociq.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that no other column can clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


class Stages:
    """Stage tables of one operator run, in the folder that all executors share.

    ``drop`` deletes the tables that later steps no longer read; those behind a returned
    DataFrame have to stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame, step: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{step}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[step] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for step in steps or list(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(step))
            path.getFileSystem(conf).delete(path, True)
