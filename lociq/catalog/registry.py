"""Query registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lociq.catalog.views import VIEWS, View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the views on them, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        view: View | None = VIEWS.get(name)
        if view is None:
            return self.table(name)
        df = self.table(view.table)
        if view.where:
            df = df.where(view.where)
        return df.selectExpr(*view.columns)


def comparable(df: DataFrame, digits: int = 9) -> DataFrame:
    """Types both engines share: long integers, rounded doubles."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, digits: int = 9):
    """Register a query; ``sql`` is its oracle, with the views it names put in front."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(build(Tables(spark, folder)), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


def with_views(sql: str) -> str:
    """Prefix the SQL with the definitions of the views it mentions."""
    from lociq.catalog.oracles import SQL_VIEWS

    wanted: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if f"@{name}@" in text and name not in wanted:
                need(body)
                wanted.append(name)

    need(sql)
    clean = lambda text: _strip_marks(text, SQL_VIEWS)
    head = ",\n".join(f"{name} AS ({clean(SQL_VIEWS[name])})" for name in wanted)
    body = clean(sql).strip()
    if not head:
        return body
    if body.lower().startswith("with "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def _strip_marks(text: str, names) -> str:
    for name in names:
        text = text.replace(f"@{name}@", name)
    return text
