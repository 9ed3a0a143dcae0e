"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same number of expected copies, target / size.  Their
prefix sum runs over the documents ordered by size class and then by a seeded digest; one random
offset per source is added, and a document is emitted once for each integer boundary its step
crosses.  Size classes lie next to each other in that order, so each class gets its share and the
words taken come near the target.

A source with a third of all rows is never ordered in one task: rows are numbered inside cells of
(source, size class, leading digits of the digest), and cells get their start from counts summed
per class and per source.  More digits only make more cells, the order stays the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociq.functions.hashing import order_hash, unit_hash
from lociq.llm.common import Stages, plain, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20
#: Rows a cell should hold; more digest digits are used beyond it.
CELL_ROWS = 1_000_000


def size_class(size: Column) -> Column:
    """Number of decimal digits and the two leading ones: classes at most a tenth wide."""
    digits = size.cast("string")
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 2))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``.

    Weights repeat over the sources by code point, null last.  A target stops at ``most`` times
    its source; the excess is shared again by weight until no target is above.  Each round is one
    aggregate over the sources and brings two sums to the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", choice)
    cap = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, capped = share * total, None, -1
    while True:
        over = cap < F.col("weight") * F.lit(level) if level is not None else F.lit(False)
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("long"))
        ).first()
        if row[2] == capped or not row[1]:
            break
        capped, level = row[2], (wanted - row[0]) / row[1]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if level is not None else F.lit(0.0))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds each row's size, place in the order and cell prefix."""
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    return (
        docs.withColumns(
            {
                "_llm_size": word_count("text"),
                "_llm_order": order_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                "_llm_tie": F.xxhash64("text"),
            }
        )
        .withColumn("_llm_class", size_class(F.col("_llm_size")))
        .withColumn("_llm_group", F.concat_ws("/", "_llm_class", source))
    )


def _cell(digits: int) -> Column:
    """One key for window and join alike, so that they share a shuffle."""
    return F.concat_ws("/", F.substring("_llm_order", 1, digits), "_llm_group")


class Mix:
    """The plan of one mix: targets, and where each cell starts in its source's prefix sum.

    Size is the number of words, 0 for null texts.  Null sources are a source of their own, the
    last.  Rows that repeat an id are numbered apart by their text; rows that repeat both are
    interchangeable.  A source without words has target 0 and no copies, an empty table an empty
    mix.  The same rows give the same mix on every run.
    """

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[float] = WEIGHTS,
        share: float = SHARE,
        most: int = MOST,
        seed: int = SEED,
        cell_rows: int = CELL_ROWS,
    ):
        stages = Stages(docs.sparkSession, "mix")
        self.docs, self.seed = docs, seed
        keyed = _keyed(plain(docs, "doc_id", "source", "text"), seed).drop("text")
        self.rows = stages.keep(keyed, "rows")
        small = stages.keep(
            self.rows.groupBy("source", F.col("_llm_class").alias("class"), F.col("_llm_group").alias("group")).agg(
                F.count(F.lit(1)).alias("rows"), F.sum("_llm_size").alias("words")
            ),
            "classes",
        )
        sources = stages.keep(small.groupBy("source").agg(F.sum("words").alias("source_size")), "sources")
        targets = source_targets(sources, weights, share, most)

        most_rows = small.agg(F.max("rows")).first()[0] or 0
        self.digits = 2
        while most_rows > cell_rows * 16**self.digits:
            self.digits += 1
        cells = self.rows.groupBy(
            _cell(self.digits).alias("_llm_cell"), F.col("_llm_group").alias("group"), F.substring("_llm_order", 1, self.digits).alias("place")
        ).agg(F.count(F.lit(1)).alias("rows"))

        def before(part: str, by: str) -> Column:
            window = Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
            return F.coalesce(F.sum("rows").over(window), F.lit(0))

        offset = unit_hash(seed, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        starts = small.withColumn("class_start", before("source", "class")).join(
            targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
        )
        starts = starts.select(
            "group", "class_start", "source_size", "target", expected.alias("expected"), offset.alias("offset")
        )
        self.cells = stages.keep(
            cells.withColumn("cell_start", before("group", "place")).join(starts, "group").select(
                "_llm_cell",
                (F.col("class_start") + F.col("cell_start")).alias("_llm_start"),
                F.col("source_size").alias("_llm_source_size"),
                F.col("target").alias("_llm_target"),
                F.col("expected").alias("_llm_expected"),
                F.col("offset").alias("_llm_offset"),
            ),
            "cells",
        )
        stages.drop("classes", "sources")

    def _copies(self, rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("_llm_cell").orderBy("_llm_order", "_llm_tie")
        numbered = rows.withColumn("_llm_cell", _cell(self.digits)).withColumn("_llm_number", F.row_number().over(inside))
        placed = numbered.join(self.cells, "_llm_cell")
        number = (F.col("_llm_start") + F.col("_llm_number")).cast("double")
        crossed = F.floor(F.col("_llm_expected") * number + F.col("_llm_offset")) - F.floor(
            F.col("_llm_expected") * (number - 1) + F.col("_llm_offset")
        )
        return placed.withColumn("_llm_copies", crossed.cast("long"))

    def report(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken``, one row per document; no text is read again."""
        return self._copies(self.rows).select(
            "doc_id",
            F.col("_llm_size").alias("size"),
            F.col("_llm_source_size").alias("source_size"),
            F.col("_llm_target").alias("target"),
            (F.col("_llm_copies") * F.col("_llm_size")).alias("taken"),
        )

    def documents(self) -> DataFrame:
        """The mix itself: each document once per copy, with its own columns."""
        mixed = self._copies(_keyed(self.docs, self.seed)).where("_llm_copies > 0")
        copies = mixed.withColumn("_llm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_llm_copies"))))
        return copies.select(*[F.col(f"`{c}`") for c in self.docs.columns])
