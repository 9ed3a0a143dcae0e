"""Connected components of a graph of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociq.llm.common import Stages


def _place(node: Column, number: int) -> Column:
    """Place of a node in the order of round ``number``."""
    return F.struct(F.xxhash64(node, F.lit(number)).alias("place"), node.alias("node"))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component is its smallest node.

    Each round contracts the graph: a node moves to the neighbour (or itself) that is first in the
    round's random order, and on to where that one moves.  Links between the places reached are
    the next round's graph, so rounds get smaller and a chain of any order shrinks by a constant
    factor.  The moves of all rounds are put together at the end.  A node with very many links is one
    row on the side of the moves, so AQE can split its links.
    """
    stages = Stages(links.sparkSession, "components")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stages.keep(both, "links0")
    moves = []
    while not moves or not both.isEmpty():
        number = len(moves)
        first = both.groupBy("a").agg(F.min(_place(F.col("b"), number)).alias("other"))
        step = first.select(F.col("a").alias("node"), F.least("other", _place(F.col("a"), number))["node"].alias("via"))
        step = stages.keep(step, f"step{number}")
        further = step.select(F.col("node").alias("via"), F.col("via").alias("at"))
        moved = stages.keep(step.join(further, "via").select("node", "at"), f"moved{number}")
        left = both.join(moved.select(F.col("node").alias("a"), F.col("at").alias("x")), "a")
        left = left.join(moved.select(F.col("node").alias("b"), F.col("at").alias("y")), "b")
        left = left.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        both = stages.keep(left, f"links{number + 1}")
        stages.drop(f"links{number}", f"step{number}")
        moves.append(moved)
    # A place that the next round does not move is where its nodes stay.
    ends = moves.pop()
    while moves:
        last = ends.select(F.col("node").alias("at"), F.col("at").alias("end"))
        ends = moves.pop().join(last, "at", "left").select("node", F.coalesce("end", "at").alias("at"))
        ends = stages.keep(ends, f"ends{len(moves)}")
    ends = stages.keep(ends.join(ends.groupBy("at").agg(F.min("node").alias("component")), "at").select("node", "component"), "ends")
    stages.drop(*(set(stages.paths) - {"ends"}))
    return ends
