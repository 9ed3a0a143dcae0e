"""Ontology term search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociq.operators.joins import lookup_join
from lociq.operators.ranking import top_per_key
from lociq.session import staged

MIN_QUERY, MAX_HITS = 2, 15


def search_terms(terms: DataFrame, query: str, regex: bool = False, order: str = "src_ord") -> DataFrame:
    """First 15 terms in table order whose name contains the query, ignoring case."""
    if not query or len(query) < MIN_QUERY:
        return terms.select("HPO_ID", "Name").limit(0)
    pattern = query if regex else re.escape(query)
    hits = terms.filter(F.col("Name").rlike("(?i)" + pattern))
    return hits.orderBy(order).limit(MAX_HITS).select("HPO_ID", "Name")


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; none of a shorter text."""
    last = F.length(text) - (size - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def term_index(terms: DataFrame, order: str = "src_ord") -> DataFrame:
    """Inverted index ``gram, HPO_ID, Name, <order>`` of the terms' names, as a stage table.

    Grams are all pieces of two and three characters, in lower case.
    """
    name = F.lower("Name")
    grams = F.array_union(_grams(name, MIN_QUERY), _grams(name, MIN_QUERY + 1))
    return staged(terms.select(F.explode(grams).alias("gram"), "HPO_ID", "Name", order), "term-index")


def search_many(
    terms: DataFrame, queries: Sequence[str] | DataFrame, order: str = "src_ord", index: DataFrame | None = None
) -> DataFrame:
    """The same search for many queries: ``query, HPO_ID, Name, place``.

    ``queries`` is a list or a table with a column ``query``.  A query's two rarest grams are looked
    up in the index; terms that hold both are tested, so a query never meets terms that share
    nothing with it.  ``index`` is that of the terms where it is at hand.
    """
    index = term_index(terms, order) if index is None else index
    if not isinstance(queries, DataFrame):
        queries = terms.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    asked = queries.select("query").distinct().filter(F.length("query") >= MIN_QUERY)
    wanted = F.lower("query")
    grams = F.when(F.length(wanted) > MIN_QUERY, _grams(wanted, MIN_QUERY + 1)).otherwise(_grams(wanted, MIN_QUERY))
    pieces = asked.select("query", F.explode(grams).alias("gram"))
    sizes = lookup_join(index, pieces.select("gram").distinct(), "gram", "left_semi").groupBy("gram").count()
    sized = lookup_join(pieces, sizes, "gram")
    rarest = top_per_key(sized, ["query"], [F.asc_nulls_first("count"), F.asc("gram")], 2)
    needed = F.count(F.lit(1)).over(Window.partitionBy("query"))
    rarest = rarest.select("query", "gram", needed.alias("_needed"))
    met = lookup_join(index, rarest, "gram", "inner").groupBy("query", "HPO_ID", "Name", order, "_needed").agg(F.count_distinct("gram").alias("_met"))
    hits = met.filter((F.col("_met") == F.col("_needed")) & F.contains(F.lower("Name"), F.lower("query")))
    best = top_per_key(hits.select("HPO_ID", "Name", order, "query"), ["query"], [F.asc(order), F.asc("HPO_ID")], MAX_HITS, rank="place")
    return best.drop(order)
