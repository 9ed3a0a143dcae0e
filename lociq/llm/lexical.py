"""Ranked lexical search: many queries at once, with what they share worked out once.

Queries come in blocks of bounded size.  For a block, every document is read once: its terms are
counted, and those the block asks for are kept as postings, a small table in the shared folder
that also gives the corpus statistics.  Terms asked for by exactly the same queries form a class.
A document's partial score of a class is one accumulator, whoever asks for it.  Queries' classes,
the most shared first, form a prefix tree over these accumulators: a node is its parent plus one
class, so queries that begin alike share the sum, and a query adds at most one class of its own.
The tree is walked once for a batch of documents, level by level.

Each task keeps the best documents of each query it has met, so what is shuffled is ``k`` rows a
query and task, and ties are settled by document as in the final ranking.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from lociq.llm.common import Stages, plain

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of query terms in a block, repeats counted: what the driver and each task hold of it.
BLOCK_BYTES = 16 << 20
#: Accumulators that a task holds at once.
CELLS = 4_000_000
#: Best rows a task gathers before it keeps only the best ``k`` of each query.
GATHERED = 500_000

#: Bytes that end a term become a blank, A-Z become small; bytes of non-ASCII characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and all other characters."""
    return (text or "").encode().translate(_FOLD).split(b" ") if text else []


def count_terms(text: str | None) -> Counter:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, item_id, term``: each query row's distinct terms."""
    kind = items.schema[item_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(count_terms(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])

    rows = plain(items, item_id, text).select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    cutted = rows.mapInArrow(cut, f"item bigint, item_id {kind}, terms array<binary>")
    return cutted.select("item", "item_id", F.explode("terms").alias("term"))


def postings(docs: DataFrame, doc_id: str, text: str, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document: its length, the numbers of the block's terms
    that it holds, and how often."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        for batch in batches:
            lengths, begins, held, times = [], [0], [], []
            for value in batch.column(1):
                counts = count_terms(value.as_py())
                lengths.append(sum(counts.values()))
                for number, times_held in zip(map(get, counts), counts.values()):
                    if number is not None:
                        held.append(number)
                        times.append(times_held)
                begins.append(len(held))
            offsets = pa.array(begins, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(held, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    slim = plain(docs, doc_id, text).select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


@dataclass
class Sharing:
    """What the queries of a block share.

    ``classes[t]`` is the class of term t.  Node k of the tree is node ``parents[k]`` plus class
    ``added[k]``; ``levels`` cut the nodes by depth, node 0 being the empty sum.  Query q is node
    ``ends[q]`` plus class ``own[q]``; the last class is always empty.
    """

    items: np.ndarray
    classes: np.ndarray
    n_classes: int
    parents: np.ndarray
    added: np.ndarray
    levels: list[int]
    ends: np.ndarray
    own: np.ndarray


def mine_shared_terms(entries: DataFrame) -> DataFrame:
    """``items, terms``: the sets of terms (numbers) asked for by the same set of queries."""
    by_term = entries.groupBy("number").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return by_term.groupBy("items").agg(F.array_sort(F.collect_list("number")).alias("terms"))


def share(classes: list[tuple[list[int], list[int]]], n_terms: int) -> Sharing:
    """Prefix tree over the queries' shared classes, the most asked for first."""
    classes = sorted(classes, key=lambda c: (-len(c[0]), c[1]))
    class_of = np.full(n_terms, len(classes), np.int64)
    shared: dict[int, list[int]] = {}
    own: dict[int, int] = {}
    for k, (items, terms) in enumerate(classes):
        class_of[terms] = k
        for item in items:
            mine = shared.setdefault(item, [])
            if len(items) > 1:
                mine.append(k)
            else:
                own[item] = k
    items = sorted(shared)
    at = dict.fromkeys(items, 0)
    parents, added, levels = [0], [len(classes)], [1]
    depth = 0
    while any(len(shared[i]) > depth for i in items):
        nodes: dict[tuple[int, int], int] = {}
        for item in items:
            if len(shared[item]) > depth:
                step = at[item], shared[item][depth]
                if step not in nodes:
                    nodes[step] = len(parents)
                    parents.append(step[0])
                    added.append(step[1])
                at[item] = nodes[step]
        levels.append(len(parents))
        depth += 1
    return Sharing(
        np.array(items, np.int64), class_of, len(classes), np.array(parents), np.array(added), levels,
        np.array([at[i] for i in items], np.int64), np.array([own.get(i, len(classes)) for i in items], np.int64),
    )


class Best:
    """The ``k`` best documents of each query so far, equal scores by ascending id, nulls last."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.least = k, np.ones(n_queries, np.int64)
        self.parts: list[tuple] = []
        self.gathered = 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """``scores`` has a row per query and a column per document."""
        query, doc = np.nonzero(scores >= self.least[:, None])
        self.parts.append((query, scores[query, doc], ids[doc], missing[doc]))
        self.gathered += len(query)
        if self.gathered > GATHERED:
            self.settle()

    def settle(self) -> tuple:
        query, score, ids, missing = (np.concatenate(p) for p in zip(*self.parts)) if self.parts else (np.empty(0, np.int64),) * 4
        order = np.lexsort((ids, missing, -score, query))
        first = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - first < self.k]
        kept = query[order], score[order], ids[order], missing[order]
        last = np.flatnonzero(np.bincount(kept[0].astype(np.int64), minlength=len(self.least)) >= self.k)
        if len(last):
            ends = np.searchsorted(kept[0], last, "right") - 1
            self.least[last] = np.maximum(1, kept[1][ends])
        self.parts, self.gathered = [kept], len(order)
        return kept


def _score_batches(found: DataFrame, sharing: Sharing, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    context = found.sparkSession.sparkContext
    shipped = context.broadcast((vars(sharing), weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weight = shipped.value
        tree = Sharing(**tree)
        best = Best(len(tree.items), k)
        width = max(1, min(1024, CELLS // (len(tree.parents) + tree.n_classes + len(tree.items) + 1)))
        for batch in batches:
            for start in range(0, batch.num_rows, width):
                part = batch.slice(start, width)
                ids = np.array(part.column(0).fill_null(0))
                missing = np.array(part.column(0).is_null().to_numpy(zero_copy_only=False))
                m = np.array([10 + 90 * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                held = part.column(2)
                doc = np.repeat(np.arange(part.num_rows), np.diff(np.array(held.offsets)))
                term = np.array(held.flatten())
                times = np.array(part.column(3).flatten(), np.int64)
                gain = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
                partial = np.zeros((tree.n_classes + 1, part.num_rows), np.int64)
                np.add.at(partial, (tree.classes[term], doc), gain)
                sums = np.zeros((len(tree.parents), part.num_rows), np.int64)
                for a, b in zip(tree.levels, tree.levels[1:]):
                    sums[a:b] = sums[tree.parents[a:b]] + partial[tree.added[a:b]]
                best.offer(sums[tree.ends] + partial[tree.own], ids, missing)
        query, scores, ids, missing = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree.items[query.astype(np.int64)], pa.int64()), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(scores, pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return found.mapInArrow(score, "item bigint, doc_id bigint, score bigint")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``items``.

    ``doc_id`` is an integer; null ids come last among equal scores, and each row is a document of
    its own even if ids repeat, as each row of ``items`` is a query of its own.  Documents and
    queries without terms, null texts among them, are ranked nowhere; so is a score of 0.  Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "search")
    asked = stages.keep(query_terms(items, item_id, text), "queries")
    size = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    ranked = []
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block) if n_blocks > 1 else asked
        # Bounded by the block's size, as are its classes and its document frequencies.
        terms = sorted(bytes(r.term) for r in mine.select("term").distinct().collect())
        found = stages.keep(postings(docs, doc_id, text, terms), f"postings{block}")
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not terms or not n_terms:
            continue
        numbers = stages.keep(
            mine.select("item", "term").join(spark.createDataFrame(list(enumerate(terms)), "number int, term binary"), "term"), f"entries{block}"
        )
        sharing = share([(r["items"], r["terms"]) for r in mine_shared_terms(numbers).collect()], len(terms))
        weights = np.zeros(len(terms), np.int64)
        for number, df in found.select(F.explode("terms").alias("number")).groupBy("number").count().collect():
            weights[number] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        ranked.append(_score_batches(found, sharing, weights, n_docs, n_terms, k))
    if not ranked:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return top.join(names, "item").select("item_id", "rank", "doc_id", "score")
