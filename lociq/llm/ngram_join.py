"""N-gram Jaccard join by prefix trees.

A document is the set of its word n-grams in one global order, rare ones first.  Two sets with
Jaccard J or more share many items of their first :func:`prefix_share` percent, so only those prefixes are
shuffled, and a set goes on only if it shares as many prefix items with others as J demands of any
pair.  Sets that are left are stored in prefix trees that others walk: overlaps counted along a
shared path are counted once, and a subtree is left as soon as what remains cannot reach the bound.

Links matter only as components, so a group is never paired with itself.  Rounds of sorted
neighbours come first: sets that share an item are sorted by a min-hash, and neighbours of
different components are tested.  Then every component that is the largest of some items becomes a
home, whose trees hold its sets and those of smaller components around it.  A set that is not of
the home's own component walks the trees of each home with which it shares enough items, and looks
for one link to each other component.  The rounds only save work, the last step misses no link.

The order comes from bounded statistics of all documents: word frequencies, and a list of n-grams
that very many documents have, which go last.  Equal sets are one node.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from lociq.llm.common import Stages, plain
from lociq.llm.components import components
from lociq.llm.packed import Substrings, heavy_hitters, mixed, packed, runs

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

N, PERCENT = 4, 85
#: Percent of a set that is shuffled beyond the least that J needs; makes the count of shared items
#: telling.
SPARE = 5
#: An item with sets of so many components is worth another round of neighbours; most rounds.
CROWD, ROUNDS = 12, 2
#: Neighbours each set is tested against in a round.
NEIGHBOURS = 3
#: An n-gram that at least so many documents have goes last in the order (more on large inputs).
FREQUENT = 32
#: A word is listed with its frequency from this share on; others count as just below.
WORD_SHARE = 1 / (1 << 17)
#: Bytes of text handled at once, and items counted together before rare ones are dropped.
CHUNK, COUNTED = 4_000_000, 4_000_000
#: Sets a tree holds; a node with more candidates walks several trees.
TREE = 500
#: Words of 64 bits in the bitmap that thins out documents before they are shuffled (2 MB).
FILTER_WORDS = 1 << 18
#: Rows of a frequent item that one task looks through.
ITEM_ROWS = 2_000

HASH_BITS = 58
LAST = 1 << 62


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; ``data`` is lower-cased in place."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def shingles(words: np.ndarray, docs: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each n-gram, its first word's place, its document, and whether it has ``n`` words.

    A document with fewer than ``n`` words has one n-gram, all its words.
    """
    counts = np.bincount(docs, minlength=n_docs)
    first = np.cumsum(counts) - counts
    step = np.uint64(0xD6E8FEB86659FD93)
    full = np.flatnonzero(docs[: max(0, len(words) - n + 1)] == docs[n - 1 :]) if len(words) >= n else np.empty(0, np.int64)
    h = np.zeros(len(full), np.uint64)
    for k in range(n):
        h = h * step + words[full + k]
    short = np.flatnonzero((counts > 0) & (counts < n))
    x = counts[short].astype(np.uint64)
    for k in range(n - 1):
        more = counts[short] > k
        x[more] = x[more] * step + words[first[short[more]] + k]
    at, doc = np.concatenate([full, first[short]]), np.concatenate([docs[full], short])
    whole = np.arange(len(at)) < len(full)
    order = np.argsort(doc, kind="stable")
    return (mixed(np.concatenate([h, x])) >> np.uint64(64 - HASH_BITS))[order], at[order], doc[order], whole[order]


def _chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes; a longer text is a range of its own."""
    _, offsets = packed(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1)
        yield start, min(end, len(column))
        start = min(end, len(column))


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = packed(column)
    data = data.copy()
    starts, ends, docs = word_places(data, offsets)
    return Substrings(data).hashes(starts, ends), docs


class Order:
    """The global order of n-grams: items are 62-bit numbers whose size is their place.

    Highest bit: on the list of frequent n-grams, by count.  Then how common an n-gram of these
    words would be by chance, in steps of 16 times, then its hash.
    """

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, words: np.ndarray, shares: np.ndarray):
        self.frequent = frequent
        self.place = np.empty(len(frequent), np.int64)
        self.place[np.lexsort((frequent, counts))] = np.arange(len(frequent))
        # Quarter bits, whole numbers: an n-gram's class is the same wherever it stands.
        self.words, self.bits = words, np.round(4 * np.log2(np.maximum(shares, WORD_SHARE) / WORD_SHARE)).astype(np.int64)

    def items(self, words: np.ndarray, grams: np.ndarray, at: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
        """Items of n-grams from :func:`shingles`; those of fewer than ``n`` words are in the first class."""
        known = _lookup(self.words, words.view(np.int64) >> 1)
        bits = np.zeros(len(words) + 1, np.int64)
        bits[1:][known >= 0] = self.bits[known[known >= 0]]
        sums = np.cumsum(bits)
        level = np.zeros(len(grams), np.int64)
        level[full] = np.minimum((sums[at[full] + n] - sums[at[full]]) // 16, 15)
        items = (level << HASH_BITS) | grams.astype(np.int64)
        listed = _lookup(self.frequent, grams.astype(np.int64))
        items[listed >= 0] = LAST + self.place[listed[listed >= 0]]
        return items


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def item_sets(column: pa.Array, order: Order, n: int) -> Iterator[np.ndarray]:
    """Ascending distinct items of each text."""
    words, docs = _words_of(column)
    grams, at, owner, full = shingles(words, docs, len(column), n)
    items = order.items(words, grams, at, full, n)
    bounds = np.searchsorted(owner, np.arange(len(column) + 1))
    for k in range(len(column)):
        yield np.unique(items[bounds[k] : bounds[k + 1]])


def set_node(items: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    total = mixed(items.astype(np.uint64)).sum(dtype=np.uint64)
    return int(mixed(np.array([total, len(items)], np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_share(percent: int) -> int:
    return min(99, 100 - percent + SPARE)


def prefix_length(n: int, percent: int) -> int:
    return n * prefix_share(percent) // 100 + 1


# ---- the order's statistics


def global_order(docs: DataFrame, n: int, stages: Stages) -> dict[str, np.ndarray]:
    """What :class:`Order` is made of: word shares and frequent n-grams over all documents.

    Rare ones are dropped inside tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"word": [], "gram": []}

        def rows(kind: str) -> Iterator[pa.RecordBatch]:
            if not held[kind]:
                return
            every = np.concatenate(held[kind])
            held[kind] = []
            keys, counts = np.unique(every, return_counts=True)
            keep = counts >= (max(2, len(every) * WORD_SHARE) if kind == "word" else 2)
            keys, counts = np.append(keys[keep], -1), np.append(counts[keep], len(every))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["kind", "key", "n"])

        size = 0
        for batch in batches:
            for start, end in _chunks(batch.column(0)):
                words, owner = _words_of(batch.column(0).slice(start, end - start))
                grams, _, doc, _ = shingles(words, owner, end - start, n)
                held["word"].append(words.view(np.int64) >> 1)
                held["gram"].append(_once(doc, grams))
                size += len(words)
                if size > COUNTED:
                    yield from rows("word")
                    yield from rows("gram")
                    size = 0
        yield from rows("word")
        yield from rows("gram")

    counted = stages.keep(
        docs.select("text").mapInArrow(count, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counted"
    )
    grams, n_grams, _ = heavy_hitters(counted.where("kind = 'gram'").drop("kind"), FREQUENT)
    words, n_words, total = heavy_hitters(counted.where("kind = 'word'").drop("kind"), 2)
    listed = n_words >= max(2, total * WORD_SHARE)
    stages.drop("counted")
    return {"frequent": grams, "counts": n_grams, "words": words[listed], "shares": n_words[listed] / max(1, total)}


def _once(doc: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Each document's n-grams once: a line repeated in one text does not make it frequent."""
    order = np.lexsort((grams, doc))
    d, g = doc[order], grams[order]
    new = np.ones(len(g), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return g[new].astype(np.int64)


# ---- prefixes and candidates


def _rest(n: str, percent: int) -> Column:
    return F.expr(f"{n} - {n} * {prefix_share(percent)} div 100 - 1")


def _need(percent: int) -> Column:
    """Prefix items two sets must share: their least overlap, less what lies past the prefixes."""
    overlap = F.expr(f"({percent} * (nx + ny) + {percent + 99}) div {percent + 100}")
    return F.greatest(F.lit(1), overlap - F.greatest(_rest("nx", percent), _rest("ny", percent)))


def _busy(held: DataFrame, percent: int) -> DataFrame:
    """Rows of nodes that share enough items with others, for items that two such nodes have.

    The least count over all partner sizes is that of the smallest partner.
    """
    least = F.expr(f"greatest(1, ({percent + prefix_share(percent) - 100} * n + 99) div 100)")
    nodes = held.groupBy("node", "n").count().where(F.col("count") >= least).select("node")
    left = held.join(nodes, "node", "left_semi")
    shared = left.groupBy("item").count().where("count > 1").select("item")
    return left.join(shared, "item", "left_semi")


def sorted_leaves(leaves: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, np.ndarray]]:
    """Sets ``(node, component, items)`` as leaves of a prefix tree, from left to right."""
    return sorted(leaves, key=lambda leaf: leaf[2].astype(">i8").tobytes())


def tree_links(x: np.ndarray, component: int, leaves: list[tuple[int, int, np.ndarray]], percent: int) -> list[int]:
    """Leaves with Jaccard ``percent`` or more to ``x``: one of each component but its own.

    Two neighbouring leaves share the path of their common prefix, whose overlaps with ``x`` are
    not counted again.
    """
    least = least_overlap(len(x), percent)
    known, found = {component}, []
    before = np.empty(0, np.int64)
    path = np.zeros(1, np.int64)  # overlap of the path's first k items with x
    dead = None  # depth from which the last path cannot reach the bound
    for node, other, items in leaves:
        if other in known or 100 * min(len(x), len(items)) < percent * max(len(x), len(items)):
            continue
        m = min(len(before), len(items))
        differ = np.flatnonzero(before[:m] != items[:m])
        shared = int(differ[0]) if len(differ) else m
        if dead is not None and shared >= dead:
            continue
        rest = items[shared:]
        at = np.searchsorted(x, rest)
        hit = x[np.minimum(at, len(x) - 1)] == rest
        path = np.concatenate([path[: shared + 1], path[shared] + np.cumsum(hit)])
        before = items
        # What x still has after each item of the path bounds what any leaf below can gain.
        left = len(x) - np.searchsorted(x, items, "right")
        hopeless = np.flatnonzero(path[1:] + left < least)
        dead = int(hopeless[0]) + 1 if len(hopeless) else None
        overlap = int(path[-1])
        if 100 * overlap >= percent * (len(x) + len(items) - overlap):
            found.append(node)
            known.add(other)
    return found


def narrowed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose ``row`` may be one of ``wanted``: all that are, and some others.

    Works before any shuffle by a broadcast bitmap of at most ``FILTER_WORDS`` rows whatever the
    input, under one bit of each row; with very many rows wanted it just keeps more.
    """
    word, bit = F.expr(f"pmod(shiftright(row, 6), {FILTER_WORDS})"), "cast(pmod(row, 64) AS int)"
    bits = wanted.groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    found = docs.withColumn("word", word).join(F.broadcast(bits), "word")
    return found.where(F.expr(f"shiftright(bits, {bit}) & 1L = 1L")).select("row", "text")


def full_sets(nodes: DataFrame, sets: DataFrame, docs: DataFrame, order, n: int, stages: Stages) -> DataFrame:
    """``(node, items)``: the whole sets of ``nodes``, from one document each."""
    firsts = sets.where("node is not null").groupBy("node").agg(F.min("row").alias("row"))
    firsts = stages.keep(nodes.join(firsts, "node"), "firsts")
    # Repeated rows go within their task, the others before the join on the same key.
    texts = narrowed(docs, firsts).dropDuplicates(["row"]).join(firsts, "row").select("text", "node")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Order(**order.value)
        for batch in batches:
            for start, end in _chunks(batch.column(0)):
                part = batch.slice(start, end - start)
                found = [i.tobytes() if set_node(i) == v else None for v, i in zip(part.column(1).to_pylist(), item_sets(part.column(0), own, n))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.binary())], names=["node", "items"])

    return texts.mapInArrow(build, "node long, items binary").where("items is not null")


def tree_join(places: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between the sets that walk a tree and its leaves.

    ``places`` has ``node, component, tree, walks``.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "tree"):
            trees = table.column("tree").to_numpy()
            bounds = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1], True])
            links = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                group = table.slice(a, b - a)
                rows = zip(*[group.column(c).to_pylist() for c in ("walks", "node", "component", "items")])
                rows = [(w, v, c, np.frombuffer(i, np.int64)) for w, v, c, i in rows]
                leaves = sorted_leaves([(v, c, i) for w, v, c, i in rows if not w])
                for w, v, c, i in rows:
                    if w:
                        links += [(found, v) for found in tree_links(i, c, leaves, percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in links], pa.int64()), pa.array([p for _, p in links], pa.int64())], names=["a", "b"]
            )

    placed = places.join(whole, "node").select("tree", "walks", "node", "component", "items")
    return placed.repartition("tree").sortWithinPartitions("tree", "walks").mapInArrow(walk, "a long, b long")


def _pair_trees(pairs: DataFrame) -> DataFrame:
    """Places for pairs ``(x, y)``: ``y`` walks trees of at most about ``TREE`` of its ``x``."""
    slices = F.ceil(F.col("members") / TREE).cast("long")
    placed = pairs.select("x", "y").join(pairs.groupBy("y").agg(F.count(F.lit(1)).alias("members")), "y")
    placed = placed.select("x", "y", F.xxhash64("y", F.pmod(F.xxhash64("x"), slices)).alias("tree"))
    places = placed.select(F.col("x").alias("node"), "tree", F.lit(False).alias("walks")).unionByName(
        placed.select(F.col("y").alias("node"), "tree", F.lit(True).alias("walks")).distinct()
    )
    return places.withColumn("component", F.col("node"))


def _home_trees(mine: DataFrame, parts: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """Places that bring every pair of different components that may link into one tree.

    Such a pair shares enough items with each other, and so with each other's homes.
    """
    apart = stages.keep(mine.join(parts.select("item", "main"), "item"), "apart")
    homes = apart.groupBy("node", "main").count().groupBy("node").agg(F.max_by("main", F.struct("count", "main")).alias("home"))
    nodes = stages.keep(apart.select("node", "n", "component").distinct().join(homes, "node"), "nodes")
    sizes = stages.keep(nodes.groupBy("home").agg(F.count(F.lit(1)).alias("size")), "homes")
    at_home = apart.select("item", "node", "component").join(nodes.select("node", "home"), "node")
    there = at_home.groupBy("item", "home").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    # A set has to walk where an item is shared with another component.
    met = apart.select("item", "node", "n", "component").join(there, "item").where(
        (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
    )
    least = F.expr(f"greatest(1, ({percent + prefix_share(percent) - 100} * n + 99) div 100)")
    walkers = met.groupBy("node", "n", "component", "home").count().where(F.col("count") >= least)
    own = nodes.select("node", F.col("home").alias("own")).join(sizes.select(F.col("home").alias("own"), F.col("size").alias("own_size")), "own")
    walkers = walkers.join(own, "node").join(sizes, "home")
    # At home the sets of the home's component stand still; between homes the smaller one walks.
    walkers = walkers.where(
        F.when(F.col("own") == F.col("home"), F.col("component") != F.col("home")).otherwise(
            F.struct("own_size", "own") < F.struct("size", "home")
        )
    )
    slices = F.ceil(F.col("size") / TREE).cast("long")
    tree = lambda number: F.xxhash64("home", number)
    walkers = walkers.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    walkers = stages.keep(walkers.select("node", "component", tree(F.col("slice")).alias("tree"), F.lit(True).alias("walks")), "walkers")
    leaves = nodes.join(sizes, "home").select(
        "node", "component", tree(F.pmod(F.xxhash64("node"), slices)).alias("tree"), F.lit(False).alias("walks")
    )
    return walkers.unionByName(leaves.join(walkers.select("tree").distinct(), "tree", "left_semi").select(*walkers.columns))


def _neighbours(mine: DataFrame, groups: int, number: int, percent: int) -> DataFrame:
    """Likely pairs ``(x, y)`` of different components, next to each other among an item's nodes.

    Nodes are sorted by the smallest hash of their items, which near duplicates often share.  The
    first round takes only pairs that are neighbours as often as they need items; in a crowd, where
    others stand between them, later rounds take each node's most frequent neighbours.
    """
    signs = [F.min(F.xxhash64("item", F.lit(number * NEIGHBOURS + k))).alias(f"sign{k}") for k in range(NEIGHBOURS)]
    signed = mine.join(mine.groupBy("node").agg(*signs), "node")
    signed = signed.withColumn("slice", F.when(F.col("item") >= LAST, F.pmod(F.xxhash64("sign0"), F.lit(groups))).otherwise(0))
    here = Window.partitionBy("item", "slice")
    near = {f"near{k}": F.lag(F.struct("node", "n", "component")).over(here.orderBy(f"sign{k}", "node")) for k in range(NEIGHBOURS)}
    found = signed.withColumns(near).select("node", "n", "component", F.explode(F.array(*near)).alias("near"))
    found = found.where("near.component != component")
    found = found.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("near.node").alias("y"), F.col("near.n").alias("ny"))
    found = found.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).groupBy("x", "nx", "y", "ny").count()
    found = found.where(F.col("count") >= _need(percent)) if number == 0 else found
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.col("count").desc(), "y"))
    return found.withColumn("best", best).where(F.col("best") <= NEIGHBOURS).select("x", "y")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, row``, one row per document.

    Words are lower-cased (A-Z) runs of anything but ASCII white space.  A document with fewer than
    ``n`` words is one n-gram, one without words (or with a null text) links with nothing.
    Components join links; the id is the smallest ``doc_id`` of the component, null only where all
    its ids are.  Rows that repeat an id stand for themselves.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "ngrams")
    # Ids may repeat or be null; a row is known by its id and text.
    rows = plain(docs, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    statistics = global_order(rows, n, stages)
    order = spark.sparkContext.broadcast(statistics)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        own = Order(**order.value)
        for batch in batches:
            for start, end in _chunks(batch.column(2)):
                part = batch.slice(start, end - start)
                sizes, nodes, items = [], [], []
                for found in item_sets(part.column(2), own, n):
                    sizes.append(len(found))
                    node = set_node(found) if len(found) else None
                    nodes.append(node)
                    # Copies within a task bring their prefix once.
                    new = node is not None and node not in seen
                    items.append(found[: prefix_length(len(found), percent)] if new else None)
                    if new:
                        seen.add(node)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(items, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n", "node", "items"],
                )

    sets = stages.keep(rows.mapInArrow(prefixes, f"doc_id {kind}, row long, n long, node long, items array<long>"), "sets")

    # One row per node and prefix item; a frequent item is dealt out over several groups.
    groups = max(1, int(statistics["counts"].max(initial=0)) // ITEM_ROWS)
    held = sets.where("items is not null").select("node", "n", F.explode("items").alias("item"))
    held = held.withColumn("slice", F.when(F.col("item") >= LAST, F.pmod(F.xxhash64("node"), F.lit(groups))).otherwise(0))
    together, ordered = Window.partitionBy("item", "slice"), Window.partitionBy("item", "slice").orderBy("node")
    held = held.select(
        "*",
        (F.lag("node").over(ordered) == F.col("node")).alias("again"),
        (F.min("node").over(together) != F.max("node").over(together)).alias("met"),
    )
    held = held.where((F.col("met") | (F.col("item") >= LAST)) & ~F.coalesce("again", F.lit(False))).select("item", "node", "n")
    held = stages.keep(held, "held")
    busy = stages.keep(_busy(held, percent), "busy")
    stages.drop("held")
    whole = stages.keep(full_sets(busy.select("node").distinct(), sets, rows, order, n, stages), "whole")

    links, labels = None, busy.select("node", F.col("node").alias("component")).limit(0)
    for number in range(ROUNDS + 1):
        mine = busy.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mine = stages.keep(mine, f"mine{number}")
        parts = mine.groupBy("item", "component").count().groupBy("item").agg(
            F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("parts")
        )
        parts = stages.keep(parts.where("parts > 1"), f"parts{number}")
        if number == ROUNDS or (number and parts.where(F.col("parts") >= CROWD).isEmpty()):
            break
        some = mine if number == 0 else mine.join(parts.where(F.col("parts") >= CROWD).select("item"), "item", "left_semi")
        pairs = stages.keep(_neighbours(some, groups, number, percent), f"pairs{number}")
        found = stages.keep(tree_join(_pair_trees(pairs), whole, percent), f"links{number}")
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = stages.keep(components(links), f"labels{number}")
        stages.drop(f"mine{number}", f"parts{number}", f"pairs{number}")

    # What is left: nodes that share items across components.
    places = _home_trees(mine, parts, percent, stages)
    found = stages.keep(tree_join(places, whole, percent), "links_late")
    links = found if links is None else links.unionByName(found)
    labels = stages.keep(components(links), "labels_late")
    # Only these two are read again.
    stages.drop(*(set(stages.paths) - {"sets", "labels_late"}))

    firsts = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = firsts.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("first").alias("id"))
    known = named.join(ids, "component").select("node", "id")
    return sets.join(known, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("doc_id")).alias("component_id"), "row"
    )


def keep_one_per_group(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id; documents without words stay.

    Of rows that repeat an id and a text, one stays; rows that share the smallest id of their
    component but differ in text all stay if nothing else tells them apart.
    """
    found = near_duplicates(docs, n, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias("_llm_row"))
    marked = docs.withColumn("_llm_row", F.xxhash64("doc_id", "text"))
    kept = marked.join(found, "_llm_row", "left_semi").dropDuplicates(["_llm_row"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
