"""Removal of repeated byte strings, by column-wise construction over many documents.

A string of ``length`` bytes is judged where it starts.  Every window of that length has an anchor,
the smallest of its ``GRAM``-byte hashes, so equal windows have equal anchors at equal places;
windows in a row with one anchor form a segment.  Only segments whose anchor occurs twice go on.
Equal segments repeat in full.  Different segments of one anchor are laid under each other and
read column by column from the right: each round puts one symbol before every segment, which
re-sorts the collection (the symbols in that order are its Burrows-Wheeler column) and updates the
common prefix of neighbours; a window repeats if that prefix reaches ``length`` on either side.

The rounds run over segments as they come from Spark's sorted shuffle files, read once and in
order.  Copies within a task are folded before the shuffle.  An anchor with very many different
segments (text around a passage that many documents share) is split into single windows, each
under its own hash, so no group grows with the input.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from lociq.llm.common import Stages, plain
from lociq.llm.packed import Substrings, heavy_hitters, packed, runs

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
GRAM = 24
#: Bytes of text handled at once; a longer text is cut into overlapping pieces.
CHUNK = 1 << 20
#: Segments of a task that are compared before the shuffle.
HELD = 300_000
#: An anchor with so many segments is split into windows (more on large inputs).
CROWDED = 4096
#: Segments sorted together.
COLUMNWISE = 8192
POSITION_BITS = 24

REP, FULL, COPY = 0, 1, 2


def place_of(start: np.ndarray, size: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a segment starts, how many windows it has and where its anchor is, in one number."""
    return (start << 20) | (size << 10) | off


#: The same three numbers, read back in SQL.
START, SIZE, OFF = "cast(shiftright(place, 20) as int)", "cast(shiftright(place, 10) & 1023 as int)", "cast(place & 1023 as int)"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(text, start, count, anchor offset, anchor hash, segment hash)`` of all texts.

    ``start`` is relative to the text, ``count`` the number of windows.
    """
    substrings = Substrings(data)
    grams = substrings.grams(GRAM)
    low = np.uint64((1 << POSITION_BITS) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchors = (sliding_min(keyed, length - GRAM + 1) & low).astype(np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    begins = np.cumsum(windows) - windows
    place = np.arange(len(text)) - np.repeat(begins, windows) + offsets[text]
    anchor = anchors[place]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(text) else np.empty(0, np.int64)
    count = np.diff(np.r_[new, len(text)])
    start, text, anchor = place[new], text[new], anchor[new]
    whole = substrings.hashes(start, start + count + (length - 1)) if len(start) else np.empty(0, np.uint64)
    return text, start - offsets[text], count, anchor - start, grams[anchor], whole


def single_windows(data: np.ndarray, offsets: np.ndarray, found: tuple[np.ndarray, ...], crowded: np.ndarray, length: int):
    """Replaces segments of crowded anchors by their windows, each its own segment under its own key."""
    text, start, count, off, anchor, whole = found
    if not len(crowded) or not len(text):
        return found
    keys = (anchor >> np.uint64(1)).astype(np.int64)
    at = np.minimum(np.searchsorted(crowded, keys), len(crowded) - 1)
    split = crowded[at] == keys
    if not split.any():
        return found
    copies = count[split]
    inner = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    t, s = np.repeat(text[split], copies), np.repeat(start[split], copies) + inner
    absolute = s + offsets[t]
    own = Substrings(data).hashes(absolute, absolute + length)
    ones = np.ones(len(t), count.dtype)
    parts = (t, s, ones, np.zeros(len(t), off.dtype), own, own)
    return tuple(np.concatenate([x[~split], y]) for x, y in zip(found, parts))


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(first text, bytes, offsets, place)``: ranges of texts, or a piece of one long text.

    Pieces overlap by ``length - 1`` bytes, so each window is in exactly one.
    """
    data, offsets = packed(column)
    k = 0
    while k < len(column):
        size = offsets[k + 1] - offsets[k]
        if size > CHUNK:
            for place in range(0, int(size) - length + 1, CHUNK):
                part = data[offsets[k] + place : min(offsets[k] + place + CHUNK + length - 1, offsets[k + 1])]
                yield k, part, np.array([0, len(part)]), place
            k += 1
            continue
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
        end = min(end, len(column))
        yield k, data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], 0
        k = end


# ---- which windows of different segments repeat


def repeated_windows(parts: list[bytes], offs: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """``[segment, window]``: whether the window starts the same ``length`` bytes as another segment's.

    Segments are aligned at their anchors.  Going left, a round prepends one symbol to each segment
    that has one there: the stable order by that symbol is the new suffix order, and a pair of
    neighbours with the same symbol has one more than the smallest common prefix between them.
    """
    m = len(parts)
    most = int(offs.max(initial=0))
    width = most + max((len(p) - o for p, o in zip(parts, offs)), default=0)
    symbols = np.full((width, m), 256, np.uint16)
    for k, part in enumerate(parts):
        shift = most - int(offs[k])
        symbols[shift : shift + len(part), k] = np.frombuffer(part, np.uint8)
    out = np.zeros((m, int(counts.max(initial=0))), bool)
    order = np.arange(m)
    prefix = np.zeros(m, np.int16)  # with the neighbour before
    for column in range(width - 1, -1, -1):
        symbol = symbols[column][order]  # the collection's Burrows-Wheeler column
        moved = np.argsort(symbol, kind="stable")
        ordered = symbol[moved]
        same = np.r_[False, (ordered[1:] == ordered[:-1]) & (ordered[1:] < 256)]
        at = np.flatnonzero(same)
        updated = np.zeros(m, np.int16)
        if len(at):
            updated[at] = _range_min(prefix, moved[at - 1] + 1, moved[at] + 1) + 1
        order, prefix = order[moved], updated
        if width - column >= length:
            long = prefix >= length
            if long.any():
                hit = long.copy()
                hit[:-1] |= long[1:]
                rows = order[hit]
                window = column - (most - offs[rows])
                fits = (window >= 0) & (window < counts[rows])
                out[rows[fits], window[fits]] = True
    return out


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``x[low:high]`` for each pair, from a table of power-of-two spans."""
    span = high - low
    level = np.frexp(span)[1] - 1
    out = np.empty(len(low), x.dtype)
    table, k = x, 0
    top = int(level.max())
    while True:
        now = level == k
        if now.any():
            out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k)])
        if k == top:
            return out
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, row, start, size)``: starts of repeated windows in runs of ``size``.

    ``docs`` has ``doc_id, row, text``; null texts are empty.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "suffix")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors that come up several times in a task, each segment once."""
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                pairs = _distinct(held)
                keys, counts = np.unique(pairs[0], return_counts=True)
                keep = counts >= 4
                keys, counts = np.append(keys[keep], -1), np.append(counts[keep], pairs.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])
                held.clear()

        for batch in batches:
            for _, data, offsets, _ in _pieces(batch.column(0), length):
                _, _, _, _, anchor, whole = segments(data, offsets, length)
                held.append(np.stack([(anchor >> np.uint64(1)).astype(np.int64), whole.view(np.int64)]))
                if sum(h.shape[1] for h in held) > HELD:
                    yield from flush()
        yield from flush()

    counted = stages.keep(docs.select("text").mapInArrow(crowds, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "crowds")
    crowded, _, _ = heavy_hitters(counted, CROWDED)
    stages.drop("crowds")
    crowded = spark.sparkContext.broadcast(crowded)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments; of those that a task has several times, one stands for the copies."""
        names = ["doc_id", "row", "key", "seg", "place", "state"]
        held: list[tuple[pa.Array, pa.Array, tuple[np.ndarray, ...]]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            seg = np.concatenate([h[2][5] for h in held]).view(np.int64)
            _, first, inverse, counts = np.unique(seg, return_index=True, return_inverse=True, return_counts=True)
            state = np.full(len(seg), COPY, np.int8)
            state[first] = np.where(counts > 1, FULL, REP)
            key = np.concatenate([h[2][4] for h in held]) >> np.uint64(1)
            columns = [
                pa.concat_arrays([h[0] for h in held]),
                pa.concat_arrays([h[1] for h in held]),
                pa.array(key.astype(np.int64)),
                pa.array(seg),
                pa.array(place_of(*[np.concatenate([h[2][i] for h in held]).astype(np.int64) for i in (1, 2, 3)])),
                pa.array(state),
            ]
            held.clear()
            batch = pa.RecordBatch.from_arrays(columns, names=names)
            for k in range(0, batch.num_rows, 50_000):
                yield batch.slice(k, 50_000)

        for batch in batches:
            for k, data, offsets, place in _pieces(batch.column(2), length):
                found = single_windows(data, offsets, segments(data, offsets, length), crowded.value, length)
                if len(found[0]):
                    where = pa.array(found[0] + k)
                    held.append((batch.column(0).take(where), batch.column(1).take(where), (found[0], found[1] + place, *found[2:])))
                if sum(len(h[0]) for h in held) > HELD:
                    yield from flush()
        yield from flush()

    cuts = docs.select("doc_id", "row", "text").mapInArrow(
        cut, f"doc_id {kind}, row long, key long, seg long, place long, state byte"
    )
    cuts = stages.keep(cuts, "cuts")

    # Anchors with two segments or more; how often each segment occurs.
    by_key, by_seg = Window.partitionBy("key"), Window.partitionBy("key", "seg").orderBy("doc_id", "row", "place")
    whole_seg = Window.partitionBy("key", "seg")
    met = cuts.where(F.col("state") != COPY).select(
        "*",
        (F.min("seg").over(by_key) != F.max("seg").over(by_key)).alias("mixed"),
        F.row_number().over(by_seg).alias("nth"),
        (F.count(F.lit(1)).over(whole_seg) + F.max("state").over(whole_seg) > 1).alias("full"),
    )
    met = stages.keep(met.where(F.col("mixed") | F.col("full")).drop("state"), "met")
    start, size, off = F.expr(START).alias("start"), F.expr(SIZE).alias("size"), F.expr(OFF).alias("off")
    span = ["doc_id", "row", start, size]
    done = met.where("full").select(*span).unionByName(cuts.where(F.col("state") == COPY).select(*span))

    # Different segments of one anchor, one row each, with their bytes.  Single windows need none.
    open_keys = met.where("mixed and not full").select("key").distinct()
    unlike = met.where("mixed and nth = 1").join(open_keys, "key", "left_semi")
    wanted = unlike.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", start, size, off, "full")).alias("parts"))
    wanted = wanted.withColumnRenamed("doc_id", "_id")
    texts = docs.join(wanted, (docs["row"] == wanted["row"]) & docs["doc_id"].eqNullSafe(wanted["_id"])).select(
        docs["doc_id"], docs["row"], "text", "parts"
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(2))
            lists = batch.column(3)
            flat = lists.flatten()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), sizes)
            start, size = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "size"))
            begin = offsets[owner] + start
            body = [data[a:b].tobytes() for a, b in zip(begin, begin + size + (length - 1))]
            where = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(1).take(where), *[flat.field(f) for f in ("key", "start", "size", "off", "full")], pa.array(body, pa.binary())],
                names=["doc_id", "row", "key", "start", "size", "off", "full", "bytes"],
            )

    def columnwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def sort_held() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            size, off = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "off"))
            repeats = repeated_windows(table.column("bytes").to_pylist(), off, size, length)
            repeats[table.column("full").to_numpy(zero_copy_only=False)] = False
            edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            where = pa.array(row)
            start = table.column("start").to_numpy()[row] + begin
            ids = [table.column(c).combine_chunks().take(where) for c in ("doc_id", "row")]
            ids = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start, pa.int32()), pa.array(end - begin, pa.int32())], names=["doc_id", "row", "start", "size"])

        for table in runs(batches, "key"):
            held.append(table)
            if sum(t.num_rows for t in held) >= COLUMNWISE:
                yield from sort_held()
        if held:
            yield from sort_held()

    fetched = texts.mapInArrow(fetch, f"doc_id {kind}, row long, key long, start int, size int, off int, full boolean, bytes binary")
    part = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(columnwise, f"doc_id {kind}, row long, start int, size int")
    return done.unionByName(part)


def _distinct(held: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(held, axis=1)
    order = np.lexsort((pairs[1], pairs[0]))
    pairs = pairs[:, order]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, new]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and the ``kept`` bytes on request.

    Bytes covered by a ``length``-byte string that also starts elsewhere, in the same document or
    another, go.  Null texts are empty; texts shorter than ``length`` stay whole.  Rows that repeat
    an id and a text are judged alike, as copies of each other.  An empty table gives an empty
    result.
    """
    rows = plain(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("row"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(rows, length).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans = spans.withColumnRenamed("doc_id", "_id")
    joined = rows.join(spans, (rows["row"] == spans["row"]) & rows["doc_id"].eqNullSafe(spans["_id"]), "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            lists = batch.column(2)
            out = []
            for k in range(batch.num_rows):
                body = data[offsets[k] : offsets[k + 1]]
                if not lists[k].is_valid:
                    kept = body.tobytes()
                    out.append((len(body), 0, 0, kept))
                    continue
                found = lists[k].values
                start, size = (found.field(f).to_numpy().astype(np.int64) for f in ("start", "size"))
                edge = np.zeros(len(body) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size + (length - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
                out.append((len(body), int(gone.sum()), n_spans, body[~gone].tobytes()))
            columns = [
                batch.column(0),
                *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)],
                pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([o[3] for o in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(remove, schema + (", kept binary" if with_text else ""))
