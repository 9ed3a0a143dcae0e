"""Exact dedup with an extendible-hash index kept as shared files.

Every distinct text has a 64-bit hash.  A directory over the hash's leading bits names a bucket;
a bucket with more distinct hashes than ``capacity`` is split by its next bit, and a split below
the directory's depth doubles the directory.  Rows are grouped by bucket, hash and text: the task
that owns a bucket's key range compares the bytes of equal hashes, says which id of a group stays,
and numbers the texts that share a hash as a chain.

Copies are folded in the map tasks before anything is shuffled, so a text that makes up a third of
all rows reaches its owner as one row from each map task.  Text moves once; the join of the rows
with the index moves hashes only, and its hot keys have a single row on the index side, which AQE
splits.  Where whole documents are asked for (:func:`keep_first_copies`), they are what moves to
the owners, cut to one row of each text and map task, and nothing is joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from lociq.llm.common import SPACES, Stages, plain, whole
from lociq.operators.joins import lookup_join
from lociq.operators.ranking import first_per_key

#: Distinct hashes a bucket holds before it is split.
CAPACITY = 1_000_000


def normalised(text) -> F.Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(whole(text), SPACES, " ")


def _slot(depth: int) -> F.Column:
    """Directory slot: the hash's leading ``depth`` bits."""
    return F.shiftrightunsigned("h", 64 - depth)


def build_directory(hashes: DataFrame, capacity: int, stages: Stages) -> tuple[DataFrame, int]:
    """Directory ``(slot, bucket, local_depth)`` over distinct hashes ``h``, and its depth.

    Starts with a slot for each ``capacity`` hashes, two at least, and splits overfull buckets until none is
    left; at 64 bits hashes are equal, which makes a chain, not a bucket to split.
    """
    total = hashes.count()
    depth = max(1, math.ceil(math.log2(total / capacity))) if total else 1
    pending, parts, first = hashes, [], depth
    while True:
        sizes = stages.keep(pending.groupBy(_slot(depth).alias("prefix")).count(), f"depth{depth}")
        fits = F.col("count") <= capacity if depth < 64 else F.lit(True)
        parts.append(sizes.where(fits).select("prefix", F.lit(depth).alias("local_depth")))
        overfull = sizes.where(~fits)
        if overfull.isEmpty():
            break
        pending = pending.withColumn("prefix", _slot(depth)).join(overfull.select("prefix"), "prefix", "left_semi").select("h")
        depth += 1
    buckets = parts[0]
    for part in parts[1:]:
        buckets = buckets.unionByName(part)
    # A bucket above the last depth owns several neighbouring slots.
    span = F.expr(f"shiftleft(cast(1 as bigint), {depth} - local_depth)")
    low = F.expr(f"shiftleft(prefix, {depth} - local_depth)")
    slots = buckets.select(
        F.explode(F.sequence(low, low + span - 1)).alias("slot"), low.alias("bucket"), "local_depth"
    )
    slots = stages.keep(slots, "directory")
    stages.drop(*[f"depth{d}" for d in range(first, depth + 1)])
    return slots, depth


def in_buckets(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """``rows`` with hash ``h`` and the bucket that the directory names for it."""
    return lookup_join(rows.withColumn("slot", _slot(depth)), directory.select("slot", "bucket"), "slot", "inner").drop("slot")


def build_index(docs: DataFrame, directory: DataFrame, depth: int, stages: Stages, id_col: str = "id", text: str = "text") -> DataFrame:
    """``(bucket, h, chain, sha, group_size, keep_id)``: one entry for each distinct text.

    Grouping by bucket, hash and text compares bytes; the texts stay in the grouping, the index
    keeps their digest.
    """
    t = plain(docs, id_col, text).select(F.col(f"`{id_col}`").alias("id"), normalised(text).alias("t"))
    owned = in_buckets(t.withColumn("h", F.xxhash64("t")), directory, depth).groupBy("bucket", "h", "t")
    entries = owned.agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("keep_id"))
    entries = entries.select("bucket", "h", F.sha2("t", 256).alias("sha"), "group_size", "keep_id")
    chain = Window.partitionBy("bucket", "h").orderBy("sha")
    return stages.keep(entries.withColumn("chain", F.row_number().over(chain)), "index")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal after :func:`normalised`.  The smallest id of a group stays; null ids come
    last, and of rows that repeat an id one stays.  Null and empty texts form one group.  An
    empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession, "exact")
    rows = plain(docs, id_col, text).select(F.col(f"`{id_col}`").alias("id"), normalised(text).alias("t"))
    keys = stages.keep(
        rows.select("id", F.xxhash64("t").alias("h"), F.sha2("t", 256).alias("sha"), F.monotonically_increasing_id().alias("row")),
        "keys",
    )
    hashes = stages.keep(keys.select("h").distinct(), "hashes")
    directory, depth = build_directory(hashes, capacity, stages)
    index = build_index(docs, directory, depth, stages, id_col, text)
    stages.drop("hashes", "directory")
    # Of rows that repeat the id that stays, the first stays.
    first = keys.groupBy("h", "sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    groups = index.join(first, ["h", "sha"])
    return keys.join(groups, ["h", "sha"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.equal_null("id", "keep_id") & (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
    )


def keep_first_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and a text, one.

    The rows move once, to the owners of their buckets: each map task sends one row of a text, and
    the owner, comparing bytes, keeps the one with the smallest id.
    """
    stages = Stages(docs.sparkSession, "exact")
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = normalised("text")
    hashes = stages.keep(docs.select(F.xxhash64(key).alias("h")).distinct(), "hashes")
    directory, depth = build_directory(hashes, capacity, stages)
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), key.alias("t"))
    owned = in_buckets(rows.withColumn("h", F.xxhash64("t")), directory, depth)
    first = first_per_key(owned, ["bucket", "h", "t"], [F.asc_nulls_last("id")])
    return first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
