"""Texts of a batch as one byte array, and hashes of its substrings."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Odd, so that its powers can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Entries of a list of heavy hitters: the driver and every executor hold it.
MOST_HEAVY = 1_000_000


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more than texts); nulls are empty."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("").cast(pa.large_string())
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Substrings:
    """Hashes of any substrings of a byte array, from one prefix sum.

    The hash of ``[start, end)`` is a polynomial in ``BASE``, whatever the place.
    """

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Substrings._powers) < n:
            size = 1 << (n - 1).bit_length()
            Substrings._powers = _power_table(BASE, size)
            Substrings._inverse = _power_table(pow(BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Substrings._powers[: n - 1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * Substrings._inverse[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` bytes at every place that has them."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:n]) * Substrings._inverse[:n])


def _power_table(base: int, size: int) -> np.ndarray:
    out = np.full(size, base & MASK, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def heavy_hitters(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys counted at least ``least`` times and at least once in a millionth of all, with counts.

    ``counts`` has ``key, n``; the row with key -1 holds the total.  At most ``MOST_HEAVY`` keys
    can have such a share, which bounds what is collected.
    """
    total = counts.where("key = -1").agg(F.sum("n")).first()[0] or 0
    least = max(least, -(-total // MOST_HEAVY))
    rows = counts.where("key != -1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    keys, n = (rows.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys, kind="stable")
    return keys[order], n[order], total


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; a table has one group or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        # Rows of the last key may go on in the next batch.
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and (last or held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]):
            first = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            if not last or first != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
