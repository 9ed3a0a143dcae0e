"""Byte-pair encoding and decoding with a public byte-level vocabulary.

Texts are cut into pieces as the vocabulary's pre-tokenizer does.  Pieces not seen before by a task
are encoded together: their symbols lie in one flat array, and each round looks up all neighbouring
pairs by binary search among the sorted pair keys and merges the lowest-ranked pair of every piece.
A document's ids are then gathered from its pieces.

The vocabulary file is a parameter; the driver reads it and broadcasts its tables, whose size is
that of the file.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lociq.llm.common import plain

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pre-tokenizer of byte-level vocabularies (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a task remembers; beyond it the memory starts afresh.
REMEMBERED = 400_000
#: Pieces longer than this are encoded but not remembered.
LONG_PIECE = 200
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte (fixed values): printable Latin-1 as it
    is, the rest from U+0100 on in order."""
    plain_bytes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in set(plain_bytes))}
    return [chr(moved.get(b, b)) for b in range(256)]


@dataclass
class Vocabulary:
    """Merge tables as arrays: ``keys`` (sorted ``left * size + right``), ``ranks``, ``merged``."""

    size: int
    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    by_rank: np.ndarray
    rounds_in_bulk: bool
    token_bytes: list[bytes]
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        alphabet = byte_alphabet()
        value = {c: b for b, c in enumerate(alphabet)}
        token_bytes = [b""] * size
        for token, i in ids.items():
            token_bytes[i] = bytes(value[c] for c in token)
        for token, i in added.items():
            token_bytes[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        # A merge may be applied to every place of a piece at once if no later pair can come
        # before it: each symbol is made by a merge of lower rank than those that use it.
        made = np.full(size, -1, np.int64)
        made[merged] = np.arange(len(merges))
        bulk = bool(np.all(made[left] < np.arange(len(merges))) and np.all(made[right] < np.arange(len(merges))))
        return cls(
            size, np.array([ids[c] for c in alphabet], np.int64), keys[order], order.astype(np.int64), merged[order],
            merged, bulk, token_bytes, added,
        )

    def rank_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by binary search; ``NONE`` for pairs that never merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece begins (one more than pieces)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done_ids, done_owner = [], []
        while len(symbols):
            inner = owner[1:] == owner[:-1]
            ranks = np.full(len(symbols), NONE)
            ranks[:-1][inner] = self.rank_pairs(symbols[:-1][inner], symbols[1:][inner])
            starts = np.flatnonzero(np.r_[True, ~inner])
            counts = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(ranks, starts)
            open_pieces = lowest != NONE
            keep = np.repeat(open_pieces, counts)
            if not open_pieces.all():
                done_ids.append(symbols[~keep])
                done_owner.append(owner[~keep])
                symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
                if not len(symbols):
                    break
                counts, lowest = counts[open_pieces], lowest[open_pieces]
            hit = np.flatnonzero(ranks == np.repeat(lowest, counts))
            if self.rounds_in_bulk:
                # In a run of overlapping places (a a a) every second one merges, from the left.
                linked = np.r_[False, (hit[1:] == hit[:-1] + 1)]
                first = np.maximum.accumulate(np.where(linked, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            else:
                hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            symbols[hit] = self.by_rank[ranks[hit]]
            stays = np.ones(len(symbols), bool)
            stays[hit + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        ids = np.concatenate(done_ids) if done_ids else np.empty(0, np.int64)
        owners = np.concatenate(done_owner) if done_owner else np.empty(0, np.int64)
        order = np.argsort(owners, kind="stable")
        begins = np.searchsorted(owners[order], np.arange(len(pieces) + 1))
        return ids[order].astype(np.uint32), begins


class Encoder:
    """Encodes texts for one task and remembers the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PIECES).findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.passing: list[str] = []

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; an added token is a piece of its own."""
        if self.special is None or not any(t in text for t in self.vocabulary.added):
            return self.find(text)
        out = []
        for part in self.special.split(text):
            out += [part] if part in self.vocabulary.added else self.find(part)
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encodes the new pieces; long ones come last, as they are forgotten after this call."""
        new = sorted((p for p in pieces if p not in self.known and p not in self.vocabulary.added), key=lambda p: len(p) > LONG_PIECE)
        for token in pieces & self.vocabulary.added.keys() - self.known.keys():
            self.known[token] = len(self.ids)
            self.ids.append(np.array([self.vocabulary.added[token]], np.uint32).tobytes())
        ids, begins = self.vocabulary.encode_pieces([p.encode() for p in new])
        for k, piece in enumerate(new):
            self.known[piece] = len(self.ids)
            self.ids.append(ids[begins[k] : begins[k + 1]].tobytes())
        self.passing = [p for p in new if len(p) > LONG_PIECE]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known, self.ids = {}, []
        cut = [self.pieces(t) for t in texts]
        self._learn({p for pieces in cut for p in set(pieces)})
        at, ids = self.known, self.ids
        out = [b"".join([ids[at[p]] for p in pieces]) for pieces in cut]
        for piece in reversed(self.passing):
            del at[piece], ids[-1]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, made valid UTF-8 as the vocabulary's decoder does."""
        token_bytes = self.vocabulary.token_bytes
        raw = b"".join([token_bytes[i] for i in ids.tolist()])
        return raw.decode("utf-8", "replace").encode()


def _batches(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, vocabulary_path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` on request, per document.

    Null texts are empty and have no tokens.  Special tokens inside a text count as such, none is
    added.  Rows are independent of each other; nothing is shuffled.
    """
    tables = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(vocabulary_path)))
    slim = plain(docs, "doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**tables.value))
        for batch in batches:
            ids_col = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in _batches(texts):
                coded = encoder.encode(texts[start:end])
                ids = [np.frombuffer(c, np.uint32) for c in coded]
                columns = [
                    ids_col.slice(start, end - start),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                    pa.array([hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(encode, schema + (", ids array<bigint>" if with_ids else ""))


def decode_ids(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    tables = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(vocabulary_path)))
    slim = plain(encoded, "doc_id", "ids")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(Vocabulary(**tables.value))
        for batch in batches:
            texts = [decoder.decode(np.array(i or [], np.int64)).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return slim.mapInArrow(decode, f"doc_id {kind}, text string")
