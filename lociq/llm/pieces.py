"""SentencePiece encoding and decoding with source offsets.

A text is normalised by longest prefix: at each place the compiled character map (a double-array
trie) is walked byte by byte, the longest entry found is replaced, and every character written
notes the byte of the original it came from.  Pieces are then merged best score first, leftmost
first among equal scores, inside chunks that no piece of the vocabulary can cross, and each piece
is projected through the notes to the span of original bytes it stands for.  Characters without a
piece become their UTF-8 bytes; the last of them carries the character's span.

The model file is a parameter; the driver reads it and broadcasts its tables, whose size is that
of the file.  Rows are independent of each other; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lociq.llm.common import plain

# The Python steps travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: Piece types of a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks a task remembers; beyond it the memory starts afresh.
REMEMBERED = 500_000
#: Chunks up to this many characters are merged side by side and remembered, longer ones keep a heap.
SHORT = 60
NONE = np.iinfo(np.int64).max


def fields(message: bytes) -> list[tuple[int, object]]:
    """(number, value) of a protocol-buffer message: integers, bytes, or raw 4 and 8 bytes."""
    out, at = [], 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value, at

    while at < len(message):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = message[at : at + size], at + size
        out.append((key >> 3, value))
    return out


class CharMap:
    """Compiled character map: trie size, trie units, then zero-terminated replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, start: int) -> tuple[int, str]:
        """Bytes read and replacement of the longest entry at ``start``; 0 bytes if there is none."""
        if not self.units:
            return 0, ""
        read, value = 0, 0
        at = self._offset(self.units[0])
        for end in range(start, len(text)):
            byte = text[end]
            at ^= byte
            if at >= len(self.units):
                break
            unit = self.units[at]
            if unit & (1 << 31 | 0xFF) != byte:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                read, value = end + 1 - start, self.units[at] & 0x7FFFFFFF
        if not read:
            return 0, ""
        return read, self.texts[value : self.texts.index(b"\0", value)].decode()


@dataclass
class Model:
    """Tables of a model file."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    char_map: bytes = b""
    dummy_prefix: bool = True
    fewer_spaces: bool = True
    escape: bool = True
    byte_fallback: bool = False
    end_id: int = 2
    unknown_id: int = 0
    unknown_text: str = UNKNOWN_TEXT

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as file:
            return cls.parse(file.read())

    @classmethod
    def parse(cls, blob: bytes) -> Model:
        """Raises ValueError for anything but a byte-pair model whose spaces are prefixes."""
        model, kind = cls(), 1
        for number, value in fields(blob):
            if number == 1:
                piece = dict(fields(value))
                model.pieces.append(piece[1].decode())
                model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                model.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
                kind = trainer.get(3, 1)
                model.byte_fallback = bool(trainer.get(35, 0))
                model.end_id, model.unknown_id = trainer.get(42, 2), trainer.get(40, 0)
                model.unknown_text = trainer[44].decode() if 44 in trainer else UNKNOWN_TEXT
                if trainer.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif number == 3:
                spec = dict(fields(value))
                model.char_map = spec.get(2, b"")
                model.dummy_prefix, model.fewer_spaces, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or USER_DEFINED in model.types or UNUSED in model.types:
            raise ValueError("only byte-pair models without user-defined or unused pieces are supported")
        return model


class PieceCoder:
    """Encodes and decodes texts for one task and remembers the chunks it has met.

    Symbols are piece ids; a character without a piece is its code point above all ids.
    """

    def __init__(self, model: Model):
        self.model = model
        self.map = CharMap(model.char_map)
        kinds = list(enumerate(zip(model.pieces, model.types)))
        self.normal = {p: i for i, (p, t) in kinds if t == NORMAL}
        # Place in the order in which pairs merge: equal scores share a place.
        places = {s: k for k, s in enumerate(sorted({model.scores[i] for i in self.normal.values()}, reverse=True))}
        self.ranks = {p: places[model.scores[i]] for p, i in self.normal.items()}
        byte_ids = {int(p[3:5], 16): i for i, (p, t) in kinds if t == BYTE}
        self.byte_ids = np.array([byte_ids.get(b, model.unknown_id) for b in range(256)], np.int64)
        self.byte_values = np.full(len(kinds), -1)
        for byte, i in byte_ids.items():
            self.byte_values[i] = byte
        self._set_pairs()
        long = [p for p in self.normal if len(p) > 1]
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
        self.chunked = not any(regex.search(f"[^{SPACE}]{SPACE}", p) for p in long)
        if not self.chunked:
            self.chunks = lambda text: [text] if text else []
        else:
            self.chunks = regex.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        # Unknown pieces that meet at the border of two chunks are one token, hence the last term.
        self.simple = not model.char_map and not model.fewer_spaces and model.escape and model.byte_fallback
        self.known: dict[str, bytes] = {}
        self.names = [str(i) for i in range(len(kinds))]
        self.source_sizes = np.array([len(p.replace(SPACE, " ").encode()) if t == NORMAL else 0 for _, (p, t) in kinds], np.int64)
        self.decoded = [
            b"" if t == CONTROL else model.unknown_text.encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode()
            for p, t in zip(model.pieces, model.types)
        ]

    def _set_pairs(self) -> None:
        """Every pair of symbols that makes a piece, as sorted keys with rank and piece."""
        size = len(self.model.pieces)
        self.symbols = size + np.arange(0x110000)
        for piece, i in self.normal.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.n_symbols = size + 0x110000
        keys, ranks, made = [], [], []

        def symbol(part: str) -> int | None:
            return int(self.symbols[ord(part)]) if len(part) == 1 else self.normal.get(part)

        for piece, i in self.normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.n_symbols + right)
                    ranks.append(self.ranks[piece])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.key_ranks, self.key_made = np.array(ranks, np.int64)[order], np.array(made, np.int64)[order]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, ``NONE`` if it makes no piece, and its place among the keys."""
        wanted = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.key_ranks[at], NONE), at

    # ---- normalisation

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters, and its end, the byte of ``text``
        where its source begins."""
        model, raw = self.model, text.encode()
        out: list[str] = []
        source: list[int] = []
        at = 0
        while model.fewer_spaces and at < len(raw):
            new, read = self._prefix(raw, at)
            if new != " ":
                break
            at += read
        if at == len(raw):
            return "", [at]
        space = SPACE if model.escape else " "
        if model.dummy_prefix:
            out.append(space)
            source.append(at)
        after_space = model.fewer_spaces
        while at < len(raw):
            new, read = self._prefix(raw, at)
            if after_space:
                new = new.lstrip(" ")
            if new:
                out += new.replace(" ", space)
                source += [at] * len(new)
                after_space = new.endswith(" ")
            after_space &= model.fewer_spaces
            at += read
        if model.fewer_spaces:
            while out and out[-1] == space:
                out.pop()
                at = source.pop()
        return "".join(out), [*source, at]

    def _prefix(self, raw: bytes, at: int) -> tuple[str, int]:
        read, new = self.map.longest(raw, at)
        if read:
            return new, read
        first = raw[at]
        read = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return raw[at : at + read].decode(), read

    # ---- merging

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all chunks in one array, and where each chunk begins (one more than chunks).

        Each round merges the best-scored pair of every chunk, the leftmost of equal ones.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.symbols[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        owner = np.repeat(np.arange(len(chunks)), lengths)
        ranks = np.full(len(symbols), NONE)
        place = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(self.keys):
            ranks[inner], place[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest != NONE
            if not going.all():
                keep = np.repeat(going, counts)
                done_symbols.append(symbols[~keep])
                done_owner.append(owner[~keep])
                symbols, owner, ranks, place = symbols[keep], owner[keep], ranks[keep], place[keep]
                counts, lowest = counts[going], lowest[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(lowest, counts))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            symbols[hit] = self.key_made[place[hit]]
            stays = np.ones(len(symbols), bool)
            stays[hit + 1] = False
            hit = hit - np.arange(len(hit))
            symbols, owner, ranks, place = symbols[stays], owner[stays], ranks[stays], place[stays]
            for left in (hit, hit[hit > 0] - 1):
                ranks[left] = NONE
                left = left[left + 1 < len(symbols)]
                left = left[owner[left] == owner[left + 1]]
                ranks[left], place[left] = self._pairs(symbols[left], symbols[left + 1])
        owners = np.concatenate([np.empty(0, np.int64), *done_owner])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([np.empty(0, np.int64), *done_symbols])[order], np.searchsorted(owners[order], np.arange(len(chunks) + 1))

    def merge_long(self, chunk: str) -> np.ndarray:
        """Symbols of one chunk of any length."""
        ranks = self.ranks
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(left: int, right: int) -> None:
            if 0 <= left and right < n:
                both = symbols[left] + symbols[right]
                if both in ranks:
                    heapq.heappush(heap, (ranks[both], left, right, len(both)))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != size:
                continue
            symbols[left], symbols[right] = a + b, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return np.array([self.symbols[ord(s)] if len(s) == 1 else self.normal[s] for s in symbols if s is not None], np.int64)

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters without a piece as their bytes, and how many each gave."""
        point = symbols - len(self.model.pieces)
        width = np.where(point >= 0, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
        ids = np.repeat(symbols, width)
        at = np.flatnonzero(np.repeat(point >= 0, width))
        if len(at):
            nth = (np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width))[at]
            point, wide = np.repeat(point, width)[at], np.repeat(width, width)[at]
            part = point >> 6 * (wide - 1 - nth)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide]
            ids[at] = self.byte_ids[np.where(nth > 0, 0x80 | part & 0x3F, lead | part)]
        return ids, width

    def _learn(self, new: list[str]) -> None:
        symbols, begins = self.merge(new)
        ids, width = self._ids(symbols)
        flat = ids.astype(np.uint32).tobytes()
        cuts = (4 * np.r_[0, np.cumsum(width)][begins]).tolist()
        self.known.update(zip(new, [flat[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _cut(self, text: str) -> list[str] | None:
        """Chunks of a text; None if its characters need notes of their own."""
        if not text or not self.simple or SPACE in text:
            return None
        if not self.model.dummy_prefix or text[0] == " " or "  " in text or not self.chunked:
            return self.chunks((SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE))
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``ids, begins, ends`` of each text; an end id closes it.

        Token k stands for the bytes ``begins[k]`` to ``ends[k]`` of the text as given.
        """
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, end = self.known, struct.pack("<I", self.model.end_id)
        front = self.model.dummy_prefix
        cut = [self._cut(t) for t in texts]
        new = set().union(*[c for c in cut if c]) - known.keys()
        self._learn([c for c in new if len(c) <= SHORT])
        long = [c for c in new if len(c) > SHORT]
        for chunk in long:
            known[chunk] = self._ids(self.merge_long(chunk))[0].astype(np.uint32).tobytes()
        out = []
        for text, chunks in zip(texts, cut):
            if chunks is None:
                out.append(self._encode_noted(text))
                continue
            ids = np.frombuffer(b"".join(map(known.__getitem__, chunks)) + end, np.uint32)
            sizes = self.source_sizes[ids]
            at = np.flatnonzero(self.byte_values[ids] >= 0)
            if len(at):
                # The last byte of a character carries the whole of it.
                value = self.byte_values[ids[at]]
                first = (value < 0x80) | (value >= 0xC0)
                width = 1 + (value >= 0xC0) + (value >= 0xE0) + (value >= 0xF0)
                sizes[at[first] + width[first] - 1] = width[first]
            ends = np.cumsum(sizes)
            begins = ends - sizes
            if front:
                # The space in front has no source.
                ends -= 1
                begins[1:] -= 1
            out.append((ids, begins, ends))
        for chunk in long:
            del known[chunk]
        return out

    def _encode_noted(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encoding by the notes that normalisation leaves for every character."""
        normal, source = self.normalise(text)
        size, fallback = len(self.model.pieces), self.model.byte_fallback
        ids, widths, gap = [], [], False
        for chunk in self.chunks(normal):
            for symbol in self.merge_long(chunk).tolist():
                if symbol < size:
                    ids.append(symbol)
                    widths.append(len(self.model.pieces[symbol]))
                elif fallback:
                    raw = [int(self.byte_ids[b]) for b in chr(symbol - size).encode()]
                    ids += raw
                    widths += [0] * (len(raw) - 1) + [1]
                elif gap:
                    widths[-1] += 1
                else:
                    ids.append(self.model.unknown_id)
                    widths.append(1)
                gap = symbol >= size and not fallback
        at = np.cumsum([0, *widths, 0])
        notes = np.array(source, np.int64)
        return np.array([*ids, self.model.end_id], np.uint32), notes[at[:-1]], notes[at[1:]]

    # ---- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the tokens in UTF-8: the space in front goes, each byte that is part of no
        character becomes U+FFFD."""
        decoded, listed = self.decoded, ids.tolist()
        model = self.model
        parts = [decoded[i] for i in listed]
        if model.dummy_prefix or model.fewer_spaces:
            written = False
            for k, i in enumerate(listed):
                if model.types[i] == BYTE:
                    written = True
                    continue
                if written:
                    break
                if model.types[i] == NORMAL and parts[k].startswith(b" "):
                    parts[k] = parts[k][1:]
                    written = not model.fewer_spaces
                written = written or bool(parts[k])
        raw = b"".join(parts)
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self._mend(listed, parts)

    def _mend(self, ids: list[int], parts: list[bytes]) -> bytes:
        out, run = [], b""
        for i, part in [*zip(ids, parts), (None, b"")]:
            if i is not None and self.model.types[i] == BYTE:
                run += part
                continue
            while run:
                size = next((n for n in (1, 2, 3, 4) if _is_character(run[:n], n)), 0)
                out.append(run[:size] if size else b"\xef\xbf\xbd")
                run = run[size or 1 :]
            out.append(part)
        return b"".join(out)


def _is_character(raw: bytes, size: int) -> bool:
    try:
        return len(raw) == size and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def in_groups(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, k
            start = k
            size = 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_pieces(docs: DataFrame, model_path: str, with_spans: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes`` per document, and on request
    ``ids, begins, ends``: the bytes of the text that each token stands for.

    ``n_bytes`` counts the source bytes covered by the spans, which is the whole text.  A null or
    empty text is the end id alone.
    """
    tables = docs.sparkSession.sparkContext.broadcast(vars(Model.read(model_path)))
    slim = plain(docs, "doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(Model(**tables.value))
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in in_groups(texts):
                for ids, begins, ends in coder.encode(texts[start:end]):
                    listed = " ".join([coder.names[i] for i in ids.tolist()])
                    row = [len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest(), int((ends - begins).sum())]
                    rows.append(row + [ids.astype(np.int64), begins, ends] if with_spans else row)
            columns = list(zip(*rows)) or [()] * (7 if with_spans else 4)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", *(["ids", "begins", "ends"] if with_spans else [])]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint"
    return slim.mapInArrow(encode, schema + (", ids array<bigint>, begins array<bigint>, ends array<bigint>" if with_spans else ""))


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    tables = encoded.sparkSession.sparkContext.broadcast(vars(Model.read(model_path)))
    slim = plain(encoded, "doc_id", "ids")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(Model(**tables.value))
        for batch in batches:
            texts = [coder.decode(np.array(i or [], np.int64)).decode() for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return slim.mapInArrow(decode, f"doc_id {kind}, text string")
