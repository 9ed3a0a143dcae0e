"""Conversation repair, lexical search and SentencePiece round trip against plain versions."""

import random
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from brute import damage, ranked, repaired, sha
from lociq.llm import lexical, pieces, repair
from lociq.llm.queries import QUERIES, vocabulary_path

CONVERSATIONS = "conv_id long, turn long, role string, text string"
PIECES = vocabulary_path("piece_bpe_32k.model")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- 11


def report_of(given_rows):
    return sorted(((c, *repaired(t)) for c, t in damage(given_rows).items()), key=repr)


def test_repair_query_equals_trying_every_edit(spark, folder):
    given_rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(QUERIES["op11_conversation_repair"](spark, folder)) == report_of(given_rows)


def odd_conversations():
    choose = random.Random(7)
    texts = ["", " \t", "Yes.", "No", "Why? ", "Yes.", None, "é!\n", "x" * 30_000 + ".", "one\ntwo."]
    out = []
    for conv in [*range(300), None]:
        for place in range(choose.randint(1, 9)):
            turn = choose.choice([place, place, place, place * 2, None, 3, -1])
            role = choose.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None, "User", "s"])
            out.append((conv, turn, role, choose.choice(texts)))
    return out


def test_repair_of_odd_conversations(spark):
    """Nulls in any column, blank and very long texts, repeated turns and rows, clashing names."""
    given_rows = odd_conversations()
    df = spark.createDataFrame(given_rows, CONVERSATIONS).repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("kind", "nth", "gone", "fate", "conv", "edits", "back", "copy")})
    assert rows(repair.repair_report(repair.damaged(df))) == report_of(given_rows)
    assert repair.repair_report(repair.damaged(df.limit(0))).count() == 0


def test_repair_state_crosses_arrow_batches(spark):
    """A conversation far longer than a batch, and the turns it is mended to."""
    given_rows = [(1, k, ["user", "assistant"][k % 3 % 2], f"Turn {k % 50}." if k % 7 else f"turn {k}") for k in range(900)]
    given_rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(given_rows, CONVERSATIONS)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        report = rows(repair.repair_report(df.withColumn("gone", F.lit(False))))
        turns = repair.repaired_turns(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    by_conv = {c: [r[1:] for r in given_rows if r[0] == c] for c in (1, 2)}
    assert report == sorted(((c, *repaired(t)) for c, t in by_conv.items()), key=repr)
    for conv, *_, digest in report:
        mine = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.place)
        assert sha("\n".join(f"{t.role}:{t.text}" for t in mine)) == digest
        assert [t.place for t in mine] == list(range(len(mine)))
        assert "".join(t.role[0] for t in mine) in ("", "ua" * (len(mine) // 2), "s" + "ua" * (len(mine) // 2))


def test_repair_shuffles_once(spark, folder):
    df = repair.repair_report(repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInPandas") == 2


# ---- 12


ITEMS = [
    (1, "spam one two"), (2, "ONE two three"), (3, None), (4, "..."), (5, "word7 sits here"), (5, "日本語 é line"), (None, "one"),
    (7, "nothing_like_it 42x"), (8, "one two three line spam"), (9, "spam one two"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_search_equals_scoring_everything(spark, edges, block_bytes):
    from odd_documents import EDGES

    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("item", F.lit(3)).withColumn("term", F.lit("x"))
    wanted = sorted(ranked([(r[0], r[1]) for r in EDGES], ITEMS, 4), key=repr)
    assert rows(lexical.rank_documents(edges, items, k=4, block_bytes=block_bytes)) == wanted


def test_search_without_rows(spark, edges, nothing):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    for docs, asked in ((nothing, items), (edges, items.limit(0)), (nothing, items.limit(0))):
        found = lexical.rank_documents(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_search_settles_ties_across_tasks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "GATHERED", 20)
    monkeypatch.setattr(lexical, "CELLS", 40)
    docs = [(i, "same words here" if i % 3 else "same words") for i in range(400, 0, -1)]
    items = [(k, "words same" + " here" * (k % 2)) for k in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = rows(lexical.rank_documents(df, spark.createDataFrame(items, "item_id int, text string")))
    assert got == sorted(ranked(docs, items), key=repr)


def test_queries_share_partial_sums():
    """Terms of the same queries are one class; queries that begin alike share their nodes."""
    classes = [([1, 2, 3], [0, 4]), ([1, 2], [1]), ([3], [2, 5]), ([2, 3], [3])]
    tree = lexical.share(classes, 7)
    assert tree.classes[0] == tree.classes[4] and tree.classes[2] == tree.classes[5] and tree.classes[6] == tree.n_classes
    # 1 and 2 begin with two classes, all three with one: 1 + 1 + 1 (query 2) + 1 (query 3) nodes.
    assert len(tree.parents) == 1 + 4
    assert (tree.own == [4, 4, tree.classes[2]]).all()


# ---- 13


ALPHABET = ["a", "b", "the", "  ", " ", "▁", "\n", "é", "日", "😀", "\0", "\t", "<s>", "</s>", "<0x41>", "ing", "'", "‍", "   ", "1", "�", "́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.Model.read(PIECES))


def agree(coder, library, text):
    ids, begins, ends = coder.encode([text])[0]
    wanted = library.encode(text, add_eos=True)
    assert ids.tolist() == wanted
    spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
    assert list(zip(begins.tolist(), ends.tolist()))[:-1] == spans
    assert coder.decode(ids).decode() == library.decode(wanted)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(ALPHABET)).map("".join)))
def test_pieces_equal_the_library(coder, library, text):
    agree(coder, library, text)


def test_long_chunks_equal_the_library(coder, library):
    choose = random.Random(3)
    for text in ["a" * 3000, " " * 700, "ab" * 900, *["".join(choose.choices("abcdethinr", k=n)) for n in (59, 60, 61, 4000)]]:
        agree(coder, library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 259), st.integers(190, 258))))
def test_any_ids_decode_like_the_library(coder, library, ids):
    assert coder.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def char_map(entries):
    """Compiled character map of {source: replacement}: a double array of the sources' bytes."""
    texts, values = b"", {}
    for source, new in entries.items():
        values[source.encode()] = len(texts)
        texts += new.encode() + b"\0"
    units, used = {0: 0}, {0}

    def place(prefix, at):
        labels = sorted({k[len(prefix)] if len(k) > len(prefix) else 0 for k in values if k.startswith(prefix)})
        offset = next(o for o in range(1, 1 << 20) if all((at ^ o ^ x) not in used for x in labels))
        units[at] |= offset << 10 | (0 in labels) << 8
        used.update(at ^ offset ^ x for x in labels)
        for x in labels:
            child = at ^ offset ^ x
            units[child] = values[prefix] | 1 << 31 if x == 0 else x
        for x in filter(None, labels):
            place(prefix + bytes([x]), at ^ offset ^ x)

    place(b"", 0)
    size = (max(units) | 255) + 1
    array = struct.pack(f"<{size}I", *[units.get(k, 0) for k in range(size)])
    return struct.pack("<I", len(array)) + array + texts


def field_bytes(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def with_normaliser(blob, entries, dummy, fewer, fallback=True):
    """The same model with another normaliser: field 3 of the file, and byte fallback in field 2."""
    spec = field_bytes(1, b"own") + (field_bytes(2, char_map(entries)) if entries else b"") + field_bytes(3, dummy) + field_bytes(4, fewer) + field_bytes(5, 1)
    out = b""
    for number, value in pieces.fields(blob):
        if number == 2 and not fallback:
            value += field_bytes(35, 0)
        if number == 1 and not fallback and dict(pieces.fields(value)).get(3) == pieces.BYTE:
            value += field_bytes(3, pieces.CONTROL)
        out += field_bytes(number, spec if number == 3 else value)
    return out


@pytest.mark.parametrize("dummy, fewer", [(1, 0), (1, 1), (0, 1), (0, 0)])
@pytest.mark.parametrize("fallback", [True, False])
def test_longest_prefix_normalisation_keeps_source_bytes(dummy, fewer, fallback):
    """Replacements that shrink, grow, vanish and overlap, against the library on the same model."""
    entries = {"a": "b", "ab": "the ", "abc": "x", "é": "e", "日本": "  ", "\t": " ", "q": "", "😀": "smile face", "本": "ab"}
    with open(PIECES, "rb") as file:
        blob = with_normaliser(file.read(), entries, dummy, fewer, fallback)
    own, library = pieces.PieceCoder(pieces.Model.parse(blob)), sentencepiece.SentencePieceProcessor(model_proto=blob)
    choose = random.Random(5)
    alphabet = ["a", "b", "c", "ab", "abc", "é", "日", "本", "\t", "q", "😀", " ", "  ", "▁", "the", "\n", "😁", "œ"]
    for text in ["", " ", "q", "qq ", " \t ", *["".join(choose.choices(alphabet, k=choose.randint(1, 25))) for _ in range(400)]]:
        agree(own, library, text)


def test_pieces_of_odd_documents(spark, edges, nothing, library):
    from odd_documents import EDGES

    def wanted(text):
        ids = library.encode(text or "", add_eos=True)
        return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode())

    got = rows(pieces.encode_pieces(edges, PIECES))
    assert got == sorted(((r[0], *wanted(r[1])) for r in EDGES), key=repr)
    assert pieces.encode_pieces(nothing, PIECES).count() == 0
    coded = pieces.encode_pieces(edges, PIECES, with_spans=True)
    assert rows(pieces.decode_pieces(coded, PIECES)) == sorted(((r[0], r[1] or "") for r in EDGES), key=repr)
    for row in coded.collect():
        assert row.begins[0] == 0 and all(a == b for a, b in zip(row.begins[1:], row.ends))


def test_piece_query_equals_the_library(spark, some, folder, library):
    texts = dict(some[1])
    for row in QUERIES["op13_piece_round_trip"](spark, folder).collect():
        ids = library.encode(texts[row.doc_id] or "", add_eos=True)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert row.decoded_sha256 == sha(library.decode(ids)) and row.n_bytes == len((texts[row.doc_id] or "").encode())
