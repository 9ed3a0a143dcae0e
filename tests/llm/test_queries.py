"""Registered queries against their SQL, and the pipeline against a plain version."""

import collections

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from brute import base_statistics, near_groups, sha
from lociq.llm.queries import ORACLES, QUERIES, vocabulary_path
from test_operators import blank

TABLES = "documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, engine, folder, name):
    got = QUERIES[name](spark, folder)
    cursor = engine.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    wanted = sorted(tuple(str(r[columns.index(c)]) for c in got.columns) for r in cursor.fetchall())
    assert sorted(tuple(map(str, r)) for r in got.collect()) == wanted


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_its_columns_and_rows(spark, folder, name):
    wanted = {
        "op1": ("pages", "page_id host path rule verdict"),
        "op2": ("pages", "page_id url text n_chars"),
        "op3": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
        "op4": ("documents", "doc_id n_bytes n_removed n_spans kept_sha256"),
        "op5": ("documents", "doc_id keep_id group_size kept text_sha256"),
        "op6": ("documents", "doc_id n_assign n_access n_hex base_sha256 spans"),
        "op7": ("documents", "doc_id size source_size target taken"),
        "op8": (None, "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
        "op9": ("documents", "doc_id n_shingles component_id"),
        "op10": ("documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
        "op11": (None, "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"),
        "op12": (None, "item_id rank doc_id score"),
        "op13": ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    }[name.split("_")[0]]
    df = QUERIES[name](spark, folder)
    columns = wanted[1].split()
    assert df.columns[: len(columns)] == columns
    if wanted[0]:
        assert df.count() == spark.read.parquet(f"{folder}/{wanted[0]}.parquet").count()
    assert name in entry_points.queries()


def test_pipeline_equals_a_plain_one(spark, folder):
    """Quality verdicts and mix are the operators' own; everything that follows from them is plain."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = {r.doc_id: r.text for r in docs.collect()}
    verdicts = {r.doc_id: r.kept for r in QUERIES["op10_quality_rules"](spark, folder).collect()}
    assert all(not verdicts[d] for d, t in pairs.items() if base_statistics(t)[0] < 50)
    good = sorted(d for d, k in verdicts.items() if k)
    first = {}
    for d in good:
        first.setdefault(blank(pairs[d]), d)
    exact = sorted(first.values())
    near = sorted({c for _, _, c in near_groups([(d, pairs[d]) for d in exact])})
    left = docs.where(docs.doc_id.isin(near))
    from lociq.llm.mixing import Mix

    copies = {r.doc_id: r.taken // r.size for r in Mix(left).report().collect() if r.size}
    tokenizer = Tokenizer.from_file(vocabulary_path())
    wanted = collections.Counter()
    for d in near:
        ids = tokenizer.encode(pairs[d] or "", add_special_tokens=False).ids
        wanted[d, len(ids), sha(np.array(ids, np.uint32).tobytes()), sha(pairs[d] or "")] += copies.get(d, 0)
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == +wanted
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near duplicates", "source mix", "tokens"]
