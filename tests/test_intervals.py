"""Interval joins against naive search."""

import random

import pytest

from lociq.operators.intervals import gene_at, gene_overlaps

_CHROMOSOMES = ["1", "2", "X"]


def made(spark, seed, n_deletions=250, n_genes=150):
    rng = random.Random(seed)

    def span():
        start = rng.randrange(1, 3_000_000)
        size = rng.choice([0, 0, 50, 5_000, 16_383, 16_384, 300_000, 5_000_000, 90_000_000])
        return start, start + (rng.randrange(size) if size else 0)

    deletions = [(f"d{i}", rng.choice(_CHROMOSOMES + ["9"]), *span(), 10, 0.5) for i in range(n_deletions)]
    deletions += [("touch", "1", 100, 200, 100, 0.1), ("back", "1", 5_000, 4_000, 1_000, None), ("touch", "1", 100, 200, 100, 0.1)]
    genes = [(rng.choice(_CHROMOSOMES), *span(), f"G{i % 90}", f"b{i % 3}", i) for i in range(n_genes)]
    genes += [("1", 200, 900, "EDGE", "b", 1000), ("1", 50, 100, "EDGE2", "b", 1001), ("1", 3_500, 6_000, "IN", "b", 1002)]
    d = spark.createDataFrame(
        deletions, "variant_id string, chromosome string, start_position long, end_position long, deletion_size long, allele_frequency double"
    )
    g = spark.createDataFrame(
        genes, "chromosome string, start_position long, end_position long, gene_symbol string, gene_biotype string, src_ord long"
    )
    return deletions, genes, d, g


def naive(deletions, genes):
    out = []
    for v, c, s, e, *_ in deletions:
        for gc, gs, ge, sym, *_ in genes:
            if gc == c and gs <= e and ge >= s:
                out.append((v, s, e, sym, gs, ge, min(e, ge) - max(s, gs)))
    return sorted(out)


def check_inner(spark, seed):
    deletions, genes, d, g = made(spark, seed)
    found = gene_overlaps(d, g).select(
        "variant_id", "deletion_start", "deletion_end", "gene_symbol", "gene_start_position", "gene_end_position", "overlap_length"
    )
    assert sorted(map(tuple, found.collect())) == naive(deletions, genes)


@pytest.mark.parametrize("seed", [1, 2])
def test_inner_overlap(spark, seed):
    check_inner(spark, seed)


def test_inner_overlap_with_hot_bins(spark, large_mode):
    check_inner(spark, 3)


def check_left(spark, seed):
    deletions, genes, d, g = made(spark, seed)
    hits = naive(deletions, genes)
    per_interval = {}
    for v, c, s, e, *_ in deletions:
        key = (c, s, e)
        per_interval[key] = sum(1 for gc, gs, ge, *_ in genes if gc == c and gs <= e and ge >= s)
    expected = sum(max(1, per_interval[(c, s, e)]) for _, c, s, e, *_ in deletions)
    out = gene_overlaps(d, g, "left")
    assert out.count() == expected
    assert out.filter("gene_symbol is null and overlap_length = 0 and overlap_fraction_of_gene is null").count() == sum(
        1 for _, c, s, e, *_ in deletions if per_interval[(c, s, e)] == 0
    )
    assert out.filter("gene_symbol is not null").count() == len(hits)


def test_left_overlap(spark):
    check_left(spark, 4)


def test_left_overlap_with_hot_intervals(spark, large_mode):
    check_left(spark, 5)


def test_touching_intervals_count_with_length_zero(spark):
    _, _, d, g = made(spark, 6)
    out = gene_overlaps(d.filter("variant_id = 'touch'"), g.filter("gene_symbol in ('EDGE', 'EDGE2')"))
    assert sorted((r.gene_symbol, r.overlap_length) for r in out.collect()) == [("EDGE", 0)] * 2 + [("EDGE2", 0)] * 2


def test_first_gene_at_position(spark):
    deletions, genes, d, g = made(spark, 7)
    points = d.selectExpr("chromosome", "start_position as position")
    expected = {}
    for _, c, s, *_ in deletions:
        inside = [(o, sym) for gc, gs, ge, sym, _, o in genes if gc == c and gs <= s <= ge]
        if inside:
            expected[(c, s)] = min(inside)[1]
    assert {(r.chromosome, r.position): r.gene_symbol for r in gene_at(points, g).collect()} == expected
