"""Symptom scores and similar diseases against plain Python."""

import random

import pytest

from lociq.operators import phenotype

_ANNOTATION = "disease_id string, hpo_id string, frequency_numeric double, aspect string, is_negated boolean, src_ord int"
_GENE = "gene_symbol string, phenotype_mim_number string, disease_name string, src_ord int"


def made(spark, seed=1):
    rng = random.Random(seed)
    annotations = [
        (
            f"OMIM:{100 + rng.randrange(12)}", f"HP:{rng.randrange(15)}", rng.choice([None, 0.9, 0.0, 0.17]),
            rng.choice("PPPI"), rng.random() < 0.1, i,
        )
        for i in range(200)
    ]
    annotations += [("OMIM:900", "HP:1", 0.0, "P", False, 900)]
    genes = [(f"G{rng.randrange(8)}", rng.choice([None, str(100 + rng.randrange(14))]), f"D{i}", i) for i in range(30)]
    genes += [("G1", "900", "zero", 90), (None, "101", "nogene", 91)]
    patients = [(p, f"HP:{rng.randrange(15)}") for p in range(10) for _ in range(rng.randrange(6))]
    candidates = [(rng.randrange(11), rng.choice([None, *[f"G{i}" for i in range(9)]]), i) for i in range(80)]
    return (
        (annotations, genes, patients, candidates),
        spark.createDataFrame(annotations, _ANNOTATION),
        spark.createDataFrame(genes, _GENE),
        spark.createDataFrame(patients, "patient_id int, hpo_id string"),
        spark.createDataFrame(candidates, "patient_id int, gene_symbol string, row int"),
    )


def expected_scores(data, duplicates):
    annotations, genes, patients, candidates = data
    weights = {}
    for d, h, f, aspect, neg, _ in annotations:
        if aspect == "P" and not neg:
            w = 0.3 if f is None else f
            table = weights.setdefault(d, {})
            table[h] = w + (table.get(h, 0) if duplicates == "sum" else 0)
    symptoms = {}
    for p, h in patients:
        symptoms.setdefault(p, set()).add(h)
    out = {}
    for p, g, row in candidates:
        best, name = 0.0, None
        for sym, mim, disease, _ in genes:
            if g is None or sym != g or mim is None:
                continue
            table = weights.get(f"OMIM:{mim}", {})
            total = sum(table.values())
            score = sum(w for h, w in table.items() if h in symptoms.get(p, ())) / total if total else 0.0
            if score > best + 1e-12:
                best, name = score, disease
        out[row] = (round(best, 9), name)
    return out


def check(spark, duplicates):
    data, annotations, genes, patients, candidates = made(spark)
    weights = phenotype.disease_weights(annotations, duplicates)
    out = phenotype.with_phenotype_scores(candidates, patients, phenotype.gene_disease_ids(genes), weights)
    got = {r["row"]: (round(r.phenotype_similarity_score, 9), r.best_matching_disease) for r in out.collect()}
    assert got == expected_scores(data, duplicates)


@pytest.mark.parametrize("duplicates", ["last", "sum"])
def test_scores(spark, duplicates):
    check(spark, duplicates)


def test_scores_with_hot_keys(spark, large_mode):
    check(spark, "last")


def similar(pairs, k):
    sets = {}
    for d, h in pairs:
        sets.setdefault(d, set()).add(h)
    return sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= k)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_similar_diseases(spark, k):
    rng = random.Random(k)
    pairs = [(f"d{i}", "common") for i in range(25)] + [(f"d{i}", "usual") for i in range(0, 25, 2)]
    pairs += [(f"d{rng.randrange(25)}", f"s{rng.randrange(12)}") for _ in range(120)]
    df = spark.createDataFrame(pairs, "disease_id string, hpo_id string")
    assert sorted(map(tuple, phenotype.similar_diseases(df, df, k).collect())) == similar(pairs, k)


def test_similar_diseases_with_hot_items(spark, large_mode):
    rng = random.Random(9)
    pairs = [(f"d{rng.randrange(25)}", f"s{rng.randrange(6)}") for _ in range(200)]
    df = spark.createDataFrame(pairs, "disease_id string, hpo_id string")
    assert sorted(map(tuple, phenotype.similar_diseases(df, df, 2).collect())) == similar(pairs, 2)
