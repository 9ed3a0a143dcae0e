"""Trees, contributions and reports."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators import explain, model


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    data = []
    for i in range(400):
        a, b, c = rng.random(), rng.choice([None, rng.random()]), rng.choice(["x", "y", "z", None])
        y = int(a + (0.4 if c == "x" else 0) + (0.3 if b is None else 0) + rng.random() * 0.3 > 0.9)
        data.append((i % 40, f"v{i}", f"G{i % 9}", a, b, c, y))
    return spark.createDataFrame(
        data, "patient_id int, variant_id string, gene_symbol string, a double, b double, c string, is_causal int"
    ).cache()


@pytest.fixture(scope="module")
def fitted(labelled):
    return model.train(labelled, ["a", "b", "c"], ["c"], rounds=4, depth=3)


def test_scores_separate_classes_and_survive_saving(spark, labelled, fitted, tmp_path_factory):
    scored = fitted.score(labelled)
    means = {r.is_causal: r.m for r in scored.groupBy("is_causal").agg(F.avg("relevance_score").alias("m")).collect()}
    assert means[1] > means[0] + 0.1
    path = str(tmp_path_factory.mktemp("m") / "model")
    fitted.save(path)
    loaded = model.RankingModel.load(path)
    assert loaded.features == ["a", "b", "c"]
    both = loaded.score(scored, "again")
    assert both.filter("abs(again - relevance_score) > 1e-12").isEmpty()


def test_unseen_and_missing_categories(spark, fitted):
    df = spark.createDataFrame([(0.5, None, "new"), (0.5, float("nan"), None)], "a double, b double, c string")
    scores = [r.relevance_score for r in fitted.score(df).collect()]
    assert scores[0] == scores[1] and 0 < scores[0] < 1


def test_contributions_add_up_to_the_log_odds(spark, labelled, fitted):
    ids = ["variant_id"]
    total = explain.contributions(fitted, labelled, ids).groupBy("variant_id").agg(F.sum("contribution").alias("s"))
    base = explain.base_value(fitted, labelled)
    checked = fitted.score(labelled).join(total, "variant_id").collect()
    for row in checked:
        assert base + row.s == pytest.approx(math.log(row.relevance_score / (1 - row.relevance_score)), abs=1e-9)


def test_contributions_are_shapley_values(spark, labelled, fitted):
    """Against the definition: all orders of features, conditional expectation along the paths."""
    splits, leaves = explain._read_forest(fitted, labelled)
    x = np.array([r.features.toArray() for r in fitted.assemble(labelled.limit(6)).select("features").collect()])

    def value(row, known):
        left = [bool(s.goes_left(row[None, :])[0]) for s in splits]
        out = 0.0
        for leaf in leaves:
            # Value of the leaf for every known set follows from its full and empty outcomes.
            weight = 1.0
            for feature, conditions, share in zip(leaf.features, leaf.conditions, shares[id(leaf)]):
                weight *= float(all(left[p] == w for p, w in conditions)) if feature in known else share
            out += values[id(leaf)] * weight
        return out

    # Recover each leaf's value and shares from its node path.
    forest = spark.read.parquet(_saved(fitted)).collect()
    trees = {}
    for r in forest:
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    paths = []
    for t, w in zip(sorted(trees), fitted.trees.treeWeights):
        nodes = trees[t]

        def walk(i, acc, nodes=nodes, w=w):
            n = nodes[i]
            if n.leftChild < 0:
                paths.append((2 * w * n.prediction, acc))
                return
            for child in (n.leftChild, n.rightChild):
                share = dict(acc)
                f = n.split.featureIndex
                share[f] = share.get(f, 1.0) * nodes[child].rawCount / n.rawCount
                walk(child, share)

        walk(0, {})
    values = {id(l): v for l, (v, _) in zip(leaves, paths)}
    shares = {id(l): [s[f] for f in l.features] for l, (_, s) in zip(leaves, paths)}
    got = explain._attribute(x, splits, leaves)
    n = x.shape[1]
    for i, row in enumerate(x):
        expected = np.zeros(n)
        for perm in itertools.permutations(range(n)):
            known = set()
            for f in perm:
                before = value(row, known)
                known = known | {f}
                expected[f] += (value(row, known) - before) / math.factorial(n)
        assert got[i] == pytest.approx(expected, abs=1e-9)


def _saved(fitted):
    from pyspark.sql import SparkSession

    from lociq.session import scratch_path

    path = scratch_path(SparkSession.getActiveSession(), "forest")
    fitted.trees.save(path)
    return f"{path}/data"


def test_evidence(spark):
    long = spark.createDataFrame(
        [("r", f"f{i}", v) for i, v in enumerate([0.5, -0.25, 0.0, 0.75, 0.1, 0.2, 0.3, 0.4, -0.5])],
        "row string, feature string, contribution double",
    )
    top = explain.top_evidence(long, ["row"], 5)
    assert top.filter("direction = 'supporting'").count() == 5
    text = explain.evidence_text(top, ["row"]).first()
    assert text.top_supporting == "f3=0.750; f0=0.500; f7=0.400; f6=0.300; f5=0.200"
    assert text.top_opposing == "f8=-0.500; f1=-0.250"


def test_rank_candidates(spark):
    df = spark.createDataFrame(
        [(1, "b", "G", 0.5), (1, "a", "G", 0.5), (1, "c", "G", 0.9), (2, "d", None, 0.1)],
        "patient_id int, variant_id string, gene_symbol string, relevance_score double",
    )
    got = {r.variant_id: r["rank"] for r in model.rank_candidates(df).collect()}
    assert got == {"c": 1, "a": 2, "b": 3, "d": 1}
