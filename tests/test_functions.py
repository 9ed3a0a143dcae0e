"""Literal cases for the column functions."""

import pytest
from pyspark.sql import functions as F

from lociq.functions import clinical, text, variants


def values(spark, inputs, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.select(build(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_info_value_last_wins_and_flags(spark):
    raw = ["A=1=2;FLAG;B=x;A=3", "XA=9", "FLAG", "A=", None, "A=1"]
    assert values(spark, raw, lambda c: text.info_value(c, "A")) == ["3", None, None, "", None, "1"]
    assert values(spark, raw[:2], lambda c: text.info_map(c)) == [{"A": "3", "B": "x"}, {"XA": "9"}]
    assert values(spark, raw[:1], lambda c: text.info_map(c)["B"]) == ["x"]


def test_attribute_value(spark):
    raw = ['gene_id "E1"; gene_version "5"; gene_name "D 1"; ', 'gene_id "E2"; ', "gene_name plain"]
    assert values(spark, raw, lambda c: text.attribute_value(c, "gene_name")) == ["D 1", None, "plain"]


@pytest.mark.parametrize(
    ("raw", "simple"),
    [
        ("Pathogenic", "Pathogenic"),
        ("Pathogenic/Likely_pathogenic", "Pathogenic"),
        ("Likely_pathogenic|risk_factor", "Likely_pathogenic"),
        ("Benign/Likely_benign", "Benign"),
        ("Likely_benign", "Likely_benign"),
        ("Conflicting_classifications_of_pathogenicity", "Conflicting"),
        ("Uncertain_significance", "Uncertain_significance"),
        ("drug_response", "Other"),
        (None, None),
    ],
)
def test_simplify_significance(spark, raw, simple):
    assert values(spark, [raw], clinical.simplify_significance) == [simple]


def test_parse_frequency(spark):
    raw = ["HP:0040281", " HP:0040284 ", "3/12", "3/0", "12%", "a/b", "1/2/3", "nan/2", None, ""]
    assert values(spark, raw, clinical.parse_frequency) == [0.9, 0.025, 0.25, None, None, None, None, None, None, None]


def test_negation(spark):
    assert values(spark, ["NOT", " not ", "", None, "NOTE"], clinical.is_negated) == [True, True, False, False, False]


def test_dosage_score(spark):
    raw = [
        "Sufficient Evidence for Haploinsufficiency",
        "Little Evidence for Haploinsufficiency",
        "Gene Associated with Autosomal Recessive Phenotype",
        "Sufficient Evidence for Triplosensitivity",
        "Not yet evaluated",
        None,
    ]
    assert values(spark, raw, lambda c: clinical.dosage_score(c, "Haploinsufficiency")) == [3, 1, 0, None, None, None]


def test_disease_entry(spark):
    raw = [
        "{Melanoma, cutaneous malignant, 1}, 155600 (2), Autosomal dominant",
        "[Blood group], 111000 (3)",
        "?Odd syndrome, 123456 (3), Autosomal recessive, X-linked",
        " Plain disorder, 222222 (3), , Mitochondrial",
        "{No number}",
    ]
    got = [tuple(r) for r in values(spark, raw, clinical.disease_entry)]
    assert got == [
        ("Melanoma, cutaneous malignant, 1", "155600", "2", "susceptibility", "Autosomal dominant"),
        ("Blood group", "111000", "3", "nondisease", None),
        ("Odd syndrome", "123456", "3", "unconfirmed_mendelian", "Autosomal recessive;X-linked"),
        ("Plain disorder", "222222", "3", "confirmed_mendelian", "Mitochondrial"),
        ("No number", None, None, "unconfirmed_or_unmapped", None),
    ]


def test_multi_value_score(spark):
    raw = ["0.1;.;0.05", "0.7", ".", "nan;5d", None, "1e-3;2"]
    assert values(spark, raw, variants.lowest_score) == [0.05, 0.7, None, None, None, 0.001]


def test_zygosity(spark):
    raw = ["1/1", "0|1", "0/0", "./.", "1", None, "1/1/1"]
    plain = ["homozygous", "heterozygous", "heterozygous", "homozygous", "heterozygous", "heterozygous", "heterozygous"]
    assert values(spark, raw, variants.zygosity_from_genotype) == plain
    strict = values(spark, raw, lambda c: variants.zygosity_from_genotype(c, strict=True))
    assert strict[3] is None and strict[5] is None and strict[0] == "homozygous"


def test_genotype_field(spark):
    df = spark.createDataFrame([("GT:DP", "0/1:3"), ("DP:GT", "3:1|1"), ("DP", "3"), ("DP:GT", "3")], "f string, s string")
    got = [r[0] for r in df.select(text.genotype(F.col("f"), F.col("s"))).collect()]
    assert got == ["0/1", "1|1", None, None]


def test_inheritance_zygosity(spark):
    raw = ["Autosomal recessive;Autosomal dominant", "Autosomal dominant", "X-linked recessive", "X-linked", None]
    got = values(spark, raw, lambda c: variants.zygosity_from_inheritance(c, 42, F.col("i")))
    assert got[:3] == ["homozygous", "heterozygous", "homozygous"]
    assert got[3] in ("hemizygous", "heterozygous") and got[4] in ("heterozygous", "homozygous")
    assert values(spark, ["Autosomal recessive"], lambda c: variants.background_zygosity(c, 42, F.col("i"))) == ["heterozygous"]


def test_symptom_lists(spark):
    raw = ['["HP:1","HP:2"]', '"HP:3"', "HP:4, HP:5,,", "", "[broken"]
    got = values(spark, raw, text.parse_symptom_list)
    assert got == [["HP:1", "HP:2"], ["HP:3"], ["HP:4", "HP:5"], [], ["[broken"]]
    assert values(spark, ["a;b", None, ""], text.split_symptoms) == [["a", "b"], [], []]


def test_titles_and_ids(spark):
    raw = ["NAME; SYM; X", "ONLY"]
    assert values(spark, raw, text.title_name) == ["NAME", "ONLY"]
    assert values(spark, raw, text.title_symbol) == ["SYM; X", None]
    assert values(spark, ["154700.0", "154700", "x", None], clinical.disease_id) == ["OMIM:154700", "OMIM:154700", None, None]
    assert values(spark, ["chr1", "1", "chrchr"], variants.strip_chr) == ["1", "1", "chr"]


def test_gene_symbols(spark):
    assert values(spark, ["A:1|B:2", "C:3", None, "|D:1"], clinical.gene_symbols) == [["A", "B"], ["C"], [], ["", "D"]]
