"""End-to-end analysis of patient files, and files that arrive one by one."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lociq.operators import model
from lociq.operators.search import search_many, search_terms, term_index
from lociq.plans import analyze, evaluate
from lociq.plans.analyze import ReferenceTables, analyze_cohort
from lociq.session import shared_dir
from lociq.sources import vcf
from lociq.sources.lines import read_lines
from lociq.streaming.arrivals import analyze_arrivals, arriving_lines, rank_arrivals

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE\n"


@pytest.fixture(scope="module")
def reference(spark):
    def table(data, schema):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], schema + ", src_ord int")

    genes = [("17", 43044000, 43126000, "BR1", "ENSG1", "coding"), ("7", 117470000, 117670000, "CF", "ENSG2", "coding"),
             ("1", 11780000, 11810000, "MT1", "ENSG3", "coding"), ("17", 43100000, 43200000, "NB", "ENSG4", "lnc")]
    return ReferenceTables(
        genes=table(genes, "chromosome string, start_position long, end_position long, gene_symbol string, gene_id string, gene_biotype string"),
        constraint=table([("BR1", 0.5, 0.4, 0.6, 10.0, 0.9), ("CF", 1.0, 0.9, 1.1, 50.0, 0.0)],
                         "gene_symbol string, oe_lof double, oe_lof_lower double, oe_lof_upper double, oe_lof_upper_rank double, pLI double"),
        dosage=table([("BR1", "l", 3, "l", 0)], "gene_symbol string, haploinsufficiency_label string, haploinsufficiency_score int, "
                     "triplosensitivity_label string, triplosensitivity_score int"),
        gene_diseases=table([("BR1", "1", "Cancer", "604370", "3", "confirmed_mendelian", "Autosomal dominant"),
                             ("CF", "2", "Fibrosis", "219700", "3", "confirmed_mendelian", "Autosomal recessive")],
                            "gene_symbol string, mim_number string, disease_name string, phenotype_mim_number string, mapping_key string, "
                            "phenotype_type string, inheritance_modes string"),
        annotations=table([("OMIM:604370", "HP:0003002", 0.9, "P", False), ("OMIM:604370", "HP:1", None, "P", False),
                           ("OMIM:219700", "HP:2", 0.5, "P", False)],
                          "disease_id string, hpo_id string, frequency_numeric double, aspect string, is_negated boolean"),
        sites=table([("17_43094692_G_A", "BR1", False, "Pathogenic", "reviewed"), ("17_43094692_G_A", "NB", False, "Pathogenic", "reviewed")],
                    "variant_id string, gene_symbol string, has_multiple_genes boolean, clinvar_significance string, review_status string"),
    )


def trained(spark, kind):
    rng = random.Random(2)
    names = {"snv": model.SNV_FEATURES, "cnv": model.CNV_FEATURES}[kind]
    text = set({"snv": model.SNV_CATEGORIES, "cnv": model.CNV_CATEGORIES}[kind])
    data = []
    for i in range(200):
        row = [rng.choice(["p", "q"]) if c in text else rng.random() for c in names]
        data.append((*row, int(row[names.index("phenotype_similarity_score")] > 0.6)))
    schema = ", ".join(f"{c} {'string' if c in text else 'double'}" for c in names) + ", is_causal int"
    return model.train(spark.createDataFrame(data, schema), names, sorted(text), rounds=3, depth=2)


def write_sites(folder):
    lines = ["1\t11794419\t.\tG\tA\t.\tPASS\tDP=45\tGT\t1/1", "chr17\t43094692\t.\tG\tA\t.\tPASS\tDP=38\tGT\t0/1", "7\t117559592\t.\tA\tT\t.\tPASS\tDP=52\tGT\t0/1",
             "X\t5\t.\tA\tT\t.\tPASS\tDP=52\tGT\t0/1"]
    (folder / "a.vcf").write_text(HEAD + "\n".join(lines) + "\n")
    (folder / "b.vcf").write_text(HEAD + lines[1] + "\n")


def test_analyze_sites(spark, reference, tmp_path):
    write_sites(tmp_path)
    out = analyze_cohort(spark, str(tmp_path), ["HP:0003002"], "snv", reference, trained(spark, "snv"))
    assert {r.patient_file: (r.detected_type, r.type_mismatch, r.n_variants_parsed) for r in out.files.collect()} == {
        "a.vcf": ("snv", False, 4),
        "b.vcf": ("snv", False, 1),
    }
    rows = out.results.orderBy("patient_id", "rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 1]
    top = rows[0]
    assert (top.gene_symbol, top.in_clinvar, top.clinvar_significance, top.best_matching_disease) == ("BR1", True, "Pathogenic", "Cancer")
    assert top.phenotype_similarity_score == pytest.approx(0.75)
    by_gene = {r.variant_id: (r.gene_symbol, r.in_clinvar) for r in rows}
    assert by_gene["7_117559592_A_T"] == ("CF", False) and by_gene["X_5_A_T"] == (None, False)
    places = out.evidence.filter("patient_id = 'a.vcf'").collect()
    assert places and all(r.variant_id == "17_43094692_G_A" and r.place <= 5 for r in places)


def test_analyze_deletions(spark, reference, tmp_path):
    records = ["17\t43044295\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=43125483\tGT\t0/1", "9\t10\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=20\tGT\t0/1"]
    (tmp_path / "c.vcf").write_text(HEAD + "\n".join(records) + "\n")
    out = analyze_cohort(spark, str(tmp_path), ["HP:0003002"], "cnv", reference, trained(spark, "cnv"))
    rows = {(r.variant_id, r.gene_symbol): r for r in out.results.collect()}
    assert set(rows) == {("17_43044295_43125483", "BR1"), ("17_43044295_43125483", "NB"), ("9_10_20", None)}
    assert rows[("17_43044295_43125483", "BR1")].overlap_fraction_of_gene == pytest.approx(81188 / 82000)
    assert rows[("9_10_20", None)].overlap_fraction_of_gene is None and rows[("9_10_20", None)].deletion_size == 10


def test_requests_are_checked(spark, reference, tmp_path):
    write_sites(tmp_path)
    fitted = None
    with pytest.raises(ValueError, match="mode"):
        analyze_cohort(spark, str(tmp_path), ["HP:1"], "both", reference, fitted)
    with pytest.raises(ValueError, match="symptom"):
        analyze_cohort(spark, str(tmp_path), [], "snv", reference, fitted)
    with pytest.raises(ValueError, match="could be parsed"):
        analyze_cohort(spark, str(tmp_path), ["HP:1"], "cnv", reference, fitted, strict=True)
    requests = spark.createDataFrame([("a.vcf", '["HP:1"]')], "patient_id string, symptoms string")
    with pytest.raises(ValueError, match="symptom"):
        analyze_cohort(spark, str(tmp_path), requests, "snv", reference, fitted, strict=True)
    (tmp_path / "junk.vcf").write_text("nothing here\n")
    with pytest.raises(ValueError, match="valid VCF"):
        analyze_cohort(spark, str(tmp_path), ["HP:1"], "snv", reference, fitted, strict=True)


def broken_cohort(folder):
    write_sites(folder)
    (folder / "junk.vcf").write_text("nothing here\n")
    (folder / "bare.vcf").write_text(HEAD)
    (folder / "untold.vcf").write_text(HEAD + "17\t43094692\t.\tG\tA\t.\tPASS\tDP=1\tGT\t0/1\n")
    return {"a.vcf": "analysed", "b.vcf": "analysed", "junk.vcf": "not a variant file", "bare.vcf": "nothing parsed", "untold.vcf": "no symptoms"}


def told(spark):
    names = ["a.vcf", "b.vcf", "junk.vcf", "bare.vcf"]
    return spark.createDataFrame([(n, "HP:0003002") for n in names], "patient_id string, symptoms string")


def test_a_broken_file_holds_up_no_other(spark, reference, tmp_path):
    statuses = broken_cohort(tmp_path)
    fitted = trained(spark, "snv")
    out = analyze_cohort(spark, str(tmp_path), told(spark), "snv", reference, fitted)
    assert {r.patient_file: r.status for r in out.files.collect()} == statuses
    whole = analyze_cohort(spark, [str(tmp_path / n) for n in ("a.vcf", "b.vcf")], ["HP:0003002"], "snv", reference, fitted)
    assert sorted(map(tuple, out.results.collect())) == sorted(map(tuple, whole.results.collect()))
    assert {r.patient_id for r in out.evidence.collect()} == {"a.vcf", "b.vcf"}


def test_symptoms_per_patient(spark, reference):
    variants = spark.createDataFrame(
        [("p", "17", 43094692, "G", "A", "PASS", "0/1", "17_43094692_G_A"), ("q", "17", 43094692, "G", "A", "PASS", "0/1", "17_43094692_G_A")],
        "patient_id string, chromosome string, position long, reference_allele string, alternate_allele string, filter_status string, genotype_raw string, variant_id string",
    )
    requests = spark.createDataFrame([("p", "HP:0003002,HP:1"), ("q", '"HP:2"')], "patient_id string, symptoms string")
    out = analyze.scored_candidates(variants, analyze.symptom_rows(requests), "snv", reference)
    assert {r.patient_id: r.phenotype_similarity_score for r in out.collect()} == {"p": 1.0, "q": 0.0}


def test_arrivals_are_analysed_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    write_sites(folder)

    def run():
        lines = arriving_lines(spark, str(folder))
        analyze_arrivals(lines, lambda b: vcf.parse_patient_sites(b).drop("src_ord"), out, state).awaitTermination(60)
        return spark.read.parquet(out)

    assert run().count() == 5
    (folder / "late.vcf").write_text(HEAD + "2\t9\t.\tA\tT\t.\tPASS\tDP=1\n")
    got = run()
    assert got.count() == 6 and got.filter("patient_file = 'late.vcf'").first().variant_id == "2_9_A_T"


@pytest.mark.parametrize("with_model", [True, False])
def test_arriving_files_are_ranked_like_a_batch(spark, reference, tmp_path, with_model):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    statuses = broken_cohort(folder)
    fitted = trained(spark, "snv") if with_model else None
    symptoms = analyze.symptom_rows(told(spark))

    def run(state):
        lines = arriving_lines(spark, str(folder), files_per_batch=2)
        rank_arrivals(lines, symptoms, "snv", reference, fitted, out, state).awaitTermination(240)
        return spark.read.parquet(f"{out}/ranked").drop("batch"), spark.read.parquet(f"{out}/files")

    before = stage_tables(spark)
    ranked, files = run(state)
    assert stage_tables(spark) == before
    variants, wanted, _ = analyze.read_cohort(read_lines(spark, str(folder)), symptoms, "snv")
    batch = analyze.rank_cohort(variants, wanted, "snv", reference, fitted).select(*ranked.columns)
    once = sorted(map(repr, ranked.collect()))
    assert once == sorted(map(repr, batch.collect())) and len(once) > 0
    assert {r.patient_file: r.status for r in files.collect()} == statuses
    # The same batches again, as after a failure before they were committed, replace their folders.
    ranked, files = run(str(tmp_path / "again"))
    assert sorted(map(repr, ranked.collect())) == once and files.count() == len(statuses)


def test_arrivals_reduce_the_reference_tables_once(spark, reference, tmp_path, monkeypatch):
    """No batch runs over the whole annotation or gene table again; rows are those of one batch run."""
    folder = tmp_path / "files"
    folder.mkdir()
    write_sites(folder)
    symptoms = spark.createDataFrame([("a.vcf", "HP:0003002"), ("b.vcf", "HP:1"), ("gone.vcf", "HP:1")], "patient_id string, hpo_id string")
    variants, wanted, _ = analyze.read_cohort(read_lines(spark, str(folder)), symptoms, "snv")
    assert sorted(r.patient_id for r in wanted.collect()) == ["a.vcf", "b.vcf"]
    whole = analyze.rank_cohort(variants, wanted, "snv", reference, None)

    def again(*args, **kwargs):
        raise AssertionError("reduced in a batch")

    for name in ("disease_weights", "gene_disease_ids", "first_locus"):
        monkeypatch.setattr(analyze, name, again)
    out = str(tmp_path / "out")
    lines = arriving_lines(spark, str(folder), files_per_batch=1)
    rank_arrivals(lines, symptoms, "snv", reference, None, out, str(tmp_path / "state")).awaitTermination(240)
    ranked = spark.read.parquet(f"{out}/ranked")
    assert ranked.select("batch").distinct().count() == 2
    ranked = ranked.drop("batch")
    assert sorted(map(repr, ranked.collect())) == sorted(map(repr, whole.select(*ranked.columns).collect()))


def stage_tables(spark):
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "lociq"
    return {p.name for p in folder.glob("*") if p.name.split("-")[0] in ("arrived", "variants", "files", "annotated", "scored")}


def test_evaluation_reports(spark):
    rng = random.Random(8)
    data = []
    for p in range(30):
        for i in range(8):
            causal = int(i == 0)
            data.append((p, f"v{p}_{i}", f"G{i}", causal, 0, rng.random() * 0.5 + causal * 0.6, "heterozygous", rng.random(), str(rng.random() * 30)))
    df = spark.createDataFrame(
        data, "patient_id int, variant_id string, gene_symbol string, is_causal int, is_hard_negative int, phenotype_similarity_score double, "
        "zygosity string, oe_lof double, CADD_phred string"
    )
    train, test = df.filter("patient_id < 20"), df.filter("patient_id >= 20")
    compared = {r.method: r for r in evaluate.baseline_comparison(train, test, rounds=3, depth=2).collect()}
    assert len(compared) == 3 and compared["full model"].top1_accuracy >= compared["pathogenicity score alone"].top1_accuracy
    ablated = {r.ablation: r for r in evaluate.ablation_study(train, test, "snv", rounds=2, depth=2).collect()}
    assert len(ablated) == 6
    assert ablated["Full model"].roc_auc > ablated["A1: without phenotype similarity"].roc_auc
    tiers = spark.range(30).select(F.col("id").cast("int").alias("patient_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("phenotype_tier"))
    by_tier = evaluate.stratified_ablation_study(train, test, tiers, rounds=2, depth=2)
    assert by_tier.count() == 18 and by_tier.filter("tier <> 'ALL' and roc_auc is not null").isEmpty()
    importance, shown = evaluate.explanation_report(train, test, "snv", rounds=3, depth=2)
    assert importance.first().feature == "phenotype_similarity_score"
    assert shown.count() == 3 and "phenotype_similarity_score=" in shown.first().top_supporting


def test_term_search(spark):
    terms = spark.createDataFrame([(f"HP:{i}", n, i) for i, n in enumerate(["Seizure", "Febrile seizure (x)", "Short", None])], "HPO_ID string, Name string, src_ord int")
    assert [r.HPO_ID for r in search_terms(terms, "SEIZ").collect()] == ["HP:0", "HP:1"]
    assert [r.HPO_ID for r in search_terms(terms, "(x)").collect()] == ["HP:1"]
    assert search_terms(terms, "s").isEmpty()
    assert [r.HPO_ID for r in search_terms(terms, "^s", regex=True).orderBy("HPO_ID").collect()] == ["HP:0", "HP:2"]
    assert {(r.query, r.HPO_ID) for r in search_many(terms, ["seiz", "sh"]).collect()} == {("seiz", "HP:0"), ("seiz", "HP:1"), ("sh", "HP:2")}


@pytest.mark.parametrize("large", [False, True])
def test_term_index_equals_testing_every_term(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr("lociq.operators.joins.BROADCAST_BYTES", -1)
    rng = random.Random(6)
    names = ["".join(rng.choices("abAB éx", k=rng.randint(0, 9))) for _ in range(300)] + [None, "aaaa", "AB"]
    terms = spark.createDataFrame([(f"HP:{i}", n, i) for i, n in enumerate(names)], "HPO_ID string, Name string, src_ord int")
    asked = ["ab", "aaa", "a", "", "abab", "É", "éx ", "xyz", "AB", "b a"]
    wanted = set()
    for q in {q for q in asked if len(q) >= 2}:
        hits = [i for i, n in enumerate(names) if n is not None and q.lower() in n.lower()]
        wanted |= {(q, f"HP:{i}", names[i], place) for place, i in enumerate(hits[:15], 1)}
    assert {tuple(r) for r in search_many(terms, asked).select("query", "HPO_ID", "Name", "place").collect()} == wanted
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    assert search_many(terms, queries, index=term_index(terms)).count() == len(wanted)
