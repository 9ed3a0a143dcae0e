"""Files as they are found in the wild."""

import csv
import gzip

import pytest
from pyspark.sql import functions as F

from lociq.operators.bloom import bloom_filter, may_contain
from lociq.schemas import PREDICTOR_PLACES
from lociq.sources import predictors, sinks, tables, vcf
from lociq.sources.lines import read_lines, without_first_lines

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE\n"


def test_line_order_over_many_splits(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("".join(f"{name}-{i:05d}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, str(tmp_path))
        values = [r.value for r in lines.orderBy("src_ord").select("value").collect()]
        kept = [r.value for r in without_first_lines(lines, 4).orderBy("src_ord").select("value").collect()]
        assert lines.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    assert values == sorted(values) and len(values) == 6000
    assert kept == [v for v in values if int(v[-5:]) >= 4]


def test_gzip_and_bgz(spark, tmp_path):
    with gzip.open(tmp_path / "s.vcf.gz", "wt") as f:
        f.write("#h\n1\t10\t.\tA\tG\t.\t.\tCLNSIG=Benign;GENEINFO=A:1|B:2\n")
    row = vcf.read_sites(spark, str(tmp_path / "s.vcf.gz")).first()
    assert (row.chromosome, row.position, row.gene_info_raw, row.review_status_raw) == ("1", 10, "A:1|B:2", None)


def test_blocked_gzip_is_read_under_another_name(spark, tmp_path):
    """Several gzip members in one file, two files by pattern."""
    for name, count in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.vcf.bgz").write_bytes(b"".join(gzip.compress(f"{name}\t{i}\n".encode()) for i in range(count)))
    assert [r.value for r in read_lines(spark, str(tmp_path / "a.vcf.bgz")).orderBy("src_ord").collect()] == ["a\t0", "a\t1", "a\t2"]
    lines = read_lines(spark, str(tmp_path / "*.bgz"))
    assert lines.count() == 5 and {r.file_path.rsplit("/")[-1] for r in lines.collect()} == {"a.vcf.gz", "b.vcf.gz"}


@pytest.mark.parametrize("sliced", [False, True])
def test_quoted_line_breaks(spark, tmp_path, monkeypatch, sliced):
    if sliced:
        monkeypatch.setattr("lociq.operators.ranking.GROUP_ROWS", 2)
    rows = [("A", "x"), ("B", 'two\nlines, "said"'), ("C", "\n\nthree\n"), ("D", ""), ("E", '""')]
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            f.write("made up\n++\nfor, a test\n++\n")
            out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL if name == "two" else csv.QUOTE_MINIMAL)
            out.writerows([("GENE SYMBOL", "HAPLOINSUFFICIENCY"), *rows])
    (tmp_path / "plain.csv").write_text("a\nb\nc\nd\nGENE SYMBOL,HAPLOINSUFFICIENCY\nF,plain\n")
    (tmp_path / "one.csv").write_text((tmp_path / "one.csv").read_text())
    for names in (["one.csv", "plain.csv"], ["plain.csv"]):
        got = tables.read_dosage(spark, [str(tmp_path / n) for n in names])
        wanted = [(a, b or None) for a, b in rows] if "one.csv" in names else []
        assert sorted((r["GENE SYMBOL"], r["HAPLOINSUFFICIENCY"]) for r in got.collect()) == sorted([*wanted, ("F", "plain")], key=str)
    (tmp_path / "open.csv").write_text('a\nb\nc\nd\nGENE SYMBOL,HAPLOINSUFFICIENCY\nF,"never closed\n')
    with pytest.raises(ValueError, match="never closed"):
        tables.read_dosage(spark, str(tmp_path / "open.csv"))


def test_bloom_filter_lets_every_wanted_key_through(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    wanted = df.filter("id % 10 = 0").select("key")
    passed = may_contain(df.unionByName(spark.sql("select cast(null as string) as key, cast(-1 as bigint) as id")), "key", wanted)
    assert passed.join(wanted, "key", "left_semi").count() == 2000 and passed.filter("key is null").isEmpty()
    assert passed.count() < 2000 + 0.05 * 18_000
    found, words = bloom_filter(wanted, "key")
    assert found.count() <= words <= 2000
    assert may_contain(df, "key", wanted.limit(0)).isEmpty()


def wide_file(folder, rows):
    cells = [[f"{i}|{p}" for p in range(4, 200)] for i in range(rows)]
    text = "".join("\t".join(["1", str(i), "A", "G", *cells[i]]) + "\n" for i in range(rows))
    (folder / "wide.txt").write_text("#h\n" + text)
    return str(folder / "wide.txt")


def exchanged(df):
    """Columns of everything the plan shuffles."""
    plan = df._jdf.queryExecution().executedPlan()
    nodes, out = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            out.append({node.output().apply(i).name() for i in range(node.output().size())})
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_no_text_line_is_shuffled(spark, tmp_path, large_mode):
    path = wide_file(tmp_path, 300)
    needed = spark.range(0, 600, 3).select(F.format_string("1_%d_A_G", "id").alias("variant_id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probed = predictors.probe_wide_table(spark, path, needed)
        assert exchanged(probed) and all("value" not in columns for columns in exchanged(probed))
        target = str(tmp_path / "stage")
        table = predictors.stage_wide_table(spark, path, target, buckets=5)
        staged = predictors.probe_staged_table(table, needed)
        assert exchanged(staged) and all(not columns & set(PREDICTOR_PLACES.values()) for columns in exchanged(staged))
        rows = sorted(map(tuple, probed.drop("src_ord").collect()))
        assert len(rows) == 100 and rows[0][1] == "0|48"
        assert sorted(map(tuple, staged.drop("src_ord").collect())) == rows
        spark.sql(f"DROP TABLE {predictors._table_name(target)}")
        again = predictors.probe_staged_table(predictors.open_staged_table(spark, target), needed)
        assert sorted(map(tuple, again.drop("src_ord").collect())) == rows
        assert all(not columns & set(PREDICTOR_PLACES.values()) for columns in exchanged(again))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_patient_sites_skip_bad_rows(spark, tmp_path):
    body = "chr1\t5\t.\tA\tG\t.\tPASS\tDP=1\tDP:GT\t3:1/1\n1\tx\t.\tA\tG\t.\tPASS\tDP=1\n1\t2\t3\n2\t7\t.\tC\tT\t.\tLOW\tDP=2\n"
    (tmp_path / "p1.vcf").write_text(HEAD + body)
    got = vcf.read_patient_sites(spark, str(tmp_path)).orderBy("variant_id").drop("src_ord").collect()
    assert [(r.patient_file, r.variant_id, r.genotype_raw, r.filter_status) for r in got] == [
        ("p1.vcf", "1_5_A_G", "1/1", "PASS"),
        ("p1.vcf", "2_7_C_T", None, "LOW"),
    ]


def test_patient_deletions_and_detection(spark, tmp_path):
    record = "chr7\t100\t.\tN\t<DEL>\t.\tPASS\t{}\tGT\t0/1\n"
    infos = ["SVTYPE=DEL;END=400", "SVTYPE=DUP;END=400", "SVTYPE=DEL", "SVTYPE=DEL;END=x", "SVTYPE=DEL;END=50"]
    (tmp_path / "del.vcf").write_text(HEAD + "".join(record.format(i) for i in infos))
    late = "1\t5\t.\tA\tG\t.\tPASS\tDP=1\n" * 51 + record.format("SVTYPE=DEL;END=9")
    (tmp_path / "late.vcf").write_text(HEAD + late)
    (tmp_path / "head.vcf").write_text(HEAD)
    lines = read_lines(spark, str(tmp_path))
    got = vcf.parse_patient_deletions(lines).filter("patient_file = 'del.vcf'").orderBy("end_position").collect()
    assert [(r.variant_id, r.deletion_size) for r in got] == [("7_100_50", 50), ("7_100_400", 300)]
    types = {r.patient_file: (r.detected_type, r.type_mismatch) for r in vcf.detect_types(lines, "snv").collect()}
    assert types == {"del.vcf": ("cnv", True), "late.vcf": ("snv", False), "head.vcf": ("snv", False)}


def test_file_status(spark, tmp_path):
    (tmp_path / "ok.vcf").write_text(HEAD)
    (tmp_path / "bad.vcf").write_text("hello\n")
    (tmp_path / "noheader.vcf").write_text("1\t5\t.\tA\tG\t.\tPASS\tDP=1\n")
    lines = read_lines(spark, str(tmp_path))
    status = vcf.file_status(lines, vcf.parse_patient_sites(lines))
    assert {r.patient_file: r.is_valid for r in status.collect()} == {"ok.vcf": True, "bad.vcf": False, "noheader.vcf": True}


def test_preamble_csv(spark, tmp_path):
    text = 'a\nb\nc,"x"\n+++\n"GENE SYMBOL","HAPLOINSUFFICIENCY","TRIPLOSENSITIVITY"\n"A, B","No Evidence for Haploinsufficiency",""\n"++++","++++","++++"\n'
    (tmp_path / "d.csv").write_text(text)
    from lociq.plans.clean import clean_dosage

    out = clean_dosage(tables.read_dosage(spark, str(tmp_path / "d.csv"))).collect()
    assert [(r.gene_symbol, r.haploinsufficiency_score, r.triplosensitivity_label) for r in out] == [("A, B", 0, None)]


def test_annotation_file_and_headerless(spark, tmp_path):
    (tmp_path / "p.hpoa").write_text("#c1\n#c2\ndatabase_id\tdisease_name\thpo_id\nOMIM:1\tD\tHP:1\n")
    assert tables.read_annotations(spark, str(tmp_path / "p.hpoa")).drop("src_ord").collect() == [("OMIM:1", "D", "HP:1")]
    (tmp_path / "m.txt").write_text("# a\n# b\n100\tgene\t\tSYM\tENSG1\n# tail\n")
    assert tables.read_mim_genes(spark, str(tmp_path / "m.txt")).drop("src_ord").collect() == [("100", "gene", None, "SYM", "ENSG1")]


def test_ontology(spark, tmp_path):
    text = 'format-version: 1.2\n\n[Term]\nid: HP:1\nname: All\n\n[Term]\nid: HP:2\nname: Two\ndef: "A \\"b\\"." [x]\nis_a: HP:1 ! All\nis_a: HP:9 {a="b"} ! N\n\n[Typedef]\nid: t\n'
    (tmp_path / "h.obo").write_text(text)
    got = tables.read_ontology(spark, str(tmp_path / "h.obo")).orderBy("HPO_ID").collect()
    assert [(r.HPO_ID, r.Name, r.Parents) for r in got] == [("HP:1", "All", ""), ("HP:2", "Two", "HP:1;HP:9")]
    assert got[1].Definition.startswith("A ")
    with_self = tables.read_ontology(spark, str(tmp_path / "h.obo"), include_self=True).orderBy("HPO_ID").collect()
    assert [r.Parents for r in with_self] == ["HP:1", "HP:2;HP:1;HP:9"]


def test_wide_probe(spark, tmp_path):
    def line(chrom, pos):
        return "\t".join([chrom, str(pos), "A", "G"] + [f"c{i}" if i != 48 else "." for i in range(4, 200)])

    with gzip.open(tmp_path / "w.gz", "wt") as f:
        f.write("#chr\tpos\n" + "\n".join(line("1", p) for p in range(30)) + "\n")
    needed = spark.createDataFrame([("1_3_A_G",), ("1_4_A_T",), ("1_5_A_G_x",), ("1_3_A_G",)], "variant_id string")
    out = predictors.probe_wide_table(spark, str(tmp_path / "w.gz"), needed).collect()
    assert [(r.variant_id, r.SIFT_score, r.CADD_phred) for r in out] == [("1_3_A_G", None, "c154")]


def test_json_sink_writes_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    sinks.write_json(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"a":1,"b":null,"c":null}'


def test_files_with_different_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("gene\toe_lof\nA\t1\n")
    (tmp_path / "b.tsv").write_text("oe_lof\tgene\n1\tA\n")
    with pytest.raises(ValueError, match="header"):
        tables.read_constraint(spark, str(tmp_path))


def test_header_drop_does_not_move_the_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("gene\n" + "A\n" * 1000)
    lines = without_first_lines(read_lines(spark, str(tmp_path)), 1)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert lines.count() == 1000 and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
