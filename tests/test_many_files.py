"""Many patient files: few listing tasks, files made by many tasks, one pass over the lines."""

import pathlib
import uuid

from pyspark.sql import functions as F

from lociq.catalog import QUERIES, scans
from lociq.catalog.registry import Tables
from lociq.catalog.scans import staged_files
from lociq.session import shared_dir
from lociq.sources import vcf
from lociq.sources.lines import LISTING_TASKS, read_lines


def test_folders_are_listed_many_to_a_task(spark, tmp_path):
    for i in range(80):
        (tmp_path / f"patient={i}").mkdir()
        (tmp_path / f"patient={i}" / "a.vcf").write_text(f"#CHROM\n1\t{i}\n")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "listing")
    try:
        lines = read_lines(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= LISTING_TASKS * spark.sparkContext.defaultParallelism < 80
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert lines.count() == 160


def test_small_files_are_made_by_many_tasks(spark, folder):
    data = spark.range(200).select((F.col("id") % 40).alias("who"), F.col("id").alias("place"), F.format_string("%d", "id").alias("value"))
    path = staged_files(Tables(spark, folder), "many", data, "who", "place")
    found = spark.read.text(path).select("value", "patient", F.substring_index("_metadata.file_path", "/", -1).alias("file"))
    assert found.select("patient").distinct().count() == 40 and found.count() == 200
    assert found.filter(F.col("value").cast("int") % 40 != F.col("patient")).isEmpty()
    assert found.select(F.substring("file", 1, 10)).distinct().count() > 1


def test_types_are_detected_in_one_pass(spark, tmp_path):
    plain, deletion = "1\t5\t.\tN\t<X>\t.\tPASS\tDP=3\n", "1\t5\t.\tN\t<X>\t.\tPASS\tSVTYPE=DEL;END=9\n"
    files = {
        "header": "##SVTYPE=DEL\n#CHROM\n",
        "early": "#CHROM\n" + plain * 50 + "#note SVTYPE=DEL\n" * 60 + deletion,
        "late": "#CHROM\n" + plain * 51 + deletion,
        "noted": "#SVTYPE=DEL\n" * 60 + plain,
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = vcf.detect_types(read_lines(spark, str(tmp_path)))
    assert {r.patient_file: r.detected_type for r in found.collect()} == {"header": "snv", "early": "cnv", "late": "snv", "noted": "snv"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("text") == 1


def test_wide_text_lies_on_disk_a_slice_at_a_time(spark, folder, monkeypatch):
    """The rows are the same in one slice or several, and no slice is left behind."""
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "lociq"

    def run(name):
        before = set(shared.glob("wide-*"))
        found = sorted(map(repr, QUERIES[name](spark, folder).collect()))
        assert set(shared.glob("wide-*")) == before
        return found

    whole = run("s12_wide_table_probe")
    monkeypatch.setattr(scans, "WIDE_ROWS", 600)
    assert run("s12_wide_table_probe") == whole and run("s12_bucketed_stage_probe") == whole and whole
