"""Sources and sinks: the given tables are written as source files, then read back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from lociq.catalog.registry import Tables, query
from lociq.catalog.relational import constraint, sites
from lociq.operators.ranking import first_per_key
from lociq.plans import clean
from lociq.schemas import PREDICTOR_PLACES
from lociq.session import delete, scratch_path
from lociq.sources import predictors, sinks, tables, vcf
from lociq.sources.lines import read_lines
from lociq.streaming.arrivals import analyze_arrivals, arriving_lines


def _tabbed(*columns: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def _comments(t: Tables) -> DataFrame:
    return t.region.select(F.concat(F.lit("##contig="), F.col("r_name")).alias("value"))


def staged_lines(t: Tables, name: str, lines: DataFrame, gzip: bool = False) -> str:
    """Write lines under the shared folder; line order inside a file does not matter here."""
    path = scratch_path(t.spark, name)
    writer = lines.select("value").write
    (writer.option("compression", "gzip") if gzip else writer).text(path)
    return path


def staged_files(t: Tables, name: str, lines: DataFrame, key: str, place: str, value: Column | str = "value") -> str:
    """Write one file per key, its lines in order of ``place``, in ``patient=<key>`` folders.

    ``value`` is worked out after the lines are in place: what a long line is made of moves, not
    the line.  Making a file costs more than its lines, so the number of tasks is given and not left to
    their bytes, and the tasks put their files in place themselves, not the driver one by one.
    """
    path = scratch_path(t.spark, name)
    tasks = max(4 * t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = lines.select(F.col(key).alias("patient"), F.col(place).alias("_place"), *[c for c in lines.columns if c not in (key, place)])
    ordered = ordered.repartition(tasks, "patient").sortWithinPartitions("patient", "_place")
    writer = ordered.select("patient", (F.col(value) if isinstance(value, str) else value).alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("patient").text(path)
    return path


def _with_head(data: DataFrame, key: str, head: list[str]) -> DataFrame:
    """Data lines plus the given first lines for every key."""
    first = F.array(*[F.struct(F.lit(i - len(head)).cast("bigint").alias("place"), F.lit(h).alias("value")) for i, h in enumerate(head)])
    heads = data.select(key).distinct().select(key, F.explode(first).alias("_h")).select(key, "_h.place", "_h.value")
    return data.select(key, "place", "value").unionByName(heads)


# --- population and annotation sources --------------------------------------------------------


@query("s1_site_file_scan", "SELECT * EXCLUDE (src_ord) FROM @sites_raw@")
def _(t: Tables):
    raw = t.sites_raw
    info = F.concat_ws(
        ";",
        F.lit("ALLELEID=1"),
        F.concat(F.lit("CLNREVSTAT="), F.col("review_status_raw")),
        F.concat(F.lit("GENEINFO="), F.col("gene_info_raw")),
        F.concat(F.lit("CLNSIG="), F.col("clinvar_significance_raw")),
    )
    lines = raw.select(
        _tabbed(
            F.col("chromosome"), F.col("position"), F.lit("."), F.col("reference_allele"), F.col("alternate_allele"),
            F.lit("."), F.lit("."), info,
        ).alias("value")
    )
    path = staged_lines(t, "sites", lines.unionByName(_comments(t)), gzip=True)
    return vcf.read_sites(t.spark, path).drop("src_ord")


@query("s2_structural_file_scan", "SELECT * EXCLUDE (src_ord) FROM @structural_raw@")
def _(t: Tables):
    raw = t.structural_raw
    info = F.concat_ws(
        ";",
        F.lit("PRECISE"),
        F.concat(F.lit("END="), F.col("end_position_raw")),
        F.concat(F.lit("SVLEN="), F.col("sv_length_raw")),
        F.concat(F.lit("AF="), F.col("allele_frequency_raw")),
        F.lit("CPX_AF=9"),
        F.concat(F.lit("SVTYPE="), F.col("sv_type_raw")),
    )
    lines = raw.select(
        _tabbed(
            F.col("chromosome"), F.col("start_position"), F.lit("id"), F.lit("N"), F.lit("<DEL>"), F.lit("."),
            F.col("variant_filter"), info,
        ).alias("value")
    )
    path = staged_lines(t, "structural", lines.unionByName(_comments(t)))
    return vcf.read_structural(t.spark, path).drop("src_ord")


@query("s3_gene_annotation_scan", "SELECT * EXCLUDE (src_ord) FROM @genes_raw@")
def _(t: Tables):
    raw = t.genes_raw
    attributes = F.concat_ws(
        " ",
        F.concat(F.lit('gene_id "'), F.col("gene_id"), F.lit('";')),
        F.lit('gene_version "5";'),
        F.concat(F.lit('gene_name "'), F.col("gene_symbol"), F.lit('";')),
        F.concat(F.lit('gene_biotype "'), F.col("gene_biotype"), F.lit('";')),
    )

    def rows(feature: str) -> DataFrame:
        return raw.select(
            _tabbed(
                F.col("chromosome"), F.lit("src"), F.lit(feature), F.col("start_position"), F.col("end_position"),
                F.lit("."), F.lit("+"), F.lit("."), attributes,
            ).alias("value")
        )

    path = staged_lines(t, "genes", rows("gene").unionByName(rows("exon")).unionByName(_comments(t)))
    return tables.read_gene_annotation(t.spark, path).drop("src_ord")


@query("s4_constraint_file", """SELECT gene, round(oe_lof, 9) AS oe_lof, oe_lof_upper_rank, round("pLI", 9) AS "pLI" FROM @constraint_raw@""")
def _(t: Tables):
    raw = t.constraint_raw
    names = ["gene", "extra", "oe_lof", "oe_lof_lower", "oe_lof_upper", "oe_lof_upper_rank", "pLI"]
    data = raw.select(
        (F.col("src_ord") % 8).alias("part"),
        F.col("src_ord").alias("place"),
        _tabbed(*[F.lit("x") if c == "extra" else F.coalesce(F.col(c).cast("string"), F.lit("NaN" if c == "pLI" else "")) for c in names]).alias("value"),
    )
    path = staged_files(t, "constraint", _with_head(data, "part", ["\t".join(names)]), "part", "place")
    return tables.read_constraint(t.spark, path).select("gene", "oe_lof", "oe_lof_upper_rank", "pLI")


@query("s5_preamble_csv", "SELECT * EXCLUDE (src_ord) FROM @dosage_raw@")
def _(t: Tables):
    raw = t.dosage_raw
    names = ["GENE SYMBOL", "NOTE", "HAPLOINSUFFICIENCY", "TRIPLOSENSITIVITY"]
    quoted = [
        F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit('"')) if c != "NOTE" else F.lit('"a, b"')
        for c in names
    ]
    data = raw.select(
        (F.col("src_ord") % 4).alias("part"), F.col("src_ord").alias("place"), F.concat_ws(",", *quoted).alias("value")
    )
    head = ["CURATIONS", "FILE CREATED: today", "WEBPAGE: none", "+++++,+++++", ",".join(f'"{c}"' for c in names)]
    path = staged_files(t, "dosage", _with_head(data, "part", head), "part", "place")
    return tables.read_dosage(t.spark, path).drop("NOTE", "src_ord")


def _headerless(t: Tables, name: str, df: DataFrame, columns: list[str], given: dict[str, str]) -> str:
    values = [F.col(given[c]) if c in given else F.lit("") for c in columns]
    return staged_lines(t, name, df.select(_tabbed(*values).alias("value")).unionByName(_comments(t)))


@query("s6_gene_map_file", "SELECT approved_gene_symbol, mim_number, trim(phenotypes_raw) AS phenotypes_raw FROM @gene_map_raw@")
def _(t: Tables):
    same = {c: c for c in ("approved_gene_symbol", "mim_number", "phenotypes_raw")}
    path = _headerless(t, "genemap", t.gene_map_raw, tables.schemas.GENEMAP_COLUMNS, same)
    out = tables.read_gene_map(t.spark, path)
    return out.select("approved_gene_symbol", "mim_number", F.trim("phenotypes_raw").alias("phenotypes_raw"))


@query("s6_mim_gene_file", "SELECT * EXCLUDE (src_ord) FROM @mim_genes_raw@")
def _(t: Tables):
    columns = tables.schemas.MIM2GENE_COLUMNS
    return tables.read_mim_genes(t.spark, _headerless(t, "mim2gene", t.mim_genes_raw, columns, dict(zip(columns, columns)))).drop("src_ord")


@query("s6_mim_title_file", "SELECT prefix, mim_number, trim(preferred_title_raw) AS preferred_title_raw FROM @mim_titles_raw@")
def _(t: Tables):
    same = {c: c for c in ("prefix", "mim_number", "preferred_title_raw")}
    out = tables.read_mim_titles(t.spark, _headerless(t, "titles", t.mim_titles_raw, tables.schemas.MIM_TITLE_COLUMNS, same))
    return out.select("prefix", "mim_number", F.trim("preferred_title_raw").alias("preferred_title_raw"))


@query("s6_morbid_map_file", "SELECT trim(phenotype_raw) AS phenotype_raw, gene_symbols_raw, gene_mim_number, cyto_location FROM @morbid_raw@")
def _(t: Tables):
    columns = tables.schemas.MORBIDMAP_COLUMNS
    out = tables.read_morbid_map(t.spark, _headerless(t, "morbid", t.morbid_raw, columns, dict(zip(columns, columns))))
    return out.drop("src_ord").withColumn("phenotype_raw", F.trim("phenotype_raw"))


@query(
    "s7_annotation_file",
    """SELECT database_id, disease_name, trim(qualifier) AS qualifier, hpo_id, trim(frequency) AS frequency, onset, aspect FROM @annotations_raw@""",
)
def _(t: Tables):
    names = ["database_id", "disease_name", "qualifier", "hpo_id", "frequency", "onset", "aspect"]
    data = t.annotations_raw.select(
        (F.col("src_ord") % 8).alias("part"), F.col("src_ord").alias("place"), _tabbed(*[F.col(c) for c in names]).alias("value")
    )
    path = staged_files(t, "hpoa", _with_head(data, "part", ["#description", "#date", "\t".join(names)]), "part", "place")
    out = tables.read_annotations(t.spark, path).drop("src_ord")
    return out.withColumns({c: F.trim(c) for c in ("qualifier", "frequency")})


def _ontology_path(t: Tables) -> str:
    key = F.col("p_partkey")

    def ident(c):
        return F.concat(F.lit("HP:"), F.lpad(c.cast("string"), 7, "0"))

    stanza = F.concat_ws(
        "\n",
        F.lit("[Term]"),
        F.concat(F.lit("id: "), ident(key)),
        F.concat(F.lit("name: "), F.col("p_name")),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit('def: "Size '), F.col("p_size").cast("string"), F.lit('." [x:1]'))),
        F.when(key > 0, F.concat(F.lit("is_a: "), ident(F.floor(key / 2)), F.lit(" ! parent"))),
        F.when(key > 1, F.concat(F.lit("is_a: "), ident(F.floor(key / 3)), F.lit(" {x=y} ! other"))),
        F.lit("synonym: \"id: no\" EXACT []"),
    )
    other = F.concat(F.lit("[Typedef]\nid: "), F.col("r_name"))
    path = scratch_path(t.spark, "ontology")
    stanzas = t.part.select(stanza.alias("value")).unionByName(t.region.select(other.alias("value")))
    stanzas.write.option("lineSep", "\n\n").text(path)
    return path


_TERM_SQL = """SELECT 'HP:' || lpad(p_partkey::VARCHAR, 7, '0') AS "HPO_ID", p_name AS "Name",
        CASE WHEN p_size % 3 <> 0 THEN 'Size ' || p_size || '.' END AS "Definition", {self}
        CASE WHEN p_partkey = 0 THEN '' WHEN p_partkey = 1 THEN {sep}'HP:0000000' ELSE {sep}'HP:' || lpad(floor(p_partkey / 2)::BIGINT::VARCHAR, 7, '0')
             || ';HP:' || lpad(floor(p_partkey / 3)::BIGINT::VARCHAR, 7, '0') END AS "Parents" FROM part"""


@query("s8_ontology_file", _TERM_SQL.format(self="", sep=""))
def _(t: Tables):
    return tables.read_ontology(t.spark, _ontology_path(t)).drop("src_ord")


@query(
    "s8_ontology_file_with_self",
    _TERM_SQL.format(self="'HP:' || lpad(p_partkey::VARCHAR, 7, '0') ||", sep="';' || "),
)
def _(t: Tables):
    return tables.read_ontology(t.spark, _ontology_path(t), include_self=True).drop("src_ord")


# --- patient files ---------------------------------------------------------------------------

_VCF_HEAD = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]


def patient_site_path(t: Tables) -> str:
    """One point-variant file per user; some lines are short or have a bad position."""
    d = t.deletions
    position = F.when(F.col("src_ord") % 10 == 3, F.lit("x12")).otherwise(F.col("start_position").cast("string"))
    full = _tabbed(
        F.concat(F.lit("chr"), F.col("chromosome")), position, F.lit("."), F.lit("A"), F.lit("G"), F.lit("."),
        F.col("filter_status"), F.lit("DP=45"),
    )
    sample = F.when(F.col("genotype_raw").isNotNull(), F.concat(F.lit("\tDP:GT\t45:"), F.col("genotype_raw"))).otherwise("")
    value = F.when(F.col("src_ord") % 10 == 7, F.lit("1\t2\t3")).otherwise(F.concat(full, sample))
    data = d.select("patient_id", F.col("src_ord").alias("place"), value.alias("value"))
    return staged_files(t, "patients", _with_head(data, "patient_id", _VCF_HEAD), "patient_id", "place")


def patient_deletion_path(t: Tables) -> str:
    """One deletion file per user; some records are duplications or lack a usable end."""
    d = t.deletions
    end = F.when(F.col("src_ord") % 10 == 3, F.lit("x")).otherwise(F.col("end_position").cast("string"))
    info = F.concat_ws(
        ";",
        F.when(F.col("src_ord") % 10 == 7, F.lit("SVTYPE=DUP")).otherwise(F.lit("SVTYPE=DEL")),
        F.when(F.col("src_ord") % 10 != 9, F.concat(F.lit("END="), end)),
    )
    value = _tabbed(
        F.concat(F.lit("chr"), F.col("chromosome")), F.col("start_position"), F.lit("."), F.lit("N"), F.lit("<DEL>"),
        F.lit("."), F.col("filter_status"), info, F.lit("GT"), F.coalesce("genotype_raw", F.lit("./.")),
    )
    data = d.select("patient_id", F.col("src_ord").alias("place"), value.alias("value"))
    return staged_files(t, "deletions", _with_head(data, "patient_id", _VCF_HEAD), "patient_id", "place")


_PATIENT_SITES = """SELECT patient_id::VARCHAR AS patient_file, chromosome, start_position AS position, 'A' AS reference_allele, 'G' AS alternate_allele,
        filter_status, genotype_raw, chromosome || '_' || start_position || '_A_G' AS variant_id FROM @deletions@ WHERE src_ord % 10 NOT IN (3, 7)"""


@query("s9_patient_site_files", _PATIENT_SITES)
def _(t: Tables):
    return vcf.read_patient_sites(t.spark, patient_site_path(t)).drop("src_ord")


@query(
    "s9_patient_file_status",
    """SELECT patient_id::VARCHAR AS patient_file, true AS has_header, count(*) FILTER (src_ord % 10 NOT IN (3, 7)) AS n_variants_parsed, true AS is_valid
        FROM @deletions@ GROUP BY 1""",
)
def _(t: Tables):
    lines = read_lines(t.spark, patient_site_path(t))
    return vcf.file_status(lines, vcf.parse_patient_sites(lines))


_PATIENT_DELETIONS = """SELECT patient_id::VARCHAR AS patient_file, chromosome, start_position, end_position, end_position - start_position AS deletion_size,
        NULL::DOUBLE AS allele_frequency, filter_status, coalesce(genotype_raw, './.') AS genotype_raw, variant_id
        FROM @deletions@ WHERE src_ord % 10 NOT IN (3, 7, 9)"""


@query("s10_patient_deletion_files", _PATIENT_DELETIONS)
def _(t: Tables):
    return vcf.read_patient_deletions(t.spark, patient_deletion_path(t)).drop("src_ord")


_IS_DEL = "(user_id % 3 = 0 AND event_type = 'view') OR (user_id % 3 = 1 AND event_id % 97 = 0)"


@query(
    "s11_file_type_detection",
    f"""SELECT user_id::VARCHAR AS patient_file, CASE WHEN bool_or(is_del AND nth <= 51) THEN 'cnv' ELSE 'snv' END AS detected_type, 'snv' AS requested_mode,
        bool_or(is_del AND nth <= 51) AS type_mismatch FROM (SELECT user_id, {_IS_DEL} AS is_del,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) GROUP BY user_id""",
)
def _(t: Tables):
    info = F.when(F.expr(_IS_DEL), F.lit("SVTYPE=DEL;END=5")).otherwise(F.lit("DP=3"))
    value = _tabbed(F.lit("1"), F.col("event_id"), F.lit("."), F.lit("N"), F.lit("<X>"), F.lit("."), F.lit("PASS"), info)
    data = t.events.select(F.col("user_id"), F.col("event_id").alias("place"), value.alias("value"))
    path = staged_files(t, "mixed", _with_head(data, "user_id", _VCF_HEAD), "user_id", "place")
    return vcf.detect_types(read_lines(t.spark, path), "snv")


# --- probe, stages, sinks --------------------------------------------------------------------


def _cell(place: int, name: str) -> str:
    cell = f"'v' || src_ord || '_{place}'"
    return f"CASE WHEN src_ord % 4 = 0 THEN NULL ELSE 's' || src_ord || ';48' END AS \"{name}\"" if place == 48 else f'{cell} AS "{name}"'


_SITE_ID = "concat(chromosome, '_', position, '_', reference_allele, '_', alternate_allele)"
_WIDE = f"""SELECT {_SITE_ID} AS variant_id, {", ".join(_cell(p, n) for p, n in PREDICTOR_PLACES.items() if p > 3)}
       FROM @sites_raw@ WHERE {_SITE_ID} IN (SELECT variant_id FROM @patient_sites@)"""


# Lines of 380 columns, of some 4 KB each, that lie on disk at a time.
WIDE_ROWS = 250_000


def wide_table_slices(t: Tables) -> Iterator[str]:
    """All of ``sites_raw`` as lines of 380 columns in several files, a slice of the rows at a time.

    The text is many times as large as the table, so a slice is deleted when the next one is asked for.
    """
    n = max(1, -(-t.sites_raw.count() // WIDE_ROWS))
    for i in range(n):
        path = _wide_files(t, t.sites_raw.filter(F.pmod(F.xxhash64("src_ord"), F.lit(n)) == i))
        yield path
        delete(t.spark, path)


def _wide_files(t: Tables, rows: DataFrame) -> str:
    key = F.col("src_ord").cast("string")
    sift = F.when(F.col("src_ord") % 4 == 0, F.lit(".")).otherwise(F.concat(F.lit("s"), key, F.lit(";48")))
    cells = F.transform(
        F.sequence(F.lit(4), F.lit(379)), lambda p: F.when(p == 48, sift).otherwise(F.concat(F.lit("v"), key, F.lit("_"), p.cast("string")))
    )
    front_names = ["chromosome", "position", "reference_allele", "alternate_allele"]
    front = F.array(*[F.col(c).cast("string") for c in front_names])
    value = F.array_join(F.concat(front, cells), "\t")
    data = rows.select((F.col("src_ord") % 8).alias("part"), F.col("src_ord").alias("place"), F.lit(None).cast("string").alias("value"), "src_ord", *front_names)
    heads = _with_head(data, "part", ["#chr\tpos\tref\talt\trest"]).filter(F.col("value").isNotNull())
    lines = data.unionByName(heads, allowMissingColumns=True)
    return staged_files(t, "wide", lines, "part", "place", F.coalesce("value", value))


def _wanted(t: Tables) -> DataFrame:
    odd = t.region.select(F.concat(F.lit("not_an_id_"), F.col("r_name"), F.lit("_x_y")).alias("variant_id"))
    return t.patient_sites.select("variant_id").unionByName(odd)


@query("s12_wide_table_probe", _WIDE)
def _(t: Tables):
    return predictors.probe_wide_slices(t.spark, wide_table_slices(t), _wanted(t)).drop("src_ord")


@query("s12_bucketed_stage_probe", _WIDE)
def _(t: Tables):
    target, table = scratch_path(t.spark, "predictors"), None
    for path in wide_table_slices(t):
        table = predictors.stage_wide_table(t.spark, path, target, buckets=8, append=table is not None)
    return predictors.probe_staged_table(table, _wanted(t)).drop("src_ord")


@query(
    "j10_needed_keys",
    """SELECT DISTINCT variant_id, replace(variant_id, '_', chr(9)) AS key FROM (SELECT variant_id FROM @patient_sites@
        UNION ALL SELECT variant_id FROM @deletions@) WHERE len(string_split(variant_id, '_')) = 4""",
)
def _(t: Tables):
    ids = t.patient_sites.select("variant_id").unionByName(t.deletions.select("variant_id"))
    return predictors.needed_keys(ids).select("variant_id", F.col("_key").alias("key"))


@query("s13_stage_table", "SELECT * EXCLUDE (src_ord) FROM @sites@")
def _(t: Tables):
    path = scratch_path(t.spark, "stage")
    sinks.write_stage(sites(t).drop("src_ord"), path, ["chromosome"])
    return tables.read_stage(t.spark, path, "clinvar_clean")


@query(
    "s14_csv_sink",
    """SELECT gene_symbol, round(oe_lof, 9) AS oe_lof, round(oe_lof_lower, 9) AS oe_lof_lower, round(oe_lof_upper, 9) AS oe_lof_upper, oe_lof_upper_rank, round("pLI", 9) AS "pLI" FROM @constraint_table@""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(constraint(t).drop("src_ord"), path)
    return tables.read_stage(t.spark, path, "constraint", form="csv")


@query(
    "s15_json_sink",
    """SELECT patient_id, variant_id, score, is_causal, score IS NULL AS has_null FROM @candidates@""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "json")
    rows = t.candidates.select("patient_id", "variant_id", F.coalesce("score", F.lit(float("nan"))).alias("score"), "is_causal")
    sinks.write_json(rows, path)
    lines = t.spark.read.text(path)
    record = F.from_json("value", "patient_id bigint, variant_id string, score double, is_causal bigint")
    return lines.select(record.alias("r"), F.contains("value", F.lit(":null")).alias("has_null")).select("r.*", "has_null")


@query("t1_arriving_patient_files", _PATIENT_SITES)
def _(t: Tables):
    """The patient files arrive as a stream; every batch is parsed and written once."""
    out, state = scratch_path(t.spark, "arrived"), scratch_path(t.spark, "arrivals")
    lines = arriving_lines(t.spark, patient_site_path(t), files_per_batch=100)
    analyze_arrivals(lines, lambda batch: vcf.parse_patient_sites(batch).drop("src_ord"), out, state).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


# --- cleaners from raw columns ---------------------------------------------------------------


@query("e5_clean_sites", "SELECT * EXCLUDE (src_ord) FROM @sites@")
def _(t: Tables):
    return sites(t).drop("src_ord")


@query(
    "e5_clean_annotations",
    "SELECT disease_id, disease_name, hpo_id, frequency, round(frequency_numeric, 9) AS frequency_numeric, onset, qualifier, is_negated, aspect FROM @annotations@",
)
def _(t: Tables):
    return clean.clean_annotations(t.annotations_raw).drop("src_ord")


@query(
    "e5_clean_dosage",
    """SELECT gene_symbol, haploinsufficiency_label, haploinsufficiency_score, triplosensitivity_label, triplosensitivity_score FROM @dosage@""",
)
def _(t: Tables):
    return clean.clean_dosage(t.dosage_raw).drop("src_ord")


@query(
    "e5_keep_first_by_source_order",
    """SELECT database_id, hpo_id, arg_min(frequency, src_ord) FILTER (true) AS frequency FROM (
        SELECT database_id, hpo_id, src_ord, coalesce(frequency, 'none') AS frequency FROM @annotations_raw@) GROUP BY ALL""",
)
def _(t: Tables):
    filled = t.annotations_raw.withColumn("frequency", F.coalesce("frequency", F.lit("none")))
    return first_per_key(filled, ["database_id", "hpo_id"], ["src_ord"]).select("database_id", "hpo_id", "frequency")
