"""Column functions and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.catalog.oracles import STANDARD, entry_columns, frequency, label_score, negated, simplified, unit
from lociq.catalog.registry import Tables, query
from lociq.catalog.relational import deletion_features, site_features
from lociq.functions import clinical, text, variants
from lociq.functions.hashing import unit_hash
from lociq.operators import model, phenotype, profile
from lociq.plans import clean, cohort
from lociq.schemas import PREDICTORS


def _info(t: Tables):
    """INFO-like text with flags, a repeated key and an ``=`` inside a value."""
    return t.events.select(
        "event_id",
        F.concat_ws(
            ";",
            F.lit("FLAG"),
            F.concat(F.lit("TYPE="), F.col("event_type")),
            F.concat(F.lit("EXPR=a="), F.col("user_id").cast("string")),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("TYPE=again"), F.col("user_id").cast("string"))),
            F.when(F.col("event_id") % 4 == 0, F.lit("EMPTY=")),
            F.lit("XTYPE=no"),
        ).alias("info"),
    )


@query(
    "x1_info_fields",
    """SELECT event_id,
        CASE WHEN event_id % 3 = 0 THEN 'again' || user_id ELSE event_type END AS type_value,
        'a=' || user_id AS expr_value,
        CASE WHEN event_id % 4 = 0 THEN '' END AS empty_value,
        CAST(NULL AS VARCHAR) AS absent_value,
        CASE WHEN event_id % 4 = 0 THEN 'EMPTY,EXPR,TYPE,XTYPE' ELSE 'EXPR,TYPE,XTYPE' END AS map_keys,
        CASE WHEN event_id % 3 = 0 THEN 'again' || user_id ELSE event_type END AS map_type
       FROM events""",
)
def _(t: Tables):
    info = F.col("info")
    parsed = text.info_map(info)
    return _info(t).select(
        "event_id",
        text.info_value(info, "TYPE").alias("type_value"),
        text.info_value(info, "EXPR").alias("expr_value"),
        text.info_value(info, "EMPTY").alias("empty_value"),
        text.info_value(info, "FLAG").alias("absent_value"),
        F.array_join(F.array_sort(F.map_keys(parsed)), ",").alias("map_keys"),
        F.try_element_at(parsed, F.lit("TYPE")).alias("map_type"),
    )


@query(
    "x2_annotation_attributes",
    """SELECT p_partkey, 'ENSG' || p_partkey AS gene_id,
        CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS gene_name, p_type AS gene_biotype FROM part""",
)
def _(t: Tables):
    attributes = F.concat(
        F.lit('gene_id "ENSG'),
        F.col("p_partkey").cast("string"),
        F.lit('"; gene_version "5"; '),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('gene_name "'), F.col("p_name"), F.lit('"; '))),
        F.lit('gene_biotype "'),
        F.col("p_type"),
        F.lit('";'),
    )
    return t.part.select("p_partkey", attributes.alias("a")).select(
        "p_partkey", *[text.attribute_value(F.col("a"), k).alias(k) for k in ("gene_id", "gene_name", "gene_biotype")]
    )


@query(
    "x3_gene_symbol_list",
    """SELECT src_ord, coalesce(array_to_string([string_split(x, ':')[1] for x in string_split(gene_info_raw, '|')], ','), '') AS symbols,
        coalesce(len(string_split(gene_info_raw, '|')), 0) > 1 AS has_multiple_genes FROM @sites_raw@""",
)
def _(t: Tables):
    symbols = clinical.gene_symbols(F.col("gene_info_raw"))
    return t.sites_raw.select(
        "src_ord", F.array_join(symbols, ",").alias("symbols"), (F.size(symbols) > 1).alias("has_multiple_genes")
    )


@query(
    "x4_explode_genes",
    """SELECT src_ord, gene_symbol FROM (SELECT src_ord, unnest([string_split(x, ':')[1] for x in string_split(gene_info_raw, '|')]) AS gene_symbol
        FROM @sites_raw@) WHERE gene_symbol <> ''""",
)
def _(t: Tables):
    listed = t.sites_raw.select("src_ord", F.explode(clinical.gene_symbols(F.col("gene_info_raw"))).alias("gene_symbol"))
    return listed.filter(F.col("gene_symbol") != "")


@query("x5_significance", f"SELECT src_ord, {simplified('clinvar_significance_raw')} AS clinvar_significance FROM @sites_raw@")
def _(t: Tables):
    raw = F.col("clinvar_significance_raw")
    return t.sites_raw.select("src_ord", clinical.simplify_significance(raw).alias("clinvar_significance"))


@query(
    "x6_variant_identity",
    """SELECT src_ord, concat(chromosome, '_', position, '_', reference_allele, '_', alternate_allele) AS variant_id FROM @sites_raw@""",
)
def _(t: Tables):
    parts = [F.col(c) for c in ("chromosome", "position", "reference_allele", "alternate_allele")]
    return t.sites_raw.select("src_ord", variants.identity(*parts).alias("variant_id"))


@query(
    "x7_strip_chromosome_prefix",
    "SELECT src_ord, chromosome AS raw, CASE WHEN chromosome LIKE 'chr%' THEN substr(chromosome, 4) ELSE chromosome END AS chromosome FROM @structural_raw@",
)
def _(t: Tables):
    return t.structural_raw.select(
        "src_ord", F.col("chromosome").alias("raw"), variants.strip_chr(F.col("chromosome")).alias("chromosome")
    )


@query("x8_frequency", f"SELECT src_ord, hpo_id, frequency, round({frequency('frequency')}, 9) AS frequency_numeric FROM @annotations_raw@")
def _(t: Tables):
    return t.annotations_raw.select(
        "src_ord", "hpo_id", "frequency", clinical.parse_frequency(F.col("frequency")).alias("frequency_numeric")
    )


@query("x9_negation", f"SELECT src_ord, hpo_id, {negated('qualifier')} AS is_negated FROM @annotations_raw@")
def _(t: Tables):
    return t.annotations_raw.select("src_ord", "hpo_id", clinical.is_negated(F.col("qualifier")).alias("is_negated"))


@query("x10_disease_entry", f"SELECT src_ord, {entry_columns('phenotype_raw')} FROM @morbid_raw@ WHERE phenotype_raw IS NOT NULL")
def _(t: Tables):
    kept = t.morbid_raw.filter(F.col("phenotype_raw").isNotNull())
    return kept.select("src_ord", clinical.disease_entry(F.col("phenotype_raw")).alias("d")).select("src_ord", "d.*")


@query(
    "x11_expand_phenotypes",
    "SELECT gene_symbol, mim_number, disease_name, phenotype_mim_number, mapping_key, phenotype_type, inheritance_modes FROM @gene_diseases@",
)
def _(t: Tables):
    return clean.expand_gene_diseases(t.gene_map_raw).drop("src_ord")


@query(
    "x12_morbid_map",
    f"""SELECT trim(string_split(gene_symbols_raw, ',')[1]) AS gene_symbol, gene_mim_number, {entry_columns('phenotype_raw')},
        cyto_location, src_ord FROM @morbid_raw@ WHERE gene_symbols_raw IS NOT NULL AND trim(phenotype_raw) <> ''""",
)
def _(t: Tables):
    return clean.clean_morbid_map(t.morbid_raw)


@query(
    "x13_titles",
    """SELECT mim_number, prefix, trim(string_split(preferred_title_raw, ';')[1]) AS preferred_disease_name,
        CASE WHEN contains(preferred_title_raw, ';')
             THEN trim(substr(preferred_title_raw, strpos(preferred_title_raw, ';') + 1)) END AS preferred_symbol
        FROM @mim_titles_raw@""",
)
def _(t: Tables):
    return clean.clean_mim_titles(t.mim_titles_raw).drop("src_ord")


@query(
    "x14_dosage_scores",
    f"""SELECT src_ord, ({label_score('haploinsufficiency')})::BIGINT AS haplo, ({label_score('triplosensitivity')})::BIGINT AS triplo FROM @dosage_raw@""",
)
def _(t: Tables):
    return t.dosage_raw.select(
        "src_ord",
        clinical.dosage_score(F.col("HAPLOINSUFFICIENCY"), "Haploinsufficiency").alias("haplo"),
        clinical.dosage_score(F.col("TRIPLOSENSITIVITY"), "Triplosensitivity").alias("triplo"),
    )


@query(
    "x15_multi_value_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE l_linenumber % 4 WHEN 0 THEN l_tax WHEN 1 THEN least(l_discount, l_tax) WHEN 2 THEN NULL ELSE l_discount END AS score
        FROM lineitem""",
)
def _(t: Tables):
    d, x = F.col("l_discount").cast("string"), F.col("l_tax").cast("string")
    raw = (
        F.when(F.col("l_linenumber") % 4 == 0, x)
        .when(F.col("l_linenumber") % 4 == 1, F.concat_ws(";", d, F.lit("."), x))
        .when(F.col("l_linenumber") % 4 == 2, F.lit(".;5d;nan"))
        .otherwise(F.concat_ws(";", F.lit("x"), d))
    )
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", variants.lowest_score(raw).alias("score")
    )


_GT = "CASE event_id % 7 WHEN 0 THEN '0/1' WHEN 1 THEN '1|1' WHEN 2 THEN './.' WHEN 3 THEN '0/0' WHEN 4 THEN '2/2' WHEN 5 THEN '1' END"


@query(
    "x16_zygosity",
    f"""SELECT event_id, CASE WHEN event_id % 7 IN (1, 2, 4) THEN 'homozygous' ELSE 'heterozygous' END AS zygosity,
        CASE WHEN event_id % 7 IN (1, 4) THEN 'homozygous' WHEN event_id % 7 IN (0, 3, 5) THEN 'heterozygous' END AS strict_zygosity
        FROM (SELECT event_id, {_GT} AS gt FROM events)""",
)
def _(t: Tables):
    gt = F.expr(_GT)
    return t.events.select(
        "event_id",
        variants.zygosity_from_genotype(gt).alias("zygosity"),
        variants.zygosity_from_genotype(gt, strict=True).alias("strict_zygosity"),
    )


@query(
    "x17_genotype_field",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE NULL END AS gt FROM events""",
)
def _(t: Tables):
    form = F.expr("case event_id % 4 when 0 then 'GT:DP' when 1 then 'DP:GT:GQ' when 2 then 'DP:GQ' else 'DP:GQ:GT' end")
    sample = F.expr("case event_id % 4 when 1 then concat('12:', event_type, ':9') else concat(event_type, ':12') end")
    return t.events.select("event_id", text.genotype(form, sample).alias("gt"))


_MODES = "CASE l_linenumber WHEN 1 THEN 'Autosomal recessive;Autosomal dominant' WHEN 2 THEN 'Autosomal dominant' WHEN 3 THEN 'X-linked' WHEN 4 THEN 'Mitochondrial' WHEN 5 THEN 'X-linked recessive' END"


@query(
    "x18_causal_zygosity",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 5) THEN 'homozygous' WHEN l_linenumber = 2 THEN 'heterozygous'
        WHEN l_linenumber = 3 THEN CASE ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 13))::BIGINT % 2 WHEN 0 THEN 'hemizygous' ELSE 'heterozygous' END
        ELSE CASE ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 13))::BIGINT % 2 WHEN 0 THEN 'heterozygous' ELSE 'homozygous' END END AS zygosity
        FROM lineitem""",
)
def _(t: Tables):
    zygosity = variants.zygosity_from_inheritance(F.expr(_MODES), 42, F.col("l_orderkey"), F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", zygosity.alias("zygosity"))


@query(
    "x19_background_zygosity",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 5) THEN 'heterozygous'
        ELSE CASE ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 13))::BIGINT % 2 WHEN 0 THEN 'homozygous' ELSE 'heterozygous' END END AS zygosity
        FROM lineitem""",
)
def _(t: Tables):
    zygosity = variants.background_zygosity(F.expr(_MODES), 42, F.col("l_orderkey"), F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", zygosity.alias("zygosity"))


@query(
    "x20_disease_id",
    """SELECT o_orderkey, 'OMIM:' || (100000 + o_orderkey) AS from_text, 'OMIM:' || (100000 + o_orderkey) AS from_float,
        CAST(NULL AS VARCHAR) AS from_bad FROM orders""",
)
def _(t: Tables):
    number = F.col("o_orderkey") + 100000
    return t.orders.select(
        "o_orderkey",
        clinical.disease_id(number.cast("string")).alias("from_text"),
        clinical.disease_id(number.cast("double")).alias("from_float"),
        clinical.disease_id(F.concat(F.lit("no"), number.cast("string"))).alias("from_bad"),
    )


@query(
    "x21_symptom_list",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 'HP:' || o_custkey ELSE 'HP:' || o_custkey || '|HP:' || o_orderkey END AS symptoms FROM orders""",
)
def _(t: Tables):
    raw = F.expr(
        """case o_orderkey % 3 when 0 then concat('["HP:', o_custkey, '", "HP:', o_orderkey, '"]')
           when 1 then concat('"HP:', o_custkey, '"') else concat(' HP:', o_custkey, ', ,HP:', o_orderkey) end"""
    )
    return t.orders.select("o_orderkey", F.array_join(text.parse_symptom_list(raw), "|").alias("symptoms"))


@query(
    "x22_overlap_arithmetic",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_orderkey, l_partkey + 40) - greatest(l_suppkey, l_partkey) AS overlap_length,
        CASE WHEN l_partkey - l_suppkey > 0 THEN round((least(l_orderkey, l_partkey + 40) - greatest(l_suppkey, l_partkey)) / (l_partkey - l_suppkey), 9) END AS fraction,
        abs(l_suppkey - l_partkey) AS size FROM lineitem""",
)
def _(t: Tables):
    shared = variants.overlap_length(F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_partkey") + 40)
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        shared.alias("overlap_length"),
        variants.ratio_if_positive(shared, F.col("l_partkey") - F.col("l_suppkey")).alias("fraction"),
        F.abs(F.col("l_suppkey") - F.col("l_partkey")).alias("size"),
    )


@query(
    "x23_evidence_format",
    "SELECT o_orderkey, o_orderpriority || '=' || printf('%.3f', o_totalprice) AS evidence FROM orders",
)
def _(t: Tables):
    return t.orders.select(
        "o_orderkey", variants.format_evidence(F.col("o_orderpriority"), F.col("o_totalprice")).alias("evidence")
    )


@query("p1_select_rename", """SELECT gene AS gene_symbol, round("pLI", 9) AS "pLI", round(oe_lof, 9) AS oe_lof FROM @constraint_raw@""")
def _(t: Tables):
    return t.constraint_raw.select(F.col("gene").alias("gene_symbol"), "pLI", "oe_lof")


@query("p2_drop_missing_keys", "SELECT * EXCLUDE (src_ord) FROM @mim_genes_raw@ WHERE gene_symbol IS NOT NULL")
def _(t: Tables):
    return clean.clean_mim_genes(t.mim_genes_raw).drop("src_ord")


@query("p3_standard_chromosomes", f"SELECT * FROM @genes_raw@ WHERE gene_symbol IS NOT NULL AND chromosome IN {STANDARD}")
def _(t: Tables):
    return clean.clean_genes(t.genes_raw)


@query(
    "p3_dropped_gene_counts",
    f"""SELECT count(*) FILTER (gene_symbol IS NULL) AS dropped_no_symbol,
        count(*) FILTER (gene_symbol IS NOT NULL AND chromosome NOT IN {STANDARD}) AS dropped_alt_contigs,
        count(*) FILTER (gene_symbol IS NOT NULL AND chromosome IN {STANDARD}) AS kept FROM @genes_raw@""",
)
def _(t: Tables):
    return profile.dropped_gene_rows(t.genes_raw)


@query(
    "p4_junk_separator_rows",
    """SELECT src_ord, coalesce(regexp_full_match("GENE SYMBOL", '\\++'), false) OR coalesce(regexp_full_match(haploinsufficiency, '\\++'), false)
        OR coalesce(regexp_full_match(triplosensitivity, '\\++'), false) AS is_junk FROM @dosage_raw@""",
)
def _(t: Tables):
    junk = clinical.is_junk_label(F.col("`GENE SYMBOL`"), F.col("HAPLOINSUFFICIENCY"), F.col("TRIPLOSENSITIVITY"))
    return t.dosage_raw.select("src_ord", junk.alias("is_junk"))


@query("p5_passing_deletions", "SELECT * FROM @population_ided@")
def _(t: Tables):
    return clean.clean_population_deletions(t.structural_raw)


@query(
    "p5_dropped_deletion_counts",
    """SELECT 'dropped_low_quality' AS measure, count(*) AS rows FROM @structural_raw@ WHERE sv_type_raw = 'DEL' AND variant_filter <> 'PASS'
       UNION ALL SELECT 'missing_end_position', count(*) FROM @population@ WHERE end_position IS NULL
       UNION ALL SELECT 'missing_allele_frequency', count(*) FROM @population@ WHERE allele_frequency IS NULL
       UNION ALL SELECT 'missing_deletion_size', count(*) FROM @population@ WHERE deletion_size IS NULL""",
)
def _(t: Tables):
    return profile.dropped_deletion_rows(t.structural_raw, clean.clean_population_deletions(t.structural_raw))


@query("p6_usable_annotations", "SELECT disease_id, hpo_id, src_ord FROM @usable@")
def _(t: Tables):
    usable = phenotype.usable_annotations(clean.clean_annotations(t.annotations_raw))
    return usable.select("disease_id", "hpo_id", "src_ord")


_PAIRS = "phenotype_type IN ('confirmed_mendelian', 'unconfirmed_mendelian')"


@query(
    "p7_eligible_sites",
    f"""SELECT variant_id, gene_symbol, disease_name, phenotype_mim_number FROM @site_features@
        WHERE clinvar_significance IN ('Pathogenic', 'Likely_pathogenic') AND disease_name IS NOT NULL AND {_PAIRS}""",
)
def _(t: Tables):

    eligible = cohort.eligible_sites(site_features(t))
    return eligible.select("variant_id", "gene_symbol", "disease_name", "phenotype_mim_number")


@query(
    "p8_eligible_deletions",
    f"""SELECT variant_id, gene_symbol, haploinsufficiency_score FROM (SELECT *, row_number() OVER (PARTITION BY variant_id
        ORDER BY haploinsufficiency_score DESC NULLS LAST, gene_symbol, disease_name) AS rn FROM @deletion_features@
        WHERE disease_name IS NOT NULL AND {_PAIRS} AND haploinsufficiency_score IS NOT NULL) WHERE rn = 1""",
)
def _(t: Tables):

    eligible = cohort.eligible_deletions(deletion_features(t))
    return eligible.select("variant_id", "gene_symbol", "haploinsufficiency_score")


@query(
    "p9_candidate_pools",
    """SELECT 'general' AS pool, variant_id, gene_symbol FROM @sites@ WHERE clinvar_significance IN ('Benign', 'Likely_benign', 'Uncertain_significance')
       UNION ALL SELECT 'uncertain', variant_id, gene_symbol FROM @sites@ WHERE clinvar_significance IN ('Uncertain_significance', 'Conflicting')
       UNION ALL SELECT 'pathogenic', variant_id, gene_symbol FROM @sites@ WHERE clinvar_significance IN ('Pathogenic', 'Likely_pathogenic')""",
)
def _(t: Tables):
    out = None
    for name, pool in cohort.candidate_pools(clean.clean_sites(t.sites_raw)).items():
        tagged = pool.select(F.lit(name).alias("pool"), "variant_id", "gene_symbol")
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query(
    "p10_lenient_and_strict_casts",
    """SELECT src_ord, try_cast(allele_frequency_raw AS DOUBLE) AS lenient, try_cast(end_position_raw AS BIGINT) AS strict
        FROM @structural_raw@ WHERE end_position_raw IS NOT NULL""",
)
def _(t: Tables):
    strict = text.parse_long(F.col("end_position_raw"))
    cast = t.structural_raw.select(
        "src_ord", text.parse_double(F.col("allele_frequency_raw")).alias("lenient"), strict.alias("strict")
    )
    return cast.filter(F.col("strict").isNotNull())


@query(
    "p11_scoring_defaults",
    """SELECT src_ord, CASE WHEN genotype_raw = '1|1' THEN 'homozygous' ELSE 'heterozygous' END AS zygosity, 50 AS simulated_read_depth,
        60 AS simulated_genotype_quality, coalesce(nullif(filter_status, 'view'), 'PASS') AS simulated_filter_status,
        coalesce(nullif(allele_frequency, 0e0), 1e-4) AS allele_frequency FROM @deletions@""",
)
def _(t: Tables):
    gaps = t.deletions.withColumns(
        {
            "filter_status": F.nullif("filter_status", F.lit("view")),
            "allele_frequency": F.nullif("allele_frequency", F.lit(0.0)),
        }
    )
    return model.prepare_deletions(gaps).select(
        "src_ord", "zygosity", "simulated_read_depth", "simulated_genotype_quality", "simulated_filter_status",
        "allele_frequency",
    )


@query(
    "p11_absent_predictor_columns",
    f"SELECT patient_id, variant_id, {', '.join(f'NULL::VARCHAR AS absent_{c}' for c in PREDICTORS)} FROM @patient_sites@",
)
def _(t: Tables):
    bare = t.patient_sites.withColumns({"filter_status": F.lit("PASS"), "genotype_raw": F.lit("0/1")})
    ready = model.prepare_sites(bare)
    return ready.select("patient_id", "variant_id", *[F.col(c).alias(f"absent_{c}") for c in PREDICTORS])


@query(
    "p12_feature_selection",
    "SELECT genotype_raw AS zygosity, allele_frequency, src_ord FROM @deletions@",
)
def _(t: Tables):
    wide = t.deletions.select(
        "patient_id", "variant_id", "chromosome", F.lit(0).alias("is_hard_negative"), F.lit(1).alias("is_causal"),
        F.col("genotype_raw").alias("zygosity"), "allele_frequency", "src_ord",
    )
    return wide.select(*model.feature_columns(wide, model.CNV_DROP))


@query(
    "unit_hash_numbers",
    f"SELECT o_orderkey, round({unit(42, 'o_orderkey')}, 9) AS u FROM orders",
)
def _(t: Tables):
    return t.orders.select("o_orderkey", unit_hash(42, F.col("o_orderkey")).alias("u"))
