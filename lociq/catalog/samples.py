"""Seeded sampling, splitting and cohort building."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociq.catalog.oracles import number, order, unit
from lociq.catalog.registry import Tables, query
from lociq.catalog.relational import annotations, deletion_features, gene_diseases, genes, phenotype_inputs, population, sites
from lociq.functions.variants import zygosity_from_genotype
from lociq.operators import phenotype, profile, sampling
from lociq.operators.intervals import gene_overlaps
from lociq.operators.joins import lookup_join
from lociq.operators.ranking import first_per_key, top_per_key
from lociq.plans import cohort
from lociq.session import staged

_SEED = 42
_LABELLED = ["patient_id", "variant_id", "gene_symbol", "is_causal", "is_hard_negative"]


@query(
    "top_candidate_per_patient",
    """SELECT patient_id, variant_id, gene_symbol, round(score, 9) AS phenotype_similarity_score, disease_id AS best_matching_disease_id FROM (
        SELECT c.patient_id, c.variant_id, c.gene_symbol, coalesce(s.score, 0e0) AS score, s.disease_id,
          row_number() OVER (PARTITION BY c.patient_id ORDER BY coalesce(s.score, 0e0) DESC, c.variant_id) AS rn
        FROM @candidates@ c LEFT JOIN @candidate_scores@ s ON s.patient_id = c.patient_id AND s.gene_symbol = c.gene_symbol) WHERE rn = 1""",
)
def _(t: Tables):
    scored = phenotype.with_phenotype_scores(t.candidates, *phenotype_inputs(t))
    best = first_per_key(scored, ["patient_id"], [F.desc("phenotype_similarity_score"), F.asc("variant_id")])
    return best.select("patient_id", "variant_id", "gene_symbol", "phenotype_similarity_score", "best_matching_disease_id")


@query("m1_capped_group_sample", f"""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey
        ORDER BY {order(9, "l_orderkey || '|' || l_linenumber || '|' || l_partkey")}, l_orderkey, l_linenumber, l_partkey) AS nth FROM lineitem),
        c AS (SELECT * FROM r WHERE nth <= 5),
        s AS (SELECT l_suppkey, sum(n) OVER (ORDER BY {order(9, 'l_suppkey')}, l_suppkey) - n AS start FROM (SELECT l_suppkey, count(*) AS n FROM c GROUP BY 1))
        SELECT c.l_suppkey, c.l_orderkey, c.l_linenumber, c.l_partkey FROM c JOIN s ON s.l_suppkey = c.l_suppkey WHERE s.start + c.nth <= 237""")
def _(t: Tables):
    out = sampling.capped_sample(t.lineitem, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], 237, 5, 9)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


def _sick(t: Tables) -> DataFrame:
    """One made-up patient per customer."""
    return t.customer.select(
        F.col("c_custkey").alias("patient_id"),
        F.concat(F.lit("OMIM:"), (F.col("c_custkey") + 100000).cast("string")).alias("disease_id"),
        F.concat(F.lit("G"), F.col("c_custkey").cast("string")).alias("causal_gene"),
        F.concat(F.lit("V"), F.col("c_custkey").cast("string")).alias("causal_variant_id"),
        (F.lit(0.4) + (F.col("c_custkey") % 5) / F.lit(10.0)).alias("keep_fraction"),
        (F.col("c_custkey") % 4).alias("n_noise"),
    )


_SICK = """(SELECT c_custkey AS patient_id, 'OMIM:' || (c_custkey + 100000) AS disease_id, 'G' || c_custkey AS causal_gene, 'V' || c_custkey AS causal_variant_id,
        4e-1 + (c_custkey % 5) / 1e1 AS keep_fraction, c_custkey % 4 AS n_noise FROM customer)"""


@query(
    "m2_weighted_symptom_sample",
    f"""WITH listed AS (SELECT disease_id, hpo_id, arg_min(coalesce(frequency_numeric, 3e-1), src_ord) + 1e-2 AS w FROM @usable@ GROUP BY ALL),
        keyed AS (SELECT p.patient_id, l.hpo_id, p.keep_fraction, count(*) OVER (PARTITION BY p.patient_id) AS n,
            row_number() OVER (PARTITION BY p.patient_id ORDER BY -ln(1e0 - {unit(_SEED, "'symptom|' || p.patient_id || '|' || l.hpo_id")}) / l.w, l.hpo_id) AS rn
          FROM {_SICK} p JOIN listed l ON l.disease_id = p.disease_id)
        SELECT patient_id, hpo_id FROM keyed WHERE rn <= greatest(1, floor(n * keep_fraction))""",
)
def _(t: Tables):
    usable = phenotype.usable_annotations(annotations(t))
    return sampling.weighted_symptoms(_sick(t), usable, _SEED)


def _drawn(pool: str, keys: list[str], tag: str, count: str) -> str:
    """Numbered pool, its size, and the draws of every patient."""
    text = " || '|' || ".join(keys)
    return f"""pool AS (SELECT *, row_number() OVER (ORDER BY {order(_SEED, text)}, {', '.join(keys)}) - 1 AS nth FROM {pool}),
        size AS (SELECT count(*) AS size FROM pool),
        asked AS (SELECT p.*, k AS draw, ({number(_SEED, f"'{tag}|' || p.patient_id")}
                  + k * {sampling.STEPS}[1 + {number(_SEED, f"'step|{tag}|' || p.patient_id")} % {len(sampling.STEPS)}]) % size AS nth
                  FROM {_SICK} p, size, range(0, 200) r(k) WHERE k < least({count}, size))"""


@query(
    "m3_noise_symptoms",
    f"""WITH {_drawn("(SELECT * FROM @annotations@ WHERE aspect = 'P')", ["src_ord", "disease_id", "hpo_id"], "noise", "n_noise")}
        SELECT DISTINCT a.patient_id, p.hpo_id FROM asked a JOIN pool p ON p.nth = a.nth""",
)
def _(t: Tables):
    pool = annotations(t).filter(F.col("aspect") == "P")
    return sampling.noise_symptoms(_sick(t), pool, _SEED, ["src_ord", "disease_id", "hpo_id"])


def _foreign_sql(pool: str, tag: str, n: int) -> str:
    gene = "coalesce('=' || gene_symbol, '')"
    return f"""WITH pool AS (SELECT *, {gene} AS gene, row_number() OVER (ORDER BY {gene}, {order(_SEED, "variant_id || '|' || gene_symbol")}, variant_id, gene_symbol) - 1 AS nth FROM {pool}),
        blocks AS (SELECT gene, min(nth) AS start, count(*) AS length FROM pool GROUP BY 1),
        listed AS (SELECT variant_id, count(*) AS listed FROM pool GROUP BY 1),
        asked AS (SELECT a.*, coalesce(b.start, 0) AS start, coalesce(b.length, 0) AS length, (SELECT count(*) FROM pool) - coalesce(b.length, 0) AS places,
            {n} + coalesce(l.listed, 0) AS wanted FROM {_SICK} a LEFT JOIN blocks b ON b.gene = coalesce('=' || a.causal_gene, '')
            LEFT JOIN listed l ON l.variant_id IS NOT DISTINCT FROM a.causal_variant_id),
        dealt AS (SELECT *, unnest(range(0, least(wanted, places)::BIGINT)) AS draw FROM asked WHERE places > 0),
        drawn AS (SELECT *, ({number(_SEED, f"'{tag}|' || patient_id")} + draw * {sampling.STEPS}[1 + {number(_SEED, f"'step|{tag}|' || patient_id")} % {len(sampling.STEPS)}]) % places AS i FROM dealt)
        SELECT patient_id, variant_id, gene_symbol, place FROM (SELECT d.patient_id, p.variant_id, p.gene_symbol,
          row_number() OVER (PARTITION BY d.patient_id ORDER BY d.draw) AS place FROM drawn d
          JOIN pool p ON p.nth = CASE WHEN d.i < d.start THEN d.i ELSE d.i + d.length END
          WHERE p.variant_id IS DISTINCT FROM d.causal_variant_id) WHERE place <= {n}"""


@query(
    "m4_hard_negative_draws",
    _foreign_sql("(SELECT variant_id, gene_symbol FROM @sites@ WHERE clinvar_significance IN ('Uncertain_significance', 'Conflicting'))", "uncertain", 3),
)
def _(t: Tables):
    pool = cohort.candidate_pools(sites(t))["uncertain"].select("variant_id", "gene_symbol")
    out = sampling.foreign_draws(_sick(t), pool, ["variant_id", "gene_symbol"], 3, _SEED, "uncertain")
    return out.withColumnRenamed("_place", "place")


@query(
    "m5_genic_background_draws",
    _foreign_sql("(SELECT variant_id, min(gene_symbol) AS gene_symbol FROM @population_overlaps@ WHERE variant_id IS NOT NULL GROUP BY 1)", "genic", 30),
)
def _(t: Tables):
    pairs = gene_overlaps(population(t), genes(t))
    pool = first_per_key(pairs, ["variant_id"], [F.asc("gene_symbol")]).select("variant_id", "gene_symbol")
    out = sampling.foreign_draws(_sick(t), pool, ["variant_id", "gene_symbol"], 30, _SEED, "genic")
    return out.withColumnRenamed("_place", "place")


@query(
    "m6_tier_assignment",
    f"""SELECT c_custkey, CASE WHEN u < 3e-1 THEN 'well_phenotyped' WHEN u < 7e-1 THEN 'moderately_phenotyped' ELSE 'poorly_phenotyped' END AS tier
        FROM (SELECT c_custkey, {unit(_SEED, "'tier|' || c_custkey")} AS u FROM customer)""",
)
def _(t: Tables):
    return t.customer.select("c_custkey", sampling.assign_tier(_SEED, F.lit("tier"), F.col("c_custkey")).alias("tier"))


_TEST_GROUPS = f"""SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (ORDER BY {order(_SEED, 'o_custkey')}, o_custkey) AS nth,
        count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE nth <= ceil(2e-1 * n)"""


@query(
    "m7_split_by_patient",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN ({_TEST_GROUPS}) THEN 'test' ELSE 'train' END AS side FROM orders""",
)
def _(t: Tables):
    train, test = sampling.group_split(t.orders, "o_custkey", 0.2, _SEED)
    sides = [d.select("o_orderkey", "o_custkey", F.lit(n).alias("side")) for d, n in ((train, "train"), (test, "test"))]
    return sides[0].unionByName(sides[1])


@query(
    "j15_phenocopy_variants",
    f"""WITH pairs AS (SELECT DISTINCT disease_id, hpo_id FROM @usable@),
        alike AS (SELECT a.disease_id, b.disease_id AS other_id FROM pairs a JOIN pairs b ON a.hpo_id = b.hpo_id AND a.disease_id <> b.disease_id
            WHERE a.disease_id IN (SELECT disease_id FROM {_SICK}) GROUP BY ALL HAVING count(*) >= 2),
        chosen AS (SELECT p.patient_id, p.causal_gene, p.causal_variant_id, arg_min(s.other_id, {order(_SEED, "'similar|' || p.patient_id || '|' || s.other_id")}) AS other_id
            FROM {_SICK} p JOIN alike s ON s.disease_id = p.disease_id GROUP BY ALL),
        genes_of AS (SELECT DISTINCT 'OMIM:' || phenotype_mim_number::BIGINT AS other_id, gene_symbol FROM @gene_diseases@
            WHERE phenotype_mim_number IS NOT NULL AND gene_symbol IN (SELECT gene_symbol FROM @sites@)),
        one_gene AS (SELECT * FROM (SELECT c.*, g.gene_symbol, row_number() OVER (PARTITION BY c.patient_id
            ORDER BY {order(_SEED, "c.patient_id || '|' || g.gene_symbol")}, g.gene_symbol) AS rn FROM chosen c JOIN genes_of g ON g.other_id = c.other_id
            WHERE g.gene_symbol <> c.causal_gene) WHERE rn = 1),
        variants AS (SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY {order(_SEED, 'variant_id')}, variant_id) AS nth,
            count(*) OVER (PARTITION BY gene_symbol) AS n FROM (SELECT DISTINCT variant_id, gene_symbol FROM @sites@))
        SELECT o.patient_id, v.variant_id, o.gene_symbol FROM one_gene o JOIN variants v ON v.gene_symbol = o.gene_symbol
            AND v.nth = {number(_SEED, "'phenocopy|' || o.patient_id")} % v.n + 1 WHERE v.variant_id <> o.causal_variant_id""",
)
def _(t: Tables):
    return cohort.phenocopies(_sick(t), annotations(t), gene_diseases(t), sites(t), _SEED).drop("_place")


def labelled_site_rows(t: Tables) -> DataFrame:
    """Labelled point variants with each of their genes."""
    listed = sites(t).select("variant_id", "gene_symbol").distinct()
    rows = lookup_join(t.labelled_sites, listed, "variant_id", "inner")
    return rows.select(*_LABELLED, zygosity_from_genotype(F.col("genotype_raw")).alias("zygosity"))


def labelled_deletion_rows(t: Tables) -> DataFrame:
    """Labelled deletions with each gene they overlap."""
    rows = gene_overlaps(t.labelled_deletions, genes(t))
    return rows.select(*_LABELLED, zygosity_from_genotype(F.col("genotype_raw")).alias("zygosity"))


def site_cohort(t: Tables) -> DataFrame:
    return cohort.labelled_cohort(labelled_site_rows(t), cohort.BACKGROUND["snv"], _SEED)


def deletion_cohort(t: Tables) -> DataFrame:
    return cohort.labelled_cohort(labelled_deletion_rows(t), cohort.BACKGROUND["cnv"], _SEED)


def _patients_sql(rows: str) -> str:
    return f"""SELECT c.patient_id, n_causal, n_hard_negative, n_rows, phenotype_tier, coalesce(n_patient_symptoms, 0) AS n_patient_symptoms, patient_hpo_terms
        FROM (SELECT patient_id, sum(is_causal)::BIGINT AS n_causal, sum(is_hard_negative)::BIGINT AS n_hard_negative, count(*) AS n_rows FROM {rows} GROUP BY 1) c
        LEFT JOIN (SELECT patient_id, count(*) AS n_patient_symptoms, string_agg(hpo_id, ';' ORDER BY hpo_id) AS patient_hpo_terms FROM @symptoms@ GROUP BY 1) s USING (patient_id)
        LEFT JOIN @patient_tiers@ USING (patient_id)"""


_ROWS_SQL = "SELECT patient_id, variant_id, gene_symbol, is_causal, is_hard_negative, zygosity FROM"


@query("m8_site_cohort_patients", _patients_sql("@site_cohort@"))
def _(t: Tables):
    return cohort.cohort_patients(site_cohort(t), t.patient_symptoms, t.patient_tiers)


@query("m8_site_cohort_variants", f"{_ROWS_SQL} @site_cohort@")
def _(t: Tables):
    return site_cohort(t)


@query("m8_deletion_cohort_patients", _patients_sql("@deletion_cohort@"))
def _(t: Tables):
    return cohort.cohort_patients(deletion_cohort(t), t.patient_symptoms, t.patient_tiers)


@query("m8_deletion_cohort_variants", f"{_ROWS_SQL} @deletion_cohort@")
def _(t: Tables):
    return deletion_cohort(t)


@query(
    "m8_site_cohort_summary",
    f"""WITH r AS (FROM @site_cohort@), p AS ({_patients_sql("r")})
        SELECT unnest(['patients', 'patients_without_symptoms', 'variant_rows', 'hard_negatives', 'variants_per_patient']) AS measure, unnest([
          (SELECT count(*)::DOUBLE FROM p), (SELECT count(*) FILTER (n_patient_symptoms = 0)::DOUBLE FROM p), (SELECT count(*)::DOUBLE FROM r),
          (SELECT sum(is_hard_negative)::DOUBLE FROM r), (SELECT round(count(*) / count(DISTINCT patient_id), 9) FROM r)]) AS value""",
)
def _(t: Tables):
    rows = staged(site_cohort(t), "cohort")
    return profile.cohort_summary(cohort.cohort_patients(rows, t.patient_symptoms, t.patient_tiers), rows)


@query(
    "w7_top_candidates_in_order",
    f"""SELECT patient_id, variant_id, place FROM (SELECT patient_id, variant_id, row_number() OVER (PARTITION BY patient_id
        ORDER BY {order(_SEED, 'variant_id')}, variant_id) AS place FROM @candidates@) WHERE place <= 3""",
)
def _(t: Tables):
    order_by = [sampling.order_hash(_SEED, F.col("variant_id")), F.asc("variant_id")]
    return top_per_key(t.candidates, ["patient_id"], order_by, 3, rank="place").select("patient_id", "variant_id", "place")
