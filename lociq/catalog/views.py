"""Domain-shaped views of the given tables.

Every view maps all rows of one table.  The column expressions are written so that Spark and
a plain SQL engine read them the same way; only the views are shared, never the operators.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class View:
    table: str
    columns: list[str]
    where: str | None = None

    @property
    def sql(self) -> str:
        tail = f" WHERE {self.where}" if self.where else ""
        columns = ", ".join(self.columns).replace("`", '"')
        return f"SELECT {columns} FROM {self.table}{tail}"


def text(value: str) -> str:
    return f"cast({value} as string)"


def chromosome(key: str) -> str:
    return (
        f"case {key} % 25 when 22 then 'X' when 23 then 'Y' when 24 then 'MT' "
        f"else {text(f'{key} % 25 + 1')} end"
    )


def hpo(key: str) -> str:
    return f"concat('HP:', lpad({text(key)}, 7, '0'))"


def part_of(key: str, n: int) -> str:
    return f"cast(floor({key} / {n}) as bigint)"


SIGNIFICANCE = (
    "case {k} % 13 when 0 then 'Pathogenic' when 1 then 'Likely_pathogenic' "
    "when 2 then 'Pathogenic/Likely_pathogenic' when 3 then 'Benign' when 4 then 'Likely_benign' "
    "when 5 then 'Benign/Likely_benign' when 6 then 'Uncertain_significance' "
    "when 7 then 'Conflicting_classifications_of_pathogenicity' when 8 then 'risk_factor' "
    "when 9 then 'Likely_pathogenic|drug_response' when 10 then 'Pathogenic' "
    "when 11 then 'Uncertain_significance/Uncertain_risk_allele' end"
)
LABEL = (
    "case {k} % 10 when 0 then 'Sufficient Evidence for {w}' when 1 then 'Some Evidence for {w}' "
    "when 2 then 'Emerging Evidence for {w}' when 3 then 'Little Evidence for {w}' "
    "when 4 then 'No Evidence for {w}' when 5 then 'Dosage Sensitivity Unlikely for {w}' "
    "when 6 then 'Gene Associated with Autosomal Recessive Phenotype' when 7 then 'Not yet evaluated' "
    "when 8 then {odd} end"
)
_MIM = text("100000 + {k}")
_PHENOTYPES = (
    "case p_size % 7 "
    "when 0 then concat('{Trait ', {n}, ', susceptibility to}, ', {m}, ' (3), Autosomal dominant; ?Second ', {n}, ', ', {m2}, ' (2)') "
    "when 1 then concat('Disorder ', {n}, ', type 1, ', {m}, ' (3), Autosomal recessive, X-linked') "
    "when 2 then concat('[Level ', {n}, '], ', {m}, ' (1); ;Unnumbered entry ', {n}) "
    "when 3 then concat('?Doubtful ', {n}, ', ', {m}, ' (3), ?Autosomal dominant,  , Mitochondrial') "
    "when 4 then concat('Disorder ', {n}, ', ', {m}, ' (3), X-linked; Other ', {n}, ', ', {m2}, ' (3), Autosomal dominant') "
    "when 5 then concat('  {Loose ', {n}, '} ') end"
)


def _phenotypes() -> str:
    out = _PHENOTYPES.replace("{n}", text("p_partkey")).replace("{m2}", text("100000 + (p_partkey * 7) % 2000"))
    return out.replace("{m}", text("100000 + p_partkey"))


_DEL_START = "1000000 + 258 * event_id"
_DEL_END = f"{_DEL_START} + cast(floor(value * 100) as bigint)"
_SITE = "1000000 + 172 * {k}"

# Predictor columns from the measures of lineitem; none of them follows from a label.
_PREDICTOR_VALUES = {
    "SIFT_score": f"concat({text('l_discount')}, ';.;', {text('l_tax')})",
    "SIFT_converted_rankscore": text("l_tax"),
    "SIFT_pred": "case when l_quantity > 25 then 'D' else 'T' end",
    "Polyphen2_HDIV_score": f"case when l_linenumber = 3 then '.' else concat('.;', {text('l_quantity')}) end",
    "Polyphen2_HDIV_rankscore": text("l_discount"),
    "Polyphen2_HDIV_pred": "case l_linenumber when 1 then 'D' when 2 then 'P' when 3 then 'B' end",
    "Polyphen2_HVAR_score": f"concat({text('l_tax')}, ';', {text('l_quantity')}, ';x')",
    "Polyphen2_HVAR_rankscore": "case when l_partkey % 9 = 0 then null else " + text("l_quantity") + " end",
    "Polyphen2_HVAR_pred": "case when l_discount > 5e-2 then 'D' else 'B' end",
    "CADD_raw": text("l_suppkey"),
    "CADD_raw_rankscore": text("l_partkey"),
    "CADD_phred": f"case when l_suppkey % 13 = 0 then null else {text('l_quantity')} end",
    "GERP_NR": text("l_linenumber"),
    "GERP_RS": text("l_tax"),
    "phyloP100way_vertebrate": text("l_discount"),
    "phyloP100way_vertebrate_rankscore": text("l_partkey % 100"),
    "phastCons100way_vertebrate": text("l_suppkey % 7"),
    "phastCons100way_vertebrate_rankscore": text("l_quantity"),
}

VIEWS: dict[str, View] = {
    # Gene loci; every tenth symbol has a second locus, some have none, some sit on a contig.
    "genes_raw": View(
        "part",
        [
            f"case when p_size = 49 then 'KI270728.1' else {chromosome('p_partkey')} end as chromosome",
            "1000000 + 1290 * p_partkey as start_position",
            "1000000 + 1290 * p_partkey + 20 * cast(floor(p_retailprice) as bigint) as end_position",
            f"case when p_size = 50 then null when p_partkey % 10 = 0 then concat('G', {text(part_of('p_partkey', 20))}) "
            f"else concat('G', {text('p_partkey')}) end as gene_symbol",
            f"concat('ENSG', {text('p_partkey')}) as gene_id",
            "p_type as gene_biotype",
            "p_partkey as src_ord",
        ],
    ),
    # Deletions of patients, between 0 and about 50,000 bases long.
    "deletions": View(
        "events",
        [
            "user_id as patient_id",
            f"{chromosome('user_id')} as chromosome",
            f"{_DEL_START} as start_position",
            f"{_DEL_END} as end_position",
            "cast(floor(value * 100) as bigint) as deletion_size",
            "cast(event_id % 1000 as double) / 1e5 as allele_frequency",
            "event_type as filter_status",
            "case when event_id % 3 = 0 then '0/1' when event_id % 3 = 1 then '1|1' end as genotype_raw",
            f"concat({chromosome('user_id')}, '_', {text(_DEL_START)}, '_', {text(_DEL_END)}) as variant_id",
            "event_id as src_ord",
        ],
    ),
    # Population structural variants as raw text columns.
    "structural_raw": View(
        "events",
        [
            f"concat('chr', {chromosome('user_id')}) as chromosome",
            f"{_DEL_START} as start_position",
            "case when event_id % 4 = 0 then 'LOW_QUAL' else 'PASS' end as variant_filter",
            "case event_type when 'view' then 'DUP' when 'error' then null else 'DEL' end as sv_type_raw",
            f"case when event_id % 7 = 0 then null else {text(_DEL_END)} end as end_position_raw",
            "case when event_id % 5 = 0 then '.' when event_id % 5 = 1 then null "
            f"else {text('0 - cast(floor(value * 100) as bigint)')} end as sv_length_raw",
            f"case when event_id % 11 = 0 then 'NA' else concat('0.', {text('event_id % 900 + 100')}) end as allele_frequency_raw",
            "event_id as src_ord",
        ],
    ),
    # Population point variants with gene list and significance text.
    "sites_raw": View(
        "orders",
        [
            f"{chromosome('o_orderkey')} as chromosome",
            f"{_SITE.format(k='o_orderkey')} as position",
            "'A' as reference_allele",
            "case when o_orderkey % 6 = 0 then 'GT' else 'G' end as alternate_allele",
            f"case o_orderkey % 5 when 0 then concat('G', {text('o_custkey')}, ':', {text('o_custkey')}, '|G', {text('o_orderkey % 1800')}, ':9') "
            f"when 1 then null when 2 then concat('|G', {text('o_custkey')}, ':1') else concat('G', {text('o_custkey')}, ':1') end as gene_info_raw",
            f"{SIGNIFICANCE.format(k='(o_orderkey + o_custkey)')} as clinvar_significance_raw",
            "o_orderpriority as review_status_raw",
            "o_orderkey as src_ord",
        ],
    ),
    # Point variants of patients; some are listed in sites_raw.
    "patient_sites": View(
        "lineitem",
        [
            "l_suppkey as patient_id",
            f"{chromosome('l_orderkey')} as chromosome",
            f"{_SITE.format(k='l_orderkey')} as position",
            "'A' as reference_allele",
            "case when l_linenumber <= 4 then 'G' else 'T' end as alternate_allele",
            f"concat({chromosome('l_orderkey')}, '_', {text(_SITE.format(k='l_orderkey'))}, '_A_', "
            "case when l_linenumber <= 4 then 'G' else 'T' end) as variant_id",
        ],
    ),
    # Labelled candidates of patients among the population's point variants.
    "labelled_sites": View(
        "orders",
        [
            "o_custkey as patient_id",
            f"concat({chromosome('o_orderkey')}, '_', {text(_SITE.format(k='o_orderkey'))}, '_A_', "
            "case when o_orderkey % 6 = 0 then 'GT' else 'G' end) as variant_id",
            "case o_orderkey % 4 when 0 then '0/1' when 1 then '1/1' when 2 then '0|1' end as genotype_raw",
            "cast(case when o_orderstatus = 'F' then 1 else 0 end as bigint) as is_causal",
            "cast(case when o_orderstatus = 'P' then 1 else 0 end as bigint) as is_hard_negative",
        ],
    ),
    # Labelled deletions of patients.
    "labelled_deletions": View(
        "events",
        [
            "user_id as patient_id",
            f"{chromosome('user_id')} as chromosome",
            f"{_DEL_START} as start_position",
            f"{_DEL_END} as end_position",
            "case when event_id % 3 = 0 then '0/1' when event_id % 3 = 1 then '1|1' end as genotype_raw",
            f"concat({chromosome('user_id')}, '_', {text(_DEL_START)}, '_', {text(_DEL_END)}) as variant_id",
            "cast(case when event_type = 'purchase' then 1 else 0 end as bigint) as is_causal",
            "cast(case when event_type = 'error' then 1 else 0 end as bigint) as is_hard_negative",
        ],
    ),
    # Predictor rows of the population's point variants, several per variant, as text.
    "predictor_rows": View(
        "lineitem",
        [
            f"concat({chromosome('l_orderkey')}, '_', {text(_SITE.format(k='l_orderkey'))}, '_A_', "
            "case when l_orderkey % 6 = 0 then 'GT' else 'G' end) as variant_id",
            *[f"{value} as {name}" for name, value in _PREDICTOR_VALUES.items()],
            "(l_orderkey * 8 + l_linenumber) * 10000 + l_partkey as src_ord",
        ],
    ),
    # Constraint rows, several per gene.
    "constraint_raw": View(
        "customer",
        [
            f"concat('G', {text('c_custkey % 700')}) as gene",
            "c_acctbal / 1e4 as oe_lof",
            "c_acctbal / 2e4 as oe_lof_lower",
            "c_acctbal / 5e3 as oe_lof_upper",
            "cast(nullif(c_nationkey, 7) as double) as oe_lof_upper_rank",
            "case when c_mktsegment = 'BUILDING' then null else cast(c_custkey % 100 as double) / 1e2 end as pLI",
            "c_custkey as src_ord",
        ],
    ),
    # Dosage labels, one row per gene, with separator rows and one unknown label.
    "dosage_raw": View(
        "supplier",
        [
            f"case when s_suppkey % 33 = 5 then '+++++' else concat('G', {text('s_suppkey')}) end as `GENE SYMBOL`",
            LABEL.format(k="s_nationkey", w="Haploinsufficiency", odd="'Unheard of'") + " as HAPLOINSUFFICIENCY",
            LABEL.format(k="(s_suppkey + 3)", w="Triplosensitivity", odd="'++++'") + " as TRIPLOSENSITIVITY",
            "s_suppkey as src_ord",
        ],
    ),
    # Gene map rows with phenotype lists.
    "gene_map_raw": View(
        "part",
        [
            f"case when p_partkey % 41 = 3 then null else concat('G', {text('p_partkey')}) end as approved_gene_symbol",
            f"{text('600000 + p_partkey')} as mim_number",
            f"{_phenotypes()} as phenotypes_raw",
            "p_partkey as src_ord",
        ],
    ),
    # Morbid map rows: one phenotype and an alias list each.
    "morbid_raw": View(
        "part",
        [
            f"{_phenotypes()} as phenotype_raw",
            f"case when p_partkey % 41 = 3 then null else concat('G', {text('p_partkey')}, ', ALIAS', {text('p_size')}) end as gene_symbols_raw",
            f"{text('600000 + p_partkey')} as gene_mim_number",
            f"concat({text('p_size')}, 'q', {text('p_partkey % 30')}) as cyto_location",
            "p_partkey as src_ord",
        ],
    ),
    "mim_titles_raw": View(
        "part",
        [
            "case when p_size % 3 = 0 then 'Number Sign' end as prefix",
            f"{text('100000 + p_partkey')} as mim_number",
            f"case p_size % 3 when 0 then p_name when 1 then concat(p_name, '; ', p_type) "
            "else concat(' ', p_name, ' ;', p_type, '; MORE') end as preferred_title_raw",
            "p_partkey as src_ord",
        ],
    ),
    "mim_genes_raw": View(
        "part",
        [
            f"{text('100000 + p_partkey')} as mim_number",
            "p_type as mim_entry_type",
            f"{text('p_size')} as entrez_gene_id",
            f"case when p_size % 4 = 0 then null else concat('G', {text('p_partkey')}) end as gene_symbol",
            f"concat('ENSG', {text('p_partkey')}) as ensembl_gene_id",
            "p_partkey as src_ord",
        ],
    ),
    # Disease–symptom annotations with every kind of frequency text.
    "annotations_raw": View(
        "lineitem",
        [
            f"concat('OMIM:', {text('100000 + l_partkey')}) as database_id",
            f"concat('Disease ', {text('l_partkey')}) as disease_name",
            f"{hpo('l_suppkey')} as hpo_id",
            "case l_linenumber when 1 then 'HP:0040281' when 2 then ' HP:0040283 ' "
            f"when 3 then concat({text('cast(l_quantity as bigint)')}, '/50') when 4 then null when 5 then '12%' "
            "when 6 then '3/0' else '1/2/3' end as frequency",
            "case when l_discount > 5e-2 then 'HP:0003577' end as onset",
            "case when l_tax >= 8e-2 then ' not ' when l_tax <= 1e-2 then 'YES' end as qualifier",
            "case when l_returnflag = 'R' then 'I' else 'P' end as aspect",
            "l_orderkey * 10 + l_linenumber as src_ord",
        ],
    ),
    "patient_symptoms": View(
        "orders", ["o_custkey as patient_id", f"{hpo('o_orderkey % 100')} as hpo_id"]
    ),
    # Scored, labelled candidates of patients.
    "candidates": View(
        "orders",
        [
            "o_custkey as patient_id",
            f"concat('V', lpad({text('o_orderkey')}, 9, '0')) as variant_id",
            f"concat('G', {text('(o_orderkey * 13) % 2000')}) as gene_symbol",
            "case when o_orderkey % 17 = 0 then null else o_totalprice end as score",
            "cast(case when o_orderstatus = 'F' then 1 else 0 end as bigint) as is_causal",
            "cast(case when o_orderstatus = 'P' then 1 else 0 end as bigint) as is_hard_negative",
            "o_orderpriority as priority",
        ],
    ),
    "patient_tiers": View(
        "customer",
        ["c_custkey as patient_id", "case when c_mktsegment = 'FURNITURE' then null else c_mktsegment end as phenotype_tier"],
    ),
    # Many tied scores.
    "tied_scores": View(
        "lineitem", ["l_quantity as score", "cast(case when l_returnflag = 'R' then 1 else 0 end as bigint) as label"]
    ),
    # Long-form contributions.
    "contribution_rows": View(
        "lineitem",
        [
            "l_orderkey as row_id",
            "concat('feature_', l_returnflag, '_', l_linestatus, '_', cast(l_linenumber as string)) as feature",
            "case when l_linenumber % 2 = 0 then l_discount * l_quantity else 0e0 - l_tax * l_quantity end as contribution",
            "l_extendedprice as tie",
        ],
    ),
    # Sets of items per disease for the similar-disease search.
    "disease_items": View("lineitem", ["l_suppkey as disease_id", "l_partkey as hpo_id"]),
}
