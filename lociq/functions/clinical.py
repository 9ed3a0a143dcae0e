"""Clinical vocabularies: significance, frequency, dosage labels, disease entries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from lociq.functions.text import parse_double, strip

# Frequency terms of the phenotype ontology.
FREQUENCY_TERMS = {
    "HP:0040280": 1.00,
    "HP:0040281": 0.90,
    "HP:0040282": 0.55,
    "HP:0040283": 0.17,
    "HP:0040284": 0.025,
    "HP:0040285": 0.00,
}

# Dosage evidence labels; %s is the kind of sensitivity.
DOSAGE_LABELS = {
    "Sufficient Evidence for %s": 3,
    "Some Evidence for %s": 2,
    "Emerging Evidence for %s": 1,
    "Little Evidence for %s": 1,
    "No Evidence for %s": 0,
    "Dosage Sensitivity Unlikely for %s": 0,
    "Gene Associated with Autosomal Recessive Phenotype": 0,
}
NOT_EVALUATED = "Not yet evaluated"

# The classes that significance is reduced to, and disease-entry types.
PATHOGENIC, LIKELY_PATHOGENIC = "Pathogenic", "Likely_pathogenic"
BENIGN, LIKELY_BENIGN = "Benign", "Likely_benign"
UNCERTAIN, CONFLICTING, OTHER = "Uncertain_significance", "Conflicting", "Other"
SUSCEPTIBILITY, NONDISEASE = "susceptibility", "nondisease"
CONFIRMED, UNCONFIRMED, UNMAPPED = "confirmed_mendelian", "unconfirmed_mendelian", "unconfirmed_or_unmapped"

DISEASE_ENTRY = r"^(.*?),\s*(\d{6})\s*\((\d)\)(.*)$"
JUNK_LABEL = r"^\++$"


def gene_symbols(gene_info: Column) -> Column:
    """``SYM:ID|SYM:ID`` to the symbols; null gives an empty array."""
    symbols = F.transform(F.split(gene_info, r"\|"), lambda x: F.substring_index(x, ":", 1))
    return F.coalesce(symbols, F.array().cast("array<string>"))


def simplify_significance(raw: Column) -> Column:
    """Reduce compound significance text to one class, the stronger token first."""
    text = F.lower(raw)
    tokens = F.split(F.translate(text, "/", "|"), r"\|")
    simple = F.when(F.contains(text, F.lit("conflicting")), CONFLICTING)
    for token, name in (
        ("pathogenic", PATHOGENIC),
        ("likely_pathogenic", LIKELY_PATHOGENIC),
        ("benign", BENIGN),
        ("likely_benign", LIKELY_BENIGN),
    ):
        simple = simple.when(F.array_contains(tokens, token), name)
    simple = simple.when(F.contains(text, F.lit("uncertain")), UNCERTAIN).otherwise(OTHER)
    return F.when(raw.isNotNull(), simple)


def parse_frequency(raw: Column) -> Column:
    """Frequency term or ``n/m`` ratio; percentages, bad text and zero denominators give null."""
    text = strip(raw)
    terms = F.create_map(*[F.lit(x) for x in chain.from_iterable(FREQUENCY_TERMS.items())])
    parts = F.split(text, "/")
    ratio = F.try_divide(parse_double(F.get(parts, F.lit(0))), parse_double(F.get(parts, F.lit(1))))
    return F.coalesce(F.try_element_at(terms, text), F.when(F.size(parts) == 2, ratio))


def is_negated(qualifier: Column) -> Column:
    return F.coalesce(F.upper(strip(qualifier)) == "NOT", F.lit(False))


def dosage_score(label: Column, kind: str) -> Column:
    """Evidence label to its ordinal; labels outside the list give null."""
    known = {(k % kind if "%s" in k else k): v for k, v in DOSAGE_LABELS.items()}
    scores = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    return F.try_element_at(scores, label)


def is_junk_label(*labels: Column) -> Column:
    """True when any of the labels is a run of plus signs."""
    junk = F.lit(False)
    for label in labels:
        junk = junk | F.coalesce(label.rlike(JUNK_LABEL), F.lit(False))
    return junk


def disease_entry(entry: Column) -> Column:
    """One disease entry as a struct of name, number, mapping key, type and inheritance."""
    text = strip(entry)
    number = F.regexp_extract(text, DISEASE_ENTRY, 2)
    mapped = number != ""
    name = strip(F.regexp_extract(text, DISEASE_ENTRY, 1))
    kind = (
        F.when(~mapped, UNMAPPED)
        .when(F.startswith(name, F.lit("{")) & F.endswith(name, F.lit("}")), SUSCEPTIBILITY)
        .when(F.startswith(name, F.lit("[")) & F.endswith(name, F.lit("]")), NONDISEASE)
        .when(F.startswith(name, F.lit("?")), UNCONFIRMED)
        .otherwise(CONFIRMED)
    )
    modes = F.filter(
        F.transform(F.split(F.regexp_extract(text, DISEASE_ENTRY, 4), ","), strip), lambda m: m != ""
    )
    return F.struct(
        F.btrim(F.when(mapped, name).otherwise(text), F.lit("{}[]? ")).alias("disease_name"),
        F.when(mapped, number).alias("phenotype_mim_number"),
        F.when(mapped, F.regexp_extract(text, DISEASE_ENTRY, 3)).alias("mapping_key"),
        kind.alias("phenotype_type"),
        F.when(F.size(modes) > 0, F.array_join(modes, ";")).alias("inheritance_modes"),
    )


def disease_id(number: Column) -> Column:
    """``OMIM:<int>`` from a number given as text, integer or float."""
    return F.concat(F.lit("OMIM:"), number.try_cast("double").try_cast("bigint").cast("string"))
