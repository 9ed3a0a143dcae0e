"""Variant identity, genotype and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lociq.functions.hashing import pick
from lociq.functions.text import parse_double

# The chromosomes that are kept.
STANDARD_CHROMOSOMES = [str(i) for i in range(1, 23)] + ["X", "Y", "MT"]

HETEROZYGOUS, HOMOZYGOUS, HEMIZYGOUS = "heterozygous", "homozygous", "hemizygous"


def strip_chr(chromosome: Column) -> Column:
    return F.regexp_replace(chromosome, "^chr", "")


def identity(*parts: Column) -> Column:
    """Parts joined with ``_``; null when any part is null."""
    out = parts[0].cast("string")
    for part in parts[1:]:
        out = F.concat(out, F.lit("_"), part.cast("string"))
    return out


def lowest_score(value: Column) -> Column:
    """A number, or the lowest number of a ``;`` list; null when none parses."""
    return F.array_min(F.transform(F.split(value.cast("string"), ";"), parse_double))


def zygosity_from_genotype(gt: Column, strict: bool = False) -> Column:
    """Two equal alleles other than 0 are homozygous, everything else heterozygous.

    ``strict`` gives null where an allele is not called.
    """
    alleles = F.split(F.translate(gt, "|", "/"), "/")
    first, second = F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    same = (F.size(alleles) == 2) & (first == second) & (first != "0")
    out = F.when(F.coalesce(same, F.lit(False)), HOMOZYGOUS).otherwise(HETEROZYGOUS)
    if strict:
        out = F.when(gt.isNotNull() & ~F.contains(gt, F.lit(".")), out)
    return out


def zygosity_from_inheritance(modes: Column, seed: int, *key: Column) -> Column:
    """Zygosity that fits a causal variant's inheritance; open cases are picked by hash."""
    text = F.lower(modes)
    return (
        F.when(F.contains(text, F.lit("recessive")), HOMOZYGOUS)
        .when(F.contains(text, F.lit("dominant")), HETEROZYGOUS)
        .when(F.contains(text, F.lit("x-linked")), pick([HEMIZYGOUS, HETEROZYGOUS], seed, *key))
        .otherwise(pick([HETEROZYGOUS, HOMOZYGOUS], seed, *key))
    )


def background_zygosity(modes: Column, seed: int, *key: Column) -> Column:
    """Zygosity of a background variant: heterozygous under recessive inheritance, else by hash."""
    recessive = F.coalesce(F.contains(F.lower(modes), F.lit("recessive")), F.lit(False))
    return F.when(recessive, HETEROZYGOUS).otherwise(pick([HOMOZYGOUS, HETEROZYGOUS], seed, *key))


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared length without counting both ends; touching intervals give 0."""
    return F.least(end_a, end_b) - F.greatest(start_a, start_b)


def ratio_if_positive(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def format_evidence(feature: Column, contribution: Column) -> Column:
    return F.format_string("%s=%.3f", feature, contribution)
