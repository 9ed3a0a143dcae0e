"""Symptom-based scoring of (patient, gene) pairs and similar-disease search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociq.functions.clinical import disease_id
from lociq.operators.joins import lookup_join, spread_join
from lociq.operators.ranking import first_per_key

DEFAULT_WEIGHT = 0.3


def usable_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.filter((F.col("aspect") == "P") & ~F.col("is_negated"))


def disease_symptoms(annotations: DataFrame) -> DataFrame:
    """Distinct (disease, symptom) pairs: the disease → symptoms table and its inverse in one."""
    return usable_annotations(annotations).select("disease_id", "hpo_id").distinct()


def symptom_sets(pairs: DataFrame) -> DataFrame:
    """Sorted symptom array per disease.

    ``pairs`` is distinct, so an array holds at most the fixed vocabulary of the ontology.  The
    inverse, whose lists grow with the number of diseases, is the pair table itself.
    """
    return pairs.groupBy("disease_id").agg(F.array_sort(F.collect_set("hpo_id")).alias("hpo_id_set"))


def disease_weights(annotations: DataFrame, duplicates: str = "last", order: str = "src_ord") -> DataFrame:
    """(disease, symptom, weight) with missing frequencies at 0.3.

    A symptom listed twice keeps its ``last`` weight, or the ``sum`` of all its rows.
    """
    weighed = usable_annotations(annotations).withColumn(
        "weight", F.coalesce("frequency_numeric", F.lit(DEFAULT_WEIGHT))
    )
    if duplicates == "last":
        last = first_per_key(weighed, ["disease_id", "hpo_id"], [F.desc(order)])
        return last.select("disease_id", "hpo_id", "weight")
    if duplicates == "sum":
        return weighed.groupBy("disease_id", "hpo_id").agg(F.sum("weight").alias("weight"))
    raise ValueError("duplicates must be 'last' or 'sum'")


def listed_weights(weights: DataFrame) -> DataFrame:
    """(disease, its symptoms with their weights, total weight), without diseases that weigh nothing."""
    listed = F.array_sort(F.collect_list(F.struct("hpo_id", "weight")))
    return weights.groupBy("disease_id").agg(listed.alias("_listed"), F.sum("weight").alias("_total")).filter("_total > 0")


def gene_disease_ids(gene_diseases: DataFrame, order: str = "src_ord") -> DataFrame:
    """Distinct (gene, disease id) with the name and place of the first row."""
    ided = gene_diseases.filter(
        F.col("gene_symbol").isNotNull() & F.col("phenotype_mim_number").isNotNull()
    ).withColumn("disease_id", disease_id(F.col("phenotype_mim_number")))
    first = first_per_key(ided, ["gene_symbol", "disease_id"], [F.asc(order)])
    return first.select("gene_symbol", "disease_id", "disease_name", F.col(order).alias("disease_ord"))


def phenotype_scores(
    candidates: DataFrame, patient_symptoms: DataFrame, genes_to_diseases: DataFrame, weights: DataFrame
) -> DataFrame:
    """Best disease of every distinct (patient, gene) pair that scores above zero.

    Score = weight of the disease's symptoms the patient has / weight of all its symptoms.
    A disease's weights and a patient's symptoms are arrays, bounded by the ontology's vocabulary,
    so a candidate disease is one row from the first join to the score: nothing is expanded to
    symptoms and nothing joined back.  Scores are rounded to 12 digits so that the order in which
    weights happen to be summed cannot decide between equal diseases.  ``weights`` may be listed already.
    """
    pairs = candidates.select("patient_id", "gene_symbol").filter(F.col("gene_symbol").isNotNull()).distinct()
    symptoms = patient_symptoms.groupBy("patient_id").agg(F.collect_set("hpo_id").alias("_has"))
    diseases = weights if "_listed" in weights.columns else listed_weights(weights)
    expanded = lookup_join(pairs, genes_to_diseases, "gene_symbol", "inner")
    # Patients without symptoms score nothing, so they go before diseases are looked up.
    told = lookup_join(expanded, symptoms, "patient_id", "inner", sized_by=pairs)
    met = lookup_join(told, diseases, "disease_id", "inner")
    own = F.filter("_listed", lambda x: F.array_contains("_has", x["hpo_id"]))
    matched = F.aggregate(own, F.lit(0.0), lambda total, x: total + x["weight"])
    ranked = met.withColumn("score", F.round(matched / F.col("_total"), 12)).filter("score > 0")
    best = first_per_key(
        ranked, ["patient_id", "gene_symbol"], [F.desc("score"), F.asc("disease_ord"), F.asc("disease_id")]
    )
    return best.select(
        "patient_id",
        "gene_symbol",
        F.col("score").alias("phenotype_similarity_score"),
        F.col("disease_id").alias("best_matching_disease_id"),
        F.col("disease_name").alias("best_matching_disease"),
    )


def with_phenotype_scores(
    rows: DataFrame, patient_symptoms: DataFrame, genes_to_diseases: DataFrame, weights: DataFrame
) -> DataFrame:
    """Candidate rows with their score; rows without a matching disease score 0."""
    scores = phenotype_scores(rows, patient_symptoms, genes_to_diseases, weights)
    out = lookup_join(rows, scores, ["patient_id", "gene_symbol"])
    return out.withColumn("phenotype_similarity_score", F.coalesce("phenotype_similarity_score", F.lit(0.0)))


def similar_diseases(
    probes: DataFrame, pairs: DataFrame, min_shared: int = 2, key: str = "disease_id", item: str = "hpo_id"
) -> DataFrame:
    """(disease, other, shared) for every probe disease and other disease sharing ``min_shared`` items.

    Two diseases that share k items share at least one outside any k-1 chosen ones.  The k-1
    most frequent items, where candidate pairs would pile up, therefore never generate
    candidates: they are held as a short array per disease and added to the count afterwards.
    """
    pairs = pairs.select(key, item).distinct()
    spared: list = []
    if min_shared > 1:
        common = pairs.groupBy(item).count().orderBy(F.desc("count"), F.asc(item)).limit(min_shared - 1)
        spared = [r[0] for r in common.collect()]
    rare = pairs
    if spared:
        rare = pairs.filter(~F.col(item).isin(spared))
    ids = probes.select(key).distinct()
    lhs = lookup_join(rare, ids, key, "left_semi")
    rhs = rare.withColumnRenamed(key, "other_id")
    counted = (
        spread_join(lhs, rhs, [item], "inner")
        .filter(F.col(key) != F.col("other_id"))
        .groupBy(key, "other_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    if spared:
        held = pairs.filter(F.col(item).isin(spared)).groupBy(key).agg(F.collect_set(item).alias("_held"))
        others = held.withColumnsRenamed({key: "other_id", "_held": "_other_held"})
        counted = lookup_join(lookup_join(counted, held, key), others, "other_id")
        both = F.coalesce(F.size(F.array_intersect("_held", "_other_held")), F.lit(0))
        counted = counted.withColumn("shared", F.col("shared") + F.when(both > 0, both).otherwise(0))
    return counted.filter(F.col("shared") >= min_shared).select(key, "other_id", "shared")
