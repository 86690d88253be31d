"""Cohort curation: annotate notes, rank diseases, keep well-matched admissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorefold.functions.text import LineRules, chief_complaint, primary_diagnosis
from scorefold.operators.events import add_lab_data
from scorefold.operators.filters import by_metadata, in_cohort, within_rank
from scorefold.operators.matching import add_complaints, add_disease_vector, add_rank_columns
from scorefold.operators.similarity import rank_labels


def annotate(notes: DataFrame, labevents: DataFrame, admissions: DataFrame,
             synonyms: dict[str, list[str]], systems: dict[str, str],
             rules: LineRules, hours: int = 12) -> DataFrame:
    """Notes with labs, complaints, systems and the discharge diagnosis text."""
    with_labs = add_lab_data(notes, labevents, admissions, hours)
    sectioned = with_labs.withColumn("cc_string", chief_complaint(F.col("discharge_note")))
    matched = add_complaints(sectioned, synonyms, systems)
    return matched.withColumn("diagnose_string", primary_diagnosis(F.col("discharge_note"), rules))


def rank_cohort(annotated: DataFrame, embeddings: DataFrame, diseases: DataFrame,
                disease_embeddings: DataFrame, complaints: list[str],
                icd_version: int = 10, data_source: str = "hosp", keys: tuple[str, ...] = ("hadm_id",)) -> DataFrame:
    """One row per (admission, complaint) with ranked diseases, vector and match category.

    ``embeddings``: (hadm_id, embedding) of the diagnosis text;
    ``disease_embeddings``: (chief_complaint, pos, label, embedding). ``keys`` identify an
    annotated row. An admission without embedding stays; its similarities are 0.
    """
    rows = (
        by_metadata(annotated, icd_version, data_source)
        .withColumn("chief_complaint", F.explode("cc_list"))
        .filter(F.col("chief_complaint").isin(complaints))
    )
    found = rows.join(embeddings, "hadm_id", "left")
    ranked = rank_labels(found, disease_embeddings, [*keys, "chief_complaint"], "chief_complaint")
    with_vector = add_disease_vector(ranked, diseases)
    return add_rank_columns(with_vector, diseases, list(keys))


def select_cohort(ranked: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Rows within the rank bound of their complaint and, if given, the saved cohort."""
    kept = within_rank(ranked, F.col("chief_complaint"))
    if saved is None:
        return kept
    cohort = saved.withColumn("chief_complaint", F.replace("cc", F.lit("_"), F.lit(" ")))
    return in_cohort(kept, cohort, ["chief_complaint", "subject_id"])
