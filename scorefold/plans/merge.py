"""Merging the generators' answers and the evaluation dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorefold.operators.assignment import assign, keep_assigned
from scorefold.operators.filters import canonical_split, complaint_name, existing, within_rank
from scorefold.operators.selection import keep_first
from scorefold.schemas import COMBINED_COLUMNS, TEST_COLUMNS


def merge_generators(generated: DataFrame, n_models: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Generated rows under one complaint per id, and that assignment.

    The rank filter comes first because it decides which complaints an id has
    in common. The assignment reads the id columns only.
    """
    kept = within_rank(generated, complaint_name(F.col("cc")))
    assignment = assign(kept.select("subject_id", "hadm_id", "cc", "model").distinct(), n_models)
    return keep_assigned(kept, assignment), assignment


def combine(merged: DataFrame, model: str = "model") -> DataFrame:
    """The merged rows in the common column layout, with canonical split names."""
    named = merged.withColumn("gen_model", F.col(model)).withColumn("split", canonical_split(F.col("split")))
    return existing(named, COMBINED_COLUMNS)


def evaluation_dataset(combined: DataFrame) -> DataFrame:
    """One row per admission outside the training split."""
    held_out = combined.filter("split <> 'train'").select(
        *[F.col(f"`{c}`") for c in TEST_COLUMNS], "gen_model"
    )
    return keep_first(held_out, ["hadm_id"], ["gen_model"]).drop("gen_model")
