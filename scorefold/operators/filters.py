"""Metadata, range, membership and split filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorefold.functions.scoring import no_nan
from scorefold.functions.text import seed_of

# Rank bounds, split names and seeds.
FREQUENT_COMPLAINTS = ["abdominal pain", "dyspnea"]
FREQUENT_MAX_RANK = 1
OTHER_MAX_RANK = 2
SPLIT_NAMES = {"train": "train", "dev": "dev", "val": "dev", "test": "test"}
ALLOWED_SEEDS = [42, 43, 44]


def by_metadata(
    df: DataFrame,
    icd_version: int | None = None,
    data_source: str | None = None,
    split: str | None = None,
    complaint: str | None = None,
) -> DataFrame:
    """Every given value adds one equality; the complaint must be in ``cc_list``."""
    equal = {"ICD_version": icd_version, "data_source": data_source, "split": split}
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if complaint is not None and "cc_list" in df.columns:
        df = df.filter(F.array_contains("cc_list", complaint))
    return df


def complaint_name(column: Column) -> Column:
    """``cc_back_pain`` or ``back_pain`` as ``back pain``."""
    return F.replace(F.regexp_replace(column, "^cc_", ""), F.lit("_"), F.lit(" "))


def within_rank(
    df: DataFrame, complaint: Column, category: str = "match_category",
    frequent: list[str] | None = None,
) -> DataFrame:
    """Keep categories from 0 to the bound of the complaint."""
    frequent = FREQUENT_COMPLAINTS if frequent is None else frequent
    bound = F.when(complaint.isin(frequent), FREQUENT_MAX_RANK).otherwise(OTHER_MAX_RANK)
    return df.filter(F.col(category).between(0, bound))


def in_cohort(df: DataFrame, cohort: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in the saved cohort."""
    return df.join(cohort.select(*keys).distinct(), keys, "left_semi")


def in_splits(df: DataFrame, splits: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """Rows of the splits, or the first ``n`` of them in key order."""
    kept = df.filter(F.col("split").isin(splits))
    return kept.orderBy(*order).limit(n) if n else kept


def with_matches(df: DataFrame, column: str = "cc_list") -> DataFrame:
    return df.filter(F.size(column) > 0)


def with_any(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows in which all of the columns are null."""
    present = [c for c in columns if c in df.columns]
    return df.na.drop("all", subset=present) if present else df


def canonical_split(split: Column) -> Column:
    """The canonical name; unknown values stay as they are."""
    out = split
    for name, canonical in SPLIT_NAMES.items():
        if name != canonical:
            out = F.when(split == name, canonical).otherwise(out)
    return out


def unknown_splits(df: DataFrame) -> DataFrame:
    """Split values outside the known names, with their row counts."""
    return df.filter(~F.col("split").isin(list(SPLIT_NAMES))).groupBy("split").count()


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns the table has, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def allowed_seeds(df: DataFrame, name: str = "collection", seeds: list[int] | None = None) -> DataFrame:
    return df.filter(seed_of(F.col(name)).isin(ALLOWED_SEEDS if seeds is None else seeds))


def named(df: DataFrame, part: str | None = None, limit: int | None = None,
          name: str = "collection") -> DataFrame:
    """Rows whose name contains ``part``; with ``limit`` the first ones by name."""
    if part:
        df = df.filter(F.col(name).contains(part))
    return df.orderBy(name).limit(limit) if limit else df


def still_open(df: DataFrame, score: Column, threshold: Column, floor: Column | None = None) -> DataFrame:
    """Rows to try again: score missing, not above the threshold, or below the floor."""
    score = no_nan(score)
    retry = score.isNull() | (score <= threshold)
    if floor is not None:
        retry = retry | (score < F.coalesce(no_nan(floor), score))
    return df.filter(retry)


def without_answer(df: DataFrame, answer: str) -> DataFrame:
    """Evaluation mode: rows whose answer is missing."""
    return df.filter(F.col(answer).isNull() | (F.col(answer) == "None"))
