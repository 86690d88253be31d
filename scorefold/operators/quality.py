"""Data checks. Each returns the offending rows or counts; none changes the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorefold.operators.filters import unknown_splits


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_names(wanted: list[str], known: list[str]) -> None:
    """Requested metric names must exist."""
    unknown = [n for n in wanted if n not in known]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; choices are {known}")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti")
    right = b.select(key).distinct().join(a.select(key), key, "left_anti")
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def misaligned(dump: DataFrame, rows: DataFrame, pos: str = "pos", gold: str = "gold",
               codes: str = "SHORT_CODES") -> DataFrame:
    """Positions whose gold lists differ, or that exist on one side only."""
    cut = rows.select(pos, F.transform(codes, lambda c: F.substring(c, 1, 3)).alias("_expected"))
    joined = dump.select(pos, F.col(gold).alias("_gold")).join(cut, pos, "full_outer")
    return joined.filter(~F.col("_gold").eqNullSafe(F.col("_expected"))).select(pos)


def split_membership(ids: DataFrame, splits: DataFrame, key: str = "hadm_id") -> DataFrame:
    """How many of the ids occur in each split."""
    member = ids.select(key).distinct().withColumn("_in", F.lit(True))
    marked = splits.select(key, "split").distinct().join(member, key, "left")
    return marked.groupBy("split").agg(F.count("_in").alias("n_ids"))


def leaks(ids: DataFrame, splits: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Train and dev splits that contain some of the ids; must be empty."""
    counts = split_membership(ids, splits, key)
    return counts.filter(F.col("split").isin("train", "dev") & (F.col("n_ids") > 0))


def uneven_sizes(files: DataFrame, group: str, n: str = "n_samples") -> DataFrame:
    """Groups whose files differ in row count."""
    return files.groupBy(group).agg(F.min(n).alias("min_n"), F.max(n).alias("max_n")).filter("min_n <> max_n")


def length_mismatches(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows whose two lists differ in length."""
    return df.filter(~F.size(a).eqNullSafe(F.size(b)))


def tagged_reasoning(df: DataFrame, column: str = "Thinking") -> DataFrame:
    """Rows whose stored reasoning still has think tags; the whole table is checked."""
    if column not in df.columns:
        return df.limit(0)
    text = F.col(column)
    return df.filter(text.contains("<think>") | text.contains("</think>"))


def repeated_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unmatched(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a dictionary entry."""
    return df.join(dim.select(*keys).distinct(), keys, "left_anti")


__all__ = [
    "key_differences", "leaks", "length_mismatches", "misaligned", "repeated_ids", "require_columns",
    "require_names", "split_membership", "tagged_reasoning", "uneven_sizes", "unknown_splits", "unmatched",
]
