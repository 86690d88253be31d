"""The data of the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorefold.functions.scoring import mean_of
from scorefold.operators import reports as RP

JSON_RATES = ["V1 JSON Valid Rate", "V2 JSON Valid Rate", "V4 JSON Valid Rate"]


def with_json_rate(metrics: DataFrame) -> DataFrame:
    """``json_valid``: mean of the stage rates that a run has."""
    return metrics.withColumn("json_valid", mean_of([F.col(f"`{c}`") for c in JSON_RATES if c in metrics.columns]))


def main_table(metrics: DataFrame, runs: list[str], columns: list[str], digits: int = 1) -> DataFrame:
    """Listed runs with seed means, deviations and best flags."""
    table = RP.by_run(metrics, columns).filter(F.col("run").isin(runs))
    flagged = RP.flag_best(table, columns)
    shown = [F.round(c, digits).alias(c) for name in columns for c in (name, f"{name}_std")]
    return flagged.select("run", "n_seeds", *shown, *[f"{c}_best" for c in columns])


def single_seed_table(metrics: DataFrame, runs: list[str], columns: list[str]) -> DataFrame:
    """Listed runs without seed repeats, with best flags."""
    table = metrics.filter(F.col("collection").isin(runs)).select("collection", *columns)
    return RP.flag_best(table, columns)


def ablation_table(dev: DataFrame, score: str, columns: list[str], size: str = "8b", mode: str = "full") -> DataFrame:
    """One row per dataset at its best epoch plus the untuned base; the base is never best."""
    tuned = dev.filter((F.col("model_size") == size) & (F.col("mode") == mode))
    chosen = RP.best_epoch(tuned, ["dataset"], score)
    picked = RP.at_chosen_epoch(tuned, chosen, ["dataset"])
    base = dev.filter((F.col("model_size") == size) & F.col("is_base"))
    keep = ["dataset", "epoch", "is_base", *columns]
    return RP.flag_best(picked.select(*keep).unionByName(base.select(*keep)), columns, ~F.col("is_base"))
