"""Report tables over per-run metrics: seeds, robustness, best values, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorefold.functions.text import size_order, without_prefix, without_seed

# The tolerances of "equal to the best" and of the audit.
REL_TOL = 1e-5
ABS_TOL = 1e-8
AUDIT_TOL = 0.01


def seed_aggregate(metrics: DataFrame, by: list[str], columns: list[str], fill_std: bool = True) -> DataFrame:
    """Mean, sample deviation and number of seeds per group.

    The deviation of a single seed is 0, or null with ``fill_std=False``.
    """

    def spread(c: str) -> Column:
        s = F.stddev_samp(c)
        return (F.coalesce(s, F.lit(0.0)) if fill_std else s).alias(f"{c}_std")

    return metrics.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in columns], *[spread(c) for c in columns],
        F.count("*").alias("n_seeds"),
    )


def by_run(metrics: DataFrame, columns: list[str], name: str = "collection") -> DataFrame:
    """Seed repeats of a run (``-seed43`` / ``-seed44``) merged under one name."""
    grouped = metrics.withColumn("run", without_seed(F.col(name)))
    return seed_aggregate(grouped, ["run"], columns, fill_std=False)


def robustness(metrics: DataFrame, arm: str, columns: list[str]) -> DataFrame:
    """Mean, deviation, range and variation of every metric per arm, three digits."""
    long = metrics.select(
        arm,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns
        ])),
    )
    stats = long.groupBy(arm, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    derived = stats.withColumns(
        {
            "range": F.col("max") - F.col("min"),
            "cv_pct": F.try_divide(F.col("std"), F.col("mean")) * 100,
        }
    )
    return derived.select(
        arm, "metric", *[F.round(c, 3).alias(c) for c in ("mean", "std", "min", "max", "range", "cv_pct")]
    )


def flag_best(table: DataFrame, columns: list[str], among: Column | None = None) -> DataFrame:
    """``<metric>_best``: the value equals the best one of its column (within tolerance)."""
    eligible = F.lit(True) if among is None else among
    best = table.agg(F.struct(*[F.max(F.when(eligible, F.col(c))).alias(c) for c in columns])).scalar()

    def is_best(c: str) -> Column:
        top = best[c]
        return F.coalesce(
            eligible & (F.abs(F.col(c) - top) <= ABS_TOL + REL_TOL * F.abs(top)), F.lit(False)
        )

    return table.withColumns({f"{c}_best": is_best(c) for c in columns})


def best_epoch(metrics: DataFrame, by: list[str], score: str, epoch: str = "epoch") -> DataFrame:
    """Epoch with the highest score per family; the earliest one on a tie."""
    choice = F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e"))))
    return metrics.groupBy(*by).agg(choice.alias("c")).select(
        *by, (-F.col("c.e")).alias("chosen_epoch"), F.col("c.s").alias(score)
    )


def at_chosen_epoch(metrics: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """Metric rows of the chosen epoch of every family."""
    picked = chosen.select(*by, F.col("chosen_epoch").alias("epoch"))
    return metrics.join(picked, [*by, "epoch"], "left_semi")


def epoch_sweep(metrics: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """One row per expected (family, epoch); ``missing`` marks epochs without metrics."""
    marked = metrics.withColumn("_found", F.lit(True))
    return (
        expected.join(marked, [*by, "epoch"], "left")
        .withColumn("missing", F.col("_found").isNull()).drop("_found")
    )


def wide_to_long(table: DataFrame, keys: list[str], levels: list[str] | None = None) -> DataFrame:
    """One row per (keys, granularity, metric type) from ``<metric>_<type>_<level>`` columns."""
    cells = [
        F.struct(
            F.lit(level).alias("granularity"), F.lit(kind).alias("metric_type"),
            *[F.col(f"{m}_{kind}_{level}").alias(m) for m in ("recall", "precision", "f1")],
        )
        for level in (levels or ["category", "full"]) for kind in ("micro", "macro")
    ]
    return table.select(*keys, F.inline(F.array(*cells)))


def variant_delta(table: DataFrame, keys: list[str], columns: list[str], variant: str = "variant",
                  base: str = "base", tuned: str = "full", digits: int = 1) -> DataFrame:
    """Tuned minus base value of every metric."""

    def value(c: str, v: str) -> Column:
        return F.max(F.when(F.col(variant) == v, F.col(c)))

    return table.groupBy(*keys).agg(
        *[F.round(value(c, tuned) - value(c, base), digits).alias(c) for c in columns]
    )


def seed_average(scores: DataFrame, by: list[str], columns: list[str], n: str = "n_samples") -> DataFrame:
    """Average over the seed files of a model, with ``same_size`` telling equal row counts."""
    return scores.groupBy(*by).agg(
        *[F.round(F.avg(c) * 100, 2).alias(c) for c in columns],
        F.max(n).alias(n), (F.min(n) == F.max(n)).alias("same_size"),
    )


def audit(recomputed: DataFrame, published: DataFrame, keys: list[str], tolerance: float = AUDIT_TOL,
          strict: bool = False) -> DataFrame:
    """Recomputed against published values.

    ``recomputed``: keys, metric, version, value (averaged over versions);
    ``published``: keys, metric, published, asserted. ``strict`` raises when an
    asserted value is off by more than the tolerance.
    """
    means = recomputed.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))
    joined = means.join(published, [*keys, "metric"])
    delta = F.col("value") - F.col("published")
    out = joined.select(
        *keys, "metric", "published", F.round("value", 2).alias("recomputed"),
        F.round(delta, 2).alias("delta"), "asserted",
        (F.col("asserted") & (F.abs(delta) > tolerance)).alias("failed"),
    )
    if strict and not out.filter("failed").isEmpty():
        raise ValueError("recomputed values differ from the published ones")
    return out


def upsert(old: DataFrame, new: DataFrame, key: str = "collection") -> DataFrame:
    """New rows replace old rows of the same key; columns missing on a side are null."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def new_and_done(listed: DataFrame, done: DataFrame, name: str = "collection") -> tuple[DataFrame, DataFrame]:
    """Listed runs split into those not evaluated yet and those already evaluated."""
    clean = listed.withColumn(name, without_prefix(F.col(name)))
    known = done.select(name).distinct()
    return clean.join(known, name, "left_anti"), clean.join(known, name, "left_semi")


def append_metrics(old: DataFrame, new: DataFrame, name: str = "collection", last: str = "n_samples") -> DataFrame:
    """Old and new metric rows in name order, with the sample count as last column."""
    both = old.unionByName(new, allowMissingColumns=True)
    columns = [c for c in both.columns if c != last] + [last]
    return both.select(*columns).orderBy(name)


def in_size_order(table: DataFrame, size: str = "model_size") -> DataFrame:
    return table.orderBy(size_order(F.col(size)))


def code_class_table(rates: DataFrame, strata: DataFrame, granular: DataFrame, keys: list[str],
                     rate_columns: list[str]) -> DataFrame:
    """Error rates, F1 per training stratum and full-code macro F1 of every (size, mode)."""
    by_stratum = strata.groupBy(*keys).agg(
        *[F.max(F.when(F.col("stratum") == s, F.col("f1"))).alias(f"f1_{s}") for s in ("head", "body", "tail")]
    )
    full = granular.filter((F.col("granularity") == "full") & (F.col("metric_type") == "macro")).select(
        *keys, (F.col("f1") * 100).alias("full_code_f1")
    )
    return rates.select(*keys, *rate_columns).join(by_stratum, keys).join(full, keys)


def trace_counts(instructions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows with and without reasoning per stage."""
    return instructions.groupBy(*(by or []), "Verifier").agg(
        F.count("*").alias("total"), F.count_if("trace").alias("reasoning"),
        F.count_if(~F.col("trace")).alias("fallback"),
    )
