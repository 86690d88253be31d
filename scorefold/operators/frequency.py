"""Code frequencies, cumulative shares and cross-tabulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorefold.functions.scoring import bucket_order, rank_bucket, ratio
from scorefold.session import cut_lineage

# The order of splits and match categories in reports.
SPLIT_ORDER = ["train", "dev", "test", "total"]
CATEGORY_ORDER = [0, 1, 2, 3, -1]


def code_frequency(codes: DataFrame, code: str = "code") -> DataFrame:
    return codes.groupBy(code).agg(F.count("*").alias("n"))


def cumulative_share(counts: DataFrame, code: str = "code", n: str = "n") -> DataFrame:
    """Rank by count (ties by code) and running share of the total: a distributed prefix sum.

    The codes are dealt out in order, in ranges of like size, whatever their counts.
    Ranks and sums run inside a range and start after those of the ranges before it.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(n), F.col(code)]
    # Written once, so that every step sees the same ranges.
    dealt = cut_lineage(counts.select(code, n).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = sorted(map(tuple, dealt.groupBy("_part").agg(F.count("*"), F.sum(n)).collect()))  # one row for each range
    starts, rank, total = [], 0, 0
    for part, rows, amount in sums:
        starts.append((part, rank, total))
        rank, total = rank + rows, total + amount
    before = counts.sparkSession.createDataFrame(starts, "_part int, _rank bigint, _sum bigint")
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(F.broadcast(before), "_part").select(
        code, n, (F.col("_rank") + F.row_number().over(inside)).alias("rank"),
        ratio(F.col("_sum") + F.sum(n).over(running), F.lit(total)).alias("cum_share"),
    )


def cutoff_rank(shares: DataFrame, fraction: float) -> DataFrame:
    """Rank at which the running share reaches ``fraction``."""
    return shares.agg((F.count_if(F.col("cum_share") < fraction) + 1).alias("cutoff_rank"))


def category_summary(df: DataFrame, split: str = "split", category: str = "match_category") -> DataFrame:
    """Split by category counts with a total column and a total row."""
    counts = df.groupBy(split, category).agg(F.count("*").alias("n"))
    both = counts.withColumn(split, F.explode(F.array(F.col(split), F.lit("total"))))
    cells = [F.sum(F.when(F.col(category) == c, F.col("n")).otherwise(0)).alias(f"cat_{c}".replace("-", "m"))
             for c in CATEGORY_ORDER]
    order = F.array_position(F.array(*[F.lit(s) for s in SPLIT_ORDER]), F.col(split))
    return (
        both.groupBy(split).agg(*cells, F.sum("n").alias("total"))
        .filter(order > 0).orderBy(order)
    )


def category_shares(df: DataFrame, group: str, category: str = "match_category") -> DataFrame:
    """Counts and row percentages per group, largest group first."""
    names = {c: f"cat_{c}".replace("-", "m") for c in CATEGORY_ORDER}
    wide = df.groupBy(group).agg(
        *[F.count_if(F.col(category) == c).alias(a) for c, a in names.items()],
        F.count_if(F.col(category).isNotNull()).alias("total"),
    )
    shares = [F.round(100 * ratio(F.col(a), F.col("total")), 1).alias(f"{a}_pct") for a in names.values()]
    return wide.select("*", *shares).orderBy(F.desc("total"), group)


def rank_grid(df: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """Counts over two bucketed ranks, in bucket order."""
    grid = df.groupBy(
        rank_bucket(F.col(a), k).alias("bucket_a"), rank_bucket(F.col(b), k).alias("bucket_b")
    ).agg(F.count("*").alias("n"))
    return grid.orderBy(bucket_order(F.col("bucket_a")), bucket_order(F.col("bucket_b")))


def label_space(df: DataFrame, label: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct labels (per group)."""
    return df.select(*(by or []), label.alias("label")).distinct()
