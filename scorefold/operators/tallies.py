"""Additive tallies: every metric of a report as sums that can be added up in any order.

A row becomes one entry of its numbers and one entry for each code of its lists, told
apart by ``kind``. One aggregate over (group, kind, bucket, code) turns the entries into
tallies, whatever the number of metrics; the input is read once. Tallies of several
batches, runs or complaints are merged by adding them up again, and a report is one more
aggregate over the merged tallies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorefold.functions.scoring import compare_lists, f1, precision, recall

ROWS = "rows"  # the kind of the entries that hold the numbers of a row
KEYS = ["kind", "bucket", "code"]
FLAGS = ["tp", "fp", "fn"]


def tallies(df: DataFrame, by: list[str], numbers: dict[str, Column], lists: dict[str, tuple[Column, Column]],
            bucket: Column | None = None) -> DataFrame:
    """``by``, kind, bucket, code, n, tp, fp, fn and one sum for each number.

    ``numbers`` are row scores; a missing one adds nothing. ``lists`` holds gold and
    predicted codes per kind. ``bucket`` keeps the sums of rows apart, for means that
    are taken per bucket first.
    """
    bucket = F.lit(None) if bucket is None else bucket
    rows = df.select(
        *by, bucket.cast("int").alias("_bucket"), *[c.cast("double").alias(f"_{n}") for n, c in numbers.items()],
        *[compare_lists(g, p).alias(f"_list_{k}") for k, (g, p) in lists.items()],
    )
    absent = [F.lit(None).cast("double").alias(n) for n in numbers]

    def entry(kind: str, bucket: Column, code: Column, n: Column, flags: list[Column], values: list[Column]) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), bucket.cast("int").alias("bucket"), code.cast("string").alias("code"), n.cast("bigint").alias("n"),
            *[c.cast("bigint").alias(name) for name, c in zip(FLAGS, flags)], *values,
        )

    none = F.lit(None)
    own = entry(ROWS, F.col("_bucket"), none, F.lit(1), [none] * 3, [F.col(f"_{n}").alias(n) for n in numbers])

    def of_codes(kind: str) -> Column:
        return F.transform(f"_list_{kind}", lambda e: entry(kind, none, e["code"], none, [
            e["is_gold"] & e["is_pred"], ~e["is_gold"] & e["is_pred"], e["is_gold"] & ~e["is_pred"]], absent))

    entries = rows.select(*by, F.inline(F.concat(F.array(own), *[of_codes(k) for k in lists])))
    return merged(entries, by)


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Tallies with equal keys added up."""
    values = [c for c in parts.columns if c not in (*by, *KEYS)]
    return parts.groupBy(*by, *KEYS).agg(*[F.sum(c).alias(c) for c in values])


def with_total(parts: DataFrame, by: list[str], group: str, total: str = "All") -> DataFrame:
    """Adds the tallies over all groups under the name ``total``; the rows are not repeated."""
    return merged(parts.withColumn(group, F.explode(F.array(F.col(group), F.lit(total)))), by)


# ---------------------------------------------------------------- expressions for a report over tallies


def is_rows() -> Column:
    return F.col("kind") == ROWS


def count_rows() -> Column:
    return F.coalesce(F.sum(F.when(is_rows(), F.col("n"))), F.lit(0)).cast("bigint")


def total(name: str) -> Column:
    return F.sum(F.when(is_rows(), F.col(name)))


def mean(name: str) -> Column:
    """Mean over all rows; a missing number counts as 0."""
    return F.try_divide(F.coalesce(total(name), F.lit(0.0)), F.sum(F.when(is_rows(), F.col("n"))))


def bucket_mean(name: str, seen: str, digits: int) -> Column:
    """Mean of the bucket means, each rounded and weighted by its rows.

    ``seen`` sums the rows that have the number.
    """
    own = F.round(F.try_divide(F.col(name), F.col(seen)), digits)
    return F.try_divide(F.sum(F.when(is_rows(), own * F.col("n"))), F.sum(F.when(is_rows(), F.col("n"))))


def label_metrics(kind: str) -> dict[str, Column]:
    """tp, fp, fn, n_labels and micro and macro scores of one kind of codes; null without any code."""
    here = F.col("kind") == kind
    counts = [F.sum(F.when(here, F.col(c))) for c in FLAGS]
    tp, fp, fn = counts
    some = F.count_if(here) > 0
    one = [F.col(c) for c in FLAGS]
    out = dict(zip(FLAGS, counts)) | {
        "n_labels": F.when(some, F.count_if(here)),
        "precision_micro": F.when(some, precision(tp, fp)), "recall_micro": F.when(some, recall(tp, fn)), "f1_micro": F.when(some, f1(tp, fp, fn)),
        "precision_macro": F.avg(F.when(here, precision(one[0], one[1]))), "recall_macro": F.avg(F.when(here, recall(one[0], one[2]))),
        "f1_macro": F.avg(F.when(here, f1(*one))),
    }
    return out
