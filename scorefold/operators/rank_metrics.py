"""Ranking, single-label, vector and validity metrics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorefold.functions import parsing as P
from scorefold.functions.scoring import cosine, hit_at, norm_dot, reciprocal_rank, zero_filled
from scorefold.operators.set_metrics import code_counts, micro_macro

# The cut-offs of recall@k and the digits of the group means.
RECALL_KS = (1, 3, 5, 10)
GROUP_DIGITS = 4


def ranking(df: DataFrame, by: list[str], pred: Column, truth: Column, ks: tuple[int, ...] = RECALL_KS) -> DataFrame:
    """MRR and recall@k for one true label per row."""
    return df.groupBy(*by).agg(
        F.avg(reciprocal_rank(pred, truth)).alias("mrr"),
        *[F.avg(F.coalesce(hit_at(pred, truth, k), F.lit(0))).alias(f"recall_at_{k}") for k in ks],
    )


def top1_f1(df: DataFrame, by: list[str], pred: Column, truth: Column) -> DataFrame:
    """Micro and macro F1 of the first prediction; an empty list predicts ''."""
    first = F.coalesce(F.get(pred, F.lit(0)), F.lit(""))
    hit = [F.struct(truth.alias("code"), F.lit(True).alias("is_gold"), F.lit(True).alias("is_pred"))]
    miss = [
        F.struct(truth.alias("code"), F.lit(True).alias("is_gold"), F.lit(False).alias("is_pred")),
        F.struct(first.alias("code"), F.lit(False).alias("is_gold"), F.lit(True).alias("is_pred")),
    ]
    pairs = df.select(*by, F.inline(F.when(first == truth, F.array(*hit)).otherwise(F.array(*miss))))
    return micro_macro(code_counts(pairs, by), by).select(
        *by, F.col("f1_micro").alias("f1_micro_at_1"), F.col("f1_macro").alias("f1_macro_at_1")
    )


def vector_agreement(df: DataFrame, by: list[str], pred: Column, label: Column,
                     digits: int | None = GROUP_DIGITS) -> DataFrame:
    """Cosine and normalised dot product, averaged over groups of equal label length.

    Group means are rounded to ``digits`` before they are weighted by group
    size; ``None`` keeps them as they are. Labels without entries score 0.
    """
    filled = zero_filled(pred, label)
    rows = df.select(
        *by, F.size(label).alias("length"), cosine(filled, label).alias("cos"),
        norm_dot(filled, label, empty=0.0).alias("dot"),
    )

    def mean(c: str) -> Column:
        return F.round(F.avg(c), digits) if digits is not None else F.avg(c)

    groups = rows.groupBy(*by, "length").agg(
        F.count("*").alias("n"), mean("cos").alias("cos"), mean("dot").alias("dot")
    )
    return groups.groupBy(*by).agg(
        *[
            (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(name)
            for c, name in (("cos", "cos_sim"), ("dot", "dot_product"))
        ]
    )


def answer_validity(df: DataFrame, by: list[str], answers: dict[str, str]) -> DataFrame:
    """Share of rows with a usable answer, per ``output name -> column``."""
    present = {name: c for name, c in answers.items() if c in df.columns}
    return df.groupBy(*by).agg(
        *[F.avg(P.is_valid_cell(F.col(c)).cast("int")).alias(name) for name, c in present.items()]
    )


def list_lengths(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """Mean list lengths, two digits."""
    return df.groupBy(*by).agg(
        *[F.round(F.avg(F.coalesce(F.size(c), F.lit(0))), 2).alias(name) for name, c in columns.items()]
    )
