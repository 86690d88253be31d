"""One complaint per admission, the same for every generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorefold.session import cut_lineage

ID = ["subject_id", "hadm_id"]


def common_groups(index: DataFrame, n_models: int | None = None) -> DataFrame:
    """(id, cc) pairs that every model generated.

    ``index`` holds (subject_id, hadm_id, cc, model).
    """
    models = F.lit(n_models) if n_models else index.agg(F.count_distinct("model")).scalar()
    per_pair = index.groupBy(*ID, "cc").agg(F.count_distinct("model").alias("n_models"))
    return per_pair.filter(F.col("n_models") == models).select(*ID, "cc")


def assign(index: DataFrame, n_models: int | None = None) -> DataFrame:
    """The scarcest common complaint of every id; ties go to the first name.

    Ids without a complaint common to all models are left out.
    """
    # Ids only, written once: the sizes, the choice and every model's merge read it.
    common = cut_lineage(common_groups(index, n_models), "common")
    sizes = common.groupBy("cc").agg(F.count("*").alias("size"))
    choice = F.min(F.struct("size", "cc"))
    return common.join(sizes, "cc").groupBy(*ID).agg(choice.alias("c")).select(*ID, F.col("c.cc").alias("cc"))


def keep_assigned(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows filed under the complaint their id was assigned to."""
    return rows.join(assignment, [*ID, "cc"], "left_semi")


def subjects_per_complaint(assignment: DataFrame) -> DataFrame:
    """The saved cohort: distinct (complaint, subject) rows.

    A complaint may have very many subjects, so they stay rows and are never
    gathered into one list.
    """
    name = F.regexp_replace("cc", "^cc_", "")
    return assignment.select(name.alias("cc"), "subject_id").distinct()


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts per model and complaint before and after assignment, with totals."""
    b = before.groupBy("model", "cc").agg(F.count("*").alias("before"))
    a = after.groupBy("model", "cc").agg(F.count("*").alias("after"))
    counts = b.join(a, ["model", "cc"], "left").na.fill(0, ["after"])
    both = counts.withColumn("cc", F.explode(F.array("cc", F.lit("TOTAL"))))
    sums = both.groupBy("model", "cc").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return sums.withColumn("removed", F.col("before") - F.col("after"))


def cross_model_table(counts: DataFrame, models: list[str]) -> DataFrame:
    """Complaints as rows, ``before -> after`` of every model as columns."""
    cells = [
        F.concat_ws(
            "→",
            *[F.coalesce(F.max(F.when(F.col("model") == m, F.col(c))), F.lit(0)).cast("string")
              for c in ("before", "after")],
        ).alias(m)
        for m in models
    ]
    return counts.groupBy("cc").agg(*cells)
