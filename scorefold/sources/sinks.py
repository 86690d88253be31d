"""Writers. Large tables stay partitioned; only report tables become one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table, partitioned by low-cardinality columns where given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_cohort(subjects: DataFrame, path: str) -> None:
    """The saved cohort as JSON lines, one folder per complaint."""
    subjects.write.mode("overwrite").partitionBy("cc").json(path)


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject_id bigint, cc string").json(path)


def append_round(scored: DataFrame, path: str) -> None:
    """Save one round of scored candidates; a repeated round replaces itself."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "round").parquet(path)


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def next_step(rounds: DataFrame, accepted: DataFrame, items: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Where to resume: the last saved stage and round, the open items, and whether to move on."""
    at = rounds.agg(F.max(F.struct("stage", "round"))).scalar()
    open_rows = items.join(
        accepted.filter(F.col("accepted") & (F.col("stage") == at["stage"])).select(*keys), keys, "left_anti"
    )
    return open_rows.agg(F.count("*").alias("n_open")).select(
        at["stage"].alias("stage"), at["round"].alias("round"), "n_open",
        ((F.col("n_open") == 0) | (at["round"] >= budget)).alias("stage_done"),
    )


def export_version(df: DataFrame, root: str, version: str, name: str) -> str:
    """Write one dataset version; an existing version is never replaced."""
    path = f"{root}/{version}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path
