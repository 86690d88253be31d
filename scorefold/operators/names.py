"""Run names as dimensions, and the table of checkpoint metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorefold.functions.text import none_if_empty

# Run families as name -> (model size, dataset, mode).
FAMILIES = {
    "32b-r256-icd2": ("32b", "icd2", "lora"),
    "32b-r256-thrfull-icd2": ("32b", "thrfull-icd2", "lora"),
    "8b-full-icd2": ("8b", "icd2", "full"),
    "8b-full-thrfull-icd2": ("8b", "thrfull-icd2", "full"),
    "8b-full-mimic": ("8b", "mimic", "full"),
    "8b-full-mimic-icd2": ("8b", "mimic-icd2", "full"),
    "8b-full-thrfulldrop": ("8b", "thrfulldrop", "full"),
    "14b-r128": ("14b", "thrfull-icd2", "lora"),
    "06b-r128": ("0.6b", "thrfull-icd2", "lora"),
    "06b-full": ("0.6b", "thrfull-icd2", "full"),
    "14b-full-thrfull-icd2": ("14b", "thrfull-icd2", "full"),
    "32b-full-thrfull-icd2": ("32b", "thrfull-icd2", "full"),
    "8b-r128-thrfull-icd2": ("8b", "thrfull-icd2", "lora"),
    "8b-full-replace": ("8b", "replace", "full"),
    "8b-full-thrhalf": ("8b", "thrhalf", "full"),
    "8b-full-thrfull": ("8b", "thrfull", "full"),
}

# Test-split families as name -> (model size, dataset, mode).
TEST_FAMILIES = {
    "test-06b-full": ("0.6b", "thrfull-icd2", "full"),
    "test-06b-r128": ("0.6b", "thrfull-icd2", "lora"),
    "test-8b-full": ("8b", "thrfull-icd2", "full"),
    "test-8b-r128": ("8b", "thrfull-icd2", "lora"),
    "test-14b-full": ("14b", "thrfull-icd2", "full"),
    "test-14b-r128": ("14b", "thrfull-icd2", "lora"),
    "test-32b-full": ("32b", "thrfull-icd2", "full"),
    "test-32b-r256": ("32b", "thrfull-icd2", "lora"),
}

# External models evaluated once on the test split.
EXTERNAL_MODELS = {
    "test-baichuan-m2-32b": "Baichuan-M2-32B",
    "test-meditron3-8b": "MEDITRON3-8B",
    "test-medgemma-27b-it": "MedGemma-27B-it",
    "test-llama-3-70b-instruct": "Llama-3.3-70B-Instruct",
}

# The forms of a run name.
BASE_NAME = r"^(?:test-)?(\d+)b-base$"
SEEDED_BASE_NAME = r"^test-(\d+)b-base-seed(\d+)-seed\d+$"
SEEDED_RUN_NAME = r"^(test-.+)-seed(\d+)-e(\d+)-seed\d+$"
RUN_NAME = r"^(.+)-e(\d+)$"
DEFAULT_SEED = 42

DIMENSIONS = [
    "model_size", "dataset", "mode", "epoch", "is_base", "is_test", "is_external", "seed",
    "model_name",
]


def _values(spark: SparkSession, rows: list[tuple[str, ...]], columns: list[str]) -> DataFrame:
    """A fixed table of the plan; its size is known to the optimizer."""
    text = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(columns)})")


def families(spark: SparkSession) -> DataFrame:
    rows = [(n, *v, "dev") for n, v in FAMILIES.items()] + [(n, *v, "test") for n, v in TEST_FAMILIES.items()]
    return _values(spark, rows, ["_family", "_size", "_dataset", "_mode", "_split"])


def external_models(spark: SparkSession) -> DataFrame:
    return _values(spark, list(EXTERNAL_MODELS.items()), ["_name", "model_name"])


def size_label(digits: Column) -> Column:
    """``06`` is 0.6b, ``14`` is 14b."""
    return F.concat(F.regexp_replace(digits, "^0", "0."), F.lit("b"))


def parse_name(df: DataFrame, name: str = "collection") -> DataFrame:
    """Adds the dimensions of a run name; rows with unknown names are dropped.

    The text is taken apart first; families and external models are then looked
    up in two fixed tables.
    """
    n = F.col(name)

    def part(pattern: str, group: int) -> Column:
        return none_if_empty(F.regexp_extract(n, pattern, group))

    parts = df.withColumns(
        {
            "_base": F.coalesce(part(SEEDED_BASE_NAME, 1), part(BASE_NAME, 1)),
            "_run": F.coalesce(part(SEEDED_RUN_NAME, 1), part(RUN_NAME, 1)),
            "_epoch": F.coalesce(part(SEEDED_RUN_NAME, 3), part(RUN_NAME, 2)),
            "_seed": F.coalesce(part(SEEDED_BASE_NAME, 2), part(SEEDED_RUN_NAME, 2)),
        }
    )
    spark = df.sparkSession
    # Both tables are constants of a few rows.
    joined = parts.join(F.broadcast(families(spark)), F.col("_run") == F.col("_family"), "left")
    joined = joined.join(F.broadcast(external_models(spark)), n == F.col("_name"), "left")
    is_base, is_external = F.col("_base").isNotNull(), F.col("model_name").isNotNull()
    is_run = F.col("_family").isNotNull()
    known = joined.filter(is_base | is_run | is_external)
    return known.withColumns(
        {
            "model_size": F.coalesce(size_label(F.col("_base")), "_size"),
            "dataset": F.col("_dataset"),
            "mode": F.when(is_external, F.lit("external")).otherwise(F.col("_mode")),
            "epoch": F.when(is_run, F.col("_epoch")).cast("int"),
            "is_base": is_base,
            "is_test": is_external | (is_base & n.startswith("test-")) | F.col("_split").eqNullSafe("test"),
            "is_external": is_external,
            "seed": F.coalesce(F.col("_seed").cast("int"), F.lit(DEFAULT_SEED)),
        }
    ).select(*df.columns, *DIMENSIONS)


def checkpoint_table(metrics: DataFrame, name: str = "collection") -> DataFrame:
    """The metric table with its run dimensions in front."""
    values = [c for c in metrics.columns if c != name]
    return parse_name(metrics, name).select(name, *DIMENSIONS, *values)


def checkpoint_summary(table: DataFrame) -> DataFrame:
    """How many rows of each kind a checkpoint table has."""
    base, test, external = F.col("is_base"), F.col("is_test"), F.col("is_external")
    return table.agg(
        F.count("*").alias("n_rows"),
        F.count_if(base).alias("n_base"),
        F.count_if(test).alias("n_test"),
        F.count_if(external).alias("n_external"),
        (F.count("*") - F.count_if(base) - F.count_if(test)).alias("n_dev_runs"),
        F.count_if(F.col("seed") != DEFAULT_SEED).alias("n_seed_repeats"),
    )


def datasets_per_size(table: DataFrame) -> DataFrame:
    """Distinct datasets of the tuned runs and whether a base run exists, per size."""
    return (
        table.filter(F.col("model_size").isNotNull())
        .groupBy("model_size")
        .agg(
            F.array_join(
                F.sort_array(F.collect_set(F.when(~F.col("is_base"), F.col("dataset")))), ","
            ).alias("datasets"),
            F.bool_or("is_base").alias("has_base"),
        )
    )
