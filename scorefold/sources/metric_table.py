"""A metric table on disk: one row for each run, in buckets by the hash of its name.

An upsert reads and rewrites only the buckets of the names it brings; the files of all
others stay as they are. Every step can be repeated: rows are replaced by name, and a
bucket is only ever written from its own old rows and the new ones.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scorefold.operators import reports
from scorefold.session import cut_lineage

BUCKETS = 64
SETTINGS = "key string, buckets int, columns string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _settings(spark: SparkSession, path: str) -> tuple[str, int, T.StructType]:
    row = spark.read.schema(SETTINGS).parquet(f"{path}/_settings").first()
    return row["key"], row["buckets"], T.StructType.fromJson(json.loads(row["columns"]))


def _set(spark: SparkSession, path: str, key: str, buckets: int, schema: T.StructType) -> None:
    spark.createDataFrame([(key, buckets, schema.json())], SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{path}/_settings")


def _write(table: DataFrame, path: str, key: str, buckets: int) -> None:
    marked = table.withColumn("name_bucket", bucket_of(F.col(key), buckets))
    # One task and one file for each bucket; only the buckets in the table are replaced.
    marked.repartition("name_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name_bucket").parquet(f"{path}/data")


def create(table: DataFrame, path: str, key: str = "collection", buckets: int = BUCKETS) -> None:
    """A new metric table with the rows of ``table``; ``key`` names a run."""
    _write(table, path, key, buckets)
    _set(table.sparkSession, path, key, buckets, table.schema)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows with their bucket; files written before a column came have null there."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("name_bucket", T.IntegerType())])).parquet(f"{path}/data")


def read(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, _settings(spark, path)[2]).drop("name_bucket")


def _merge(new: DataFrame, path: str, replace: bool) -> list[int]:
    spark = new.sparkSession
    key, buckets, schema = _settings(spark, path)
    staged = cut_lineage(new.withColumn("name_bucket", bucket_of(F.col(key), buckets)), "metric-rows")
    touched = [r["name_bucket"] for r in staged.select("name_bucket").distinct().collect()]  # at most ``buckets`` numbers
    old = _stored(spark, path, schema).where(F.col("name_bucket").isin(touched)).drop("name_bucket")
    fresh = staged.drop("name_bucket")
    if replace:
        both = reports.upsert(old, fresh, key)
    else:
        both = old.unionByName(fresh.join(old.select(key), key, "left_anti"), allowMissingColumns=True)
    # The folders that are read here are replaced below.
    both = cut_lineage(both, "metric-merge")
    if set(both.columns) != set(schema.names):
        added = [f for f in both.schema.fields if f.name not in schema.names]
        _set(spark, path, key, buckets, T.StructType([*schema.fields, *added]))
    _write(both, path, key, buckets)
    return sorted(touched)


def upsert(new: DataFrame, path: str) -> list[int]:
    """New rows replace stored ones of the same name; new columns are null in old rows. Returns the rewritten buckets."""
    return _merge(new, path, True)


def append(new: DataFrame, path: str) -> list[int]:
    """New rows whose name is not stored yet; stored rows stay as they are. Returns the rewritten buckets."""
    return _merge(new, path, False)
