"""Evaluate newly arrived results with Structured Streaming.

A batch is reduced to additive tallies per run and kept in a store of its own folder, so
a repeated batch replaces itself; the reports are made from the sum over all batches.
The results of a run may therefore arrive in several batches. After each batch the
scorecards of the runs it brought are made anew from the store, of which only their
buckets are read, and put into the metric table. Older batches are compacted into one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scorefold.operators import tallies as TA
from scorefold.session import cut_lineage, shared_dir
from scorefold.sources import metric_table as MT

BUCKETS = 64
COMPACT_EVERY = 20  # batches
LOG = "upto bigint, columns string"


def prediction_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files below ``path`` as a stream."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").parquet(path)
    )


@dataclass(frozen=True)
class TallyStore:
    """Tallies by batch and by bucket of the run's name, below one folder.

    ``merged`` holds compacted batches, each up to a number; ``log`` tells which are
    complete. Readers take the newest of them and all batches after it. A bucket of a
    batch is one file.
    """

    path: str
    key: str = "collection"
    buckets: int = BUCKETS

    def create(self, spark: SparkSession, schema: T.StructType) -> None:
        """An empty store for tallies of this schema."""
        self._log_entry(spark, -1, schema, "overwrite")

    def _log_entry(self, spark: SparkSession, upto: int, schema: T.StructType, mode: str) -> None:
        spark.createDataFrame([(upto, schema.json())], LOG).coalesce(1).write.mode(mode).parquet(f"{self.path}/log")

    def _log(self, spark: SparkSession) -> tuple[int, T.StructType]:
        newest = spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy(F.desc("upto")).first()
        return newest["upto"], T.StructType.fromJson(json.loads(newest["columns"]))

    def put(self, tallies: DataFrame, batch: int) -> None:
        """Keep the tallies of a batch in place of those it had before."""
        self._write(tallies, f"{self.path}/batches/batch={batch}")

    def _write(self, tallies: DataFrame, path: str) -> None:
        marked = tallies.withColumn("name_bucket", MT.bucket_of(F.col(self.key), self.buckets))
        marked.repartition("name_bucket").write.mode("overwrite").partitionBy("name_bucket").parquet(path)

    def _read(self, spark: SparkSession, path: str, schema: T.StructType, *more: str) -> DataFrame:
        columns = [*schema.fields, *[T.StructField(c, T.LongType()) for c in ("name_bucket", *more)]]
        return spark.read.schema(T.StructType(columns)).parquet(f"{self.path}/{path}")

    def _parts(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        """The newest compacted part and all batches after it, before ``below``."""
        upto, schema = self._log(spark)
        later = self._read(spark, "batches", schema, "batch").where(F.col("batch") > upto)
        later = (later if below is None else later.where(F.col("batch") < below)).drop("batch")
        return later if upto < 0 else self._read(spark, f"merged/upto={upto}", schema).unionByName(later)

    def read(self, spark: SparkSession, runs: DataFrame | None = None) -> DataFrame:
        """Tallies over all batches, of the given runs only where there are any; other buckets are not read."""
        parts = self._parts(spark)
        if runs is not None:
            names = runs.select(self.key).distinct()
            touched = names.select(MT.bucket_of(F.col(self.key), self.buckets).alias("name_bucket")).distinct().collect()  # at most ``buckets``
            parts = parts.where(F.col("name_bucket").isin([r["name_bucket"] for r in touched])).join(names, self.key, "left_semi")
        return TA.merged(parts.drop("name_bucket"), [self.key])

    def compact(self, spark: SparkSession, below: int) -> None:
        """Bring all batches before ``below`` together. The newest batch may be repeated, so it must not be among them."""
        upto, schema = self._log(spark)
        if below - 1 > upto:
            self._write(TA.merged(self._parts(spark, below).drop("name_bucket"), [self.key]), f"{self.path}/merged/upto={below - 1}")
            self._log_entry(spark, below - 1, schema, "append")


@dataclass(frozen=True)
class Evaluation:
    """How arriving rows become tallies and tallies a report, and where both are kept."""

    state: str
    tallies: Callable[[DataFrame, list[str]], DataFrame]
    report: Callable[[DataFrame, list[str]], DataFrame]
    key: str = "collection"
    buckets: int = BUCKETS
    compact_every: int = COMPACT_EVERY

    @property
    def store(self) -> TallyStore:
        return TallyStore(f"{self.state}/tallies", self.key, self.buckets)

    @property
    def metrics(self) -> str:
        """Folder of the metric table."""
        return f"{self.state}/metrics"

    def take(self, batch: DataFrame, number: int, done: DataFrame | None = None) -> None:
        """Keep one batch and bring the reports of its runs up to date; may be repeated with the same number."""
        spark = batch.sparkSession
        if done is not None:
            batch = batch.join(done.select(self.key).distinct(), self.key, "left_anti")
        parts = cut_lineage(self.tallies(batch, [self.key]), "batch-tallies")
        if number == 0:
            self.store.create(spark, parts.schema)
        self.store.put(parts, number)
        report = self.report(self.store.read(spark, parts), [self.key])
        if number == 0:
            MT.create(report, self.metrics, self.key, self.buckets)
        else:
            MT.upsert(report, self.metrics)
        if number and number % self.compact_every == 0:
            self.store.compact(spark, number)

    def run(self, stream: DataFrame, done: DataFrame | None = None) -> None:
        """Take everything that has arrived and stop; a later run reads only what is new.

        Runs listed in ``done`` are skipped.
        """
        query = (
            stream.writeStream.foreachBatch(lambda batch, number: self.take(batch, number, done)).trigger(availableNow=True)
            .option("checkpointLocation", f"{self.state}/checkpoint").start()
        )
        query.awaitTermination()

    def scores(self, spark: SparkSession) -> DataFrame:
        """The metric table."""
        return MT.read(spark, self.metrics)


# ---------------------------------------------------------------- reports


def list_tallies(gold: str = "gold", pred: str = "pred") -> Callable[[DataFrame, list[str]], DataFrame]:
    """Tallies of one pair of code lists."""
    return lambda rows, by: TA.tallies(rows, by, {}, {"codes": (F.col(gold), F.col(pred))})


def list_scores(parts: DataFrame, by: list[str]) -> DataFrame:
    """Micro and macro scores and the number of rows."""
    return parts.groupBy(*by).agg(*[c.alias(n) for n, c in TA.label_metrics("codes").items()], TA.count_rows().alias("n_samples"))


def new_state(spark: SparkSession) -> str:
    return shared_dir(spark, "incremental")
