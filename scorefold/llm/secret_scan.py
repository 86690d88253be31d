"""Secret scans over an incremental ledger of blobs.

Every row of a table is a version of a path. Its text is addressed by content; a ledger
keeps the findings of each (blob, version of the rules). Only pairs that the ledger does
not hold are scanned, once however many paths share the blob, and the findings are joined
back to all paths. Everything here is DataFrame operations.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorefold.llm.common import filled, table
from scorefold.llm.registry import query
from scorefold.session import shared_dir


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if the given group has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# A run of hexadecimal digits or key letters is matched whole, so its least length can stand in the pattern.
RULES = (
    Rule("assign", r'''(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, place: int, rule: Rule) -> Column:
    """Spans of one rule in code points: the texts between matches give the positions."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, 0), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length).alias("value"),
    )

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), (start + m["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        counts = F.coalesce(m["value"] >= rule.least, F.lit(False))
        return F.struct(
            (start + F.coalesce(m["size"], F.lit(0))).alias("at"),
            F.when(counts, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    walked = F.aggregate(found, empty, step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPANS))


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then by the order of the rules."""
    return F.array_sort(F.concat(*[_spans(text, place, rule) for place, rule in enumerate(rules)]))


def blob_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(filled(text), 256))


def update_ledger(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the blobs that the ledger at ``path`` does not hold for these rules, append them, return the ledger.

    One row per blob and version of the rules: blob, rules, spans. The folder is
    created when it is missing. Two runs at once may append a blob twice; readers take one
    of equal rows (``held_spans``).
    """
    spark, version = df.sparkSession, rules_version(rules)
    versions = df.select(F.col(key).alias("path"), blob_of(text).alias("blob"))
    chosen = versions.groupBy("blob").agg(F.min("path").alias("path"))
    known = _read(spark, path)
    if known is not None:
        chosen = chosen.join(known.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    texts = df.select(F.col(key).alias("path"), blob_of(text).alias("blob"), filled(text).alias("content"))
    one = chosen.select(F.col("path").alias("one_path"), F.col("blob").alias("one_blob")).hint("shuffle_hash")
    unseen = texts.join(one, F.col("path").eqNullSafe(F.col("one_path")) & (F.col("blob") == F.col("one_blob")))
    found = unseen.select("blob", F.lit(version).alias("rules"), spans_of(F.col("content"), rules).alias("spans"))
    found.dropDuplicates(["blob", "rules"]).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None


def held_spans(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per blob of this version of the rules: blob, spans. Equal blobs have equal spans."""
    return ledger.where(F.col("rules") == rules_version(rules)).select("blob", "spans").dropDuplicates(["blob"])


def scan(df: DataFrame, ledger: str | None = None, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of the input with the spans of its text: key, spans (empty if none).

    Null text is empty text. Rows that share a text or a key each keep their row.
    Without a ledger a new one is begun in the shared folder. Other columns are not
    read; an empty table gives an empty table.
    """
    held = update_ledger(df, ledger or shared_dir(df.sparkSession, "ledger"), text, key, rules)
    held = held_spans(held, rules)
    return df.select(F.col(key), blob_of(text).alias("blob")).join(held, "blob", "left").select(
        key, F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


def redact(df: DataFrame, ledger: str | None = None, text: str = "text", key: str = "doc_id", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES, size: str | None = None) -> DataFrame:
    """All columns; every span of a secret in the text becomes ``mark``. Texts without secrets stay as they are.

    Overlapping spans become one mark. Null text stays null. A column named as
    ``size`` gets the length of each text that was changed.
    """
    held = update_ledger(df, ledger or shared_dir(df.sparkSession, "ledger"), text, key, rules)
    held = held_spans(held, rules).where(F.size("spans") > 0).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    body = F.col(text)

    def step(acc: Column, span: Column) -> Column:
        between = F.substring(body, acc["at"] + 1, F.greatest(span["start"] - acc["at"], F.lit(0)))
        new = F.concat(acc["out"], between, F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], span["end"]).alias("at"),
            F.when(span["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    joined = df.withColumn("__blob", blob_of(text)).join(held, "__blob", "left")
    changed = F.col("__spans").isNotNull()
    out = joined.withColumn(text, F.when(changed, cleaned).otherwise(body))
    if size:
        out = out.withColumn(size, F.when(changed, F.length(text).cast(df.schema[size].dataType)).otherwise(F.col(size)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _kind_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
k{place} AS (SELECT n, list_transform(list_filter(range(1, len(m) + 1), lambda i: length(v[i]) >= {least}),
    lambda i: {{'start': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT,
           'place': {place}, 'size': length(m[i]), 'kind': '{kind}'}}) AS s
  FROM (SELECT n, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d))"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
{",".join(_kind_sql(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(RULES))},
a AS (SELECT doc_id, len(k0.s) AS n_assign, len(k1.s) AS n_access, len(k2.s) AS n_hex,
    array_to_string(list_transform(list_sort(list_concat(list_concat(k0.s, k1.s), k2.s)), lambda x: concat(x.kind, ':', x.start, ':', x.start + x.size)), ',') AS spans
  FROM d JOIN k0 USING (n) JOIN k1 USING (n) JOIN k2 USING (n))
SELECT doc_id, n_assign::BIGINT AS n_assign, n_access::BIGINT AS n_access, n_hex::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM a"""


@query("op8_secret_scan", SQL)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined_spans(F.col("spans")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"),
    )
