"""The given tables in the roles the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorefold.operators.set_metrics import code_lists


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code_column() -> Column:
    """Four characters: a letter by part type, two digits by size, the line number."""
    letter = (
        F.when(F.col("p_type") == "SMALL", "Z").when(F.col("p_type") == "STANDARD", "R")
        .when(F.col("p_type") == "PROMO", "I").otherwise(F.substring("p_type", 1, 1))
    )
    digits = F.when(F.col("p_type") == "SMALL", 50 + F.col("p_size") % 50).otherwise(F.col("p_size"))
    return F.concat(letter, F.lpad(digits.cast("string"), 2, "0"), F.col("l_linenumber").cast("string"))


def code_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per line item: an admission's code, gold and/or predicted by one system."""
    lineitem = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("system"), F.col("l_orderkey").alias("id"),
        (42 + F.col("l_suppkey") % 3).alias("seed"), code_column().alias("code"),
        (F.col("l_quantity") <= 35).alias("is_gold"), (F.col("l_quantity") >= 15).alias("is_pred"),
        F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("line"),
    )


def admissions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as admissions: subject, complaint and split."""
    split = F.when(F.col("o_custkey") % 10 < 7, "train").when(F.col("o_custkey") % 10 < 8, "dev").otherwise("test")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"),
        F.col("o_orderpriority").alias("complaint"), split.alias("split"),
    )


def answer_lists(spark: SparkSession, d: str, keys: tuple[str, ...] = ("system", "id")) -> DataFrame:
    """Ordered gold and predicted codes per system and admission."""
    rows = code_rows(spark, d)
    lists = code_lists(
        rows, list(keys), "code", F.col("line"), -F.col("price"), F.col("is_gold"), F.col("is_pred"), ["id"] if "id" in keys else None
    )
    return lists


CODE_ROWS = """
code_rows AS (
  SELECT l_returnflag AS system, l_orderkey AS id, 42 + l_suppkey % 3 AS seed,
    concat(CASE p_type WHEN 'SMALL' THEN 'Z' WHEN 'STANDARD' THEN 'R' WHEN 'PROMO' THEN 'I' ELSE substr(p_type, 1, 1) END,
      lpad(CAST(CASE WHEN p_type = 'SMALL' THEN 50 + p_size % 50 ELSE p_size END AS VARCHAR), 2, '0'),
      CAST(l_linenumber AS VARCHAR)) AS code,
    l_quantity <= 35 AS is_gold, l_quantity >= 15 AS is_pred, l_extendedprice AS price, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ADMISSIONS = """
adm AS (
  SELECT o_orderkey AS id, o_custkey AS subject_id, o_orderpriority AS complaint,
    CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'dev' ELSE 'test' END AS split
  FROM orders)"""

PAIRS = """
pairs AS (
  SELECT system, id, code, bool_or(is_gold) AS is_gold, bool_or(is_pred) AS is_pred
  FROM code_rows GROUP BY ALL)"""


def lists_sql(keys: str = "system, id") -> str:
    return f"""
best AS (
  SELECT {keys}, code, min(line) FILTER (WHERE is_gold) AS g, min(-price) FILTER (WHERE is_pred) AS p
  FROM code_rows GROUP BY ALL),
lists AS (
  SELECT {keys},
    coalesce(list(code ORDER BY g, code) FILTER (WHERE g IS NOT NULL), []) AS gold,
    coalesce(list(code ORDER BY p, code) FILTER (WHERE p IS NOT NULL), []) AS pred
  FROM best GROUP BY {keys})"""


LISTS = lists_sql()


def counts_sql(by: str, source: str = "pairs", code: str = "code", name: str = "counts") -> str:
    return f"""
{name} AS (
  SELECT {by}, {code} AS code,
    count(*) FILTER (WHERE is_gold AND is_pred) AS tp,
    count(*) FILTER (WHERE NOT is_gold AND is_pred) AS fp,
    count(*) FILTER (WHERE is_gold AND NOT is_pred) AS fn
  FROM {source} GROUP BY ALL)"""


def scored_sql(source: str = "counts", name: str = "scored") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r
    FROM {source}))"""


def micro_macro_sql(by: str, source: str = "scored", name: str = "mm") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN precision_micro + recall_micro > 0
    THEN 2 * precision_micro * recall_micro / (precision_micro + recall_micro) ELSE 0 END AS f1_micro FROM (
    SELECT {by}, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS n_labels,
      CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp))::DOUBLE ELSE 0 END AS precision_micro,
      CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn))::DOUBLE ELSE 0 END AS recall_micro,
      avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro
    FROM {source} GROUP BY {by}))"""


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


MM_COLUMNS = ["precision_micro", "recall_micro", "f1_micro", "precision_macro", "recall_macro", "f1_macro"]


def text_sum(column: Column) -> Column:
    """An order-free checksum of a text column."""
    return F.sum(F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint"))


def text_sum_sql(column: str) -> str:
    return f"sum(CAST('0x' || substr(md5({column}), 1, 8) AS BIGINT))::BIGINT"
