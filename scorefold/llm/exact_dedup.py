"""Exact dedup with a two-pass Bloom filter.

Pass one sets the bits of every hash in one filter ("seen") and the bits that are
hit again in a second one ("again"). A hash whose bits are not all set again occurs
once: its row passes straight through. Only the other rows are shuffled, as
fingerprints, and settled exactly. A wrong "maybe" costs a shuffled fingerprint and
never changes the result.

The filter has 16 bits a row and at most 2^MAX_BITS bits (128 MiB), whatever the
size of the corpus. Past that bound more rows are shuffled; the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorefold.llm.bloom import repeated_filter
from scorefold.llm.common import filled, lower_ascii, table
from scorefold.llm.registry import query
from scorefold.session import cut_lineage


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as the empty text."""
    return F.sha2(lower_ascii(filled(text)), 256)


def mark(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key stays; a null key is smaller than
    any other. Rows that repeat both key and text count apart and exactly one of
    them stays. Null text is the empty text. An empty table gives an empty table.
    Other columns of the input are not read.
    """
    prints = cut_lineage(
        df.select(
            F.col(key).alias("k"), F.unhex(digest(F.col(text))).alias("sha"), F.monotonically_increasing_id().alias("tag")
        ).withColumn("h", F.xxhash64("sha")),
        "fingerprints",
    )
    maybe = repeated_filter(prints.select("h"), prints.count())
    flagged = prints.withColumn("maybe", maybe("h"))
    shuffled = flagged.where("maybe").select("k", "sha", "tag")
    groups = cut_lineage(
        shuffled.groupBy("sha").agg(F.max(F.struct("k", "tag")).alias("top"), F.count("*").alias("n")).where("n > 1"),
        "copy-groups",
    )
    settled = shuffled.join(groups, "sha", "left")
    alone = F.col("n").isNull()
    out = settled.select(
        F.col("k").alias(key), F.when(alone, F.col("k")).otherwise(F.col("top.k")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("tag") == F.col("top.tag"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
    passed = flagged.where("not maybe").select(
        F.col("k").alias(key), F.col("k").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return passed.unionByName(out)


def keep(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, all columns. Rows that the filter clears are not shuffled.

    Of the others, the best row of each group is chosen before and after the
    shuffle, so a group of any size sends at most one row from each task. Columns
    of any name pass unchanged.
    """
    columns = df.columns
    whole = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.unhex(digest(F.col(text))).alias("sha"), F.col(key).alias("k"),
    ).withColumn("h", F.xxhash64("sha"))
    prints = cut_lineage(whole.select("h"), "hashes")
    maybe = repeated_filter(prints, prints.count())
    flagged = whole.withColumn("maybe", maybe("h"))
    order = F.struct(F.col("k").isNotNull(), F.col("k"))
    best = flagged.where("maybe").groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return flagged.where("not maybe").select("row.*").unionByName(best.select("row.*"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


@query("op1_exact_dedup", SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in documents."""
    return mark(table(spark, sf_dir, "documents"))
