"""Scans: notes, dictionaries, schemes, per-model files, result files, prediction dumps."""

from __future__ import annotations

import functools
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorefold.functions.parsing import parse_list
from scorefold.functions.text import none_if_empty, without_prefix
from scorefold.schemas import ADMISSION_FILES, COMPLAINT_SYNONYMS, DISCHARGE_FILES
from scorefold.session import cut_lineage

# The arrays of a prediction dump, with their names here.
DUMP_KEYS = {"annotated_codes": "gold", "predicted_codes": "full", "predicted_codes@20": "top_n", "unique_labels": None}
# List columns that result files may hold as text.
TEXT_LISTS = ("v2_preds", "v4_preds", "v2_json", "v4_json")


def file_path() -> Column:
    return F.col("_metadata.file_path")


def file_stem() -> Column:
    """Name of the file, or of the Spark output folder it lies in, without extension."""
    # A match lies within the last two names; trying every letter of a long path before them is slow.
    return F.regexp_extract(F.substring_index(file_path(), "/", -2), r"([^/]+?)\.(?:pq|parquet|csv|json|yaml)(?:/[^/]+)?$", 1)


def _tree(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """All Parquet files below ``root``, single files and Spark output folders alike.

    With a schema no file is opened before it is read; without one all footers are merged.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pq,parquet}")
    return (reader.schema(schema) if schema else reader.option("mergeSchema", "true")).parquet(root)


def _marked(rows: DataFrame) -> DataFrame:
    """Adds the split a row of files is read in, and its place there."""
    at = F.struct(file_path().alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return rows.select("*", at.alias("_split"), F.monotonically_increasing_id().alias("_at"))


def _numbered(marked: DataFrame) -> DataFrame:
    """Adds ``pos`` in place of the marks. Rows of a split stand in a row, so the first place of each split is all it takes."""
    splits = marked.groupBy("_split").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    found = sorted((r["_split"], r["first"], r["n"]) for r in splits.collect())  # one row for each split
    before = [0, *accumulate(n for _, _, n in found)]
    starts = marked.sparkSession.createDataFrame(
        [(tuple(s), b - first) for (s, first, _), b in zip(found, before)], "_split struct<file string, start bigint>, _shift bigint"
    )
    return marked.join(F.broadcast(starts), "_split").withColumn("pos", F.col("_shift") + F.col("_at")).drop("_split", "_at", "_shift")


def _in_order(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of each row in its file (or files, by name), from 0.

    A file may be read in several splits: rows are numbered inside a split and start after
    those of the splits before it. Nothing is sorted or shuffled.
    """
    return _numbered(_marked(rows))


NOTE_FILE = r"(train|dev|test)_(\d+)_(hosp|icu)\.pq"


def _tagged(df: DataFrame) -> DataFrame:
    path = file_path()
    return df.withColumns(
        {
            "split": F.regexp_extract(path, NOTE_FILE, 1),
            "ICD_version": F.regexp_extract(path, NOTE_FILE, 2).cast("int"),
            "data_source": F.regexp_extract(path, NOTE_FILE, 3),
        }
    )


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Admission notes with their discharge note, tagged by version, source and split.

    Files are ``<root>/{admission,discharge}_notes/icd-*/*/<split>_<version>_<source>.pq``.
    Discharge notes of all splits are looked up within one version and source.
    """
    discharge = _tagged(_tree(spark, f"{root}/discharge_notes", DISCHARGE_FILES)).select(
        "hadm_id", "ICD_version", "data_source", F.col("text").alias("discharge_note")
    )
    admission = _tagged(_tree(spark, f"{root}/admission_notes", ADMISSION_FILES))
    keys = ["hadm_id", "ICD_version", "data_source"]
    return admission.join(discharge, keys, "left").select(
        "subject_id", "hadm_id", "charttime", F.col("LONG_CODES").alias("ICD_CODES"),
        F.col("TEXT").alias("admission_note"), "discharge_note", "ICD_version", "data_source", "split",
    )


def read_admissions(spark: SparkSession, path: str) -> DataFrame:
    """Admission and discharge times from CSV."""
    raw = spark.read.csv(path, header=True)
    return raw.select(
        F.col("hadm_id").cast("bigint"), F.to_timestamp("admittime").alias("admittime"),
        F.to_timestamp("dischtime").alias("dischtime"),
    )


def read_labevents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(
        "hadm_id", "itemid", F.col("storetime").cast("timestamp").alias("storetime"),
        "valuenum", "valueuom", "label", "flag",
    )


def read_complaints(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], dict[str, str]]:
    """The complaint dictionary: phrases per complaint and system per complaint.

    This is configuration of a few rows that becomes part of the query text.
    """
    table = spark.read.csv(path, header=True, schema=COMPLAINT_SYNONYMS, escape='"')
    parsed = table.select(
        "chief_complaint", F.from_json("synonyms", "array<string>").alias("phrases"), "systems"
    )
    rows = parsed.collect()
    return ({r["chief_complaint"]: r["phrases"] for r in rows},
            {r["chief_complaint"]: r["systems"] for r in rows})


def read_diseases(spark: SparkSession, root: str, complaints: list[str]) -> DataFrame:
    """Disease dictionaries of the complaints, one CSV each, features in file order."""
    tables = []
    for complaint in complaints:
        path = f"{root}/{complaint.replace(' ', '_')}.csv"
        raw = spark.read.csv(path, header=True)
        features = [c for c in raw.columns if c not in ("Disease", "Synonyms", "icd10_regex")]
        tables.append(
            _in_order(raw).select(
                F.lit(complaint).alias("chief_complaint"), F.col("pos").cast("int"),
                F.col("Disease").alias("disease"), F.col("Synonyms").alias("synonyms"), "icd10_regex",
                F.array(*[F.col(f"`{c}`").cast("int") for c in features]).alias("features"),
            )
        )
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def read_schemes(spark: SparkSession, root: str) -> DataFrame:
    """Feature schemes, one ``feature: [low, .., high]`` line per feature and file."""
    text = spark.read.text(f"{root}/*.yaml", wholetext=True).select(
        F.replace(file_stem(), F.lit("_"), F.lit(" ")).alias("chief_complaint"), "value"
    )
    lines = text.select("chief_complaint", F.posexplode(F.split("value", r"\R")).alias("line_no", "line"))
    pattern = r"^(.*?):\s*\[(.*)\]"
    values = F.transform(
        F.split(F.regexp_extract("line", pattern, 2), ","), lambda v: F.trim(v).cast("int")
    )
    return lines.filter(F.col("line").rlike(pattern)).select(
        "chief_complaint", F.col("line_no").alias("pos"),
        F.trim(F.regexp_extract("line", pattern, 1)).alias("feature"),
        F.array_min(values).alias("min_value"), F.array_max(values).alias("max_value"),
    )


def schemes_by_complaint(schemes: DataFrame) -> DataFrame:
    """Ordered feature list of every complaint (a scheme has a few dozen features)."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "feature")))
    return schemes.groupBy("chief_complaint").agg(
        F.transform(ordered, lambda e: e["feature"]).alias("features")
    )


def read_generated(spark: SparkSession, root: str) -> DataFrame:
    """Generated answers ``<root>/<model>/cc_<complaint>.pq``, with ``model`` and ``cc``."""
    parts = r"([^/]+)/(cc_[^/]+)\.pq"
    df = _tree(spark, root).withColumns(
        {"model": F.regexp_extract(file_path(), parts, 1), "cc": F.regexp_extract(file_path(), parts, 2)}
    )
    return df.filter(F.col("cc") != "")


def read_models(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("combined",)) -> DataFrame:
    """Merged per-model files ``<root>/<model>.pq``, never the combined output of an earlier run."""
    df = _tree(spark, root).withColumn("gen_model", file_stem())
    return df.filter(~F.col("gen_model").isin(list(exclude)) & ~F.col("gen_model").startswith("cc_"))


def read_results(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Evaluation results ``<root>/eval_results_<collection>/*.pq`` with ``collection``.

    With a schema, a filter on ``collection`` leaves the files of other collections unopened.
    """
    folder = F.regexp_extract(file_path(), r"(eval_results_[^/]+)/", 1)
    return _tree(spark, root, schema).withColumn("collection", without_prefix(folder))


def read_newest(spark: SparkSession, root: str, experiments: list[str], k: int = 3, text_lists: tuple[str, ...] = TEXT_LISTS) -> DataFrame:
    """Rows of the ``k`` newest versions over the experiments.

    Files are ``<root>/<experiment>/v<N>/*.pq``; versions run from the highest
    number down, experiments in the given order within a number. Versions are chosen from
    the names of the files, so that no file of another version is opened. Lists that are
    stored as text are parsed.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pq,parquet}").load(root)
    order = F.array_position(F.array(*[F.lit(e) for e in experiments]), F.col("experiment"))
    found = listing.select(
        F.regexp_extract("path", r"^(.*/v\d+)/", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)/v\d+/", 1).alias("experiment"),
        none_if_empty(F.regexp_extract("path", r"/v(\d+)/", 1)).cast("int").alias("version"),
    )
    newest = found.filter(F.col("experiment").isin(experiments) & F.col("version").isNotNull()).distinct().orderBy(F.desc("version"), order).limit(k)
    parts = [
        _folder(spark, r["folder"]).withColumns({"experiment": F.lit(r["experiment"]), "version": F.lit(r["version"])}) for r in newest.collect()  # k rows
    ]
    if not parts:
        raise FileNotFoundError(f"no version of {experiments} below {root}")
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = {c: parse_list(F.col(c)) for c, kind in rows.dtypes if c in text_lists and kind == "string"}
    return rows.withColumns(lists) if lists else rows


def _folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pq,parquet}").parquet(folder)


def _dump_lists(spark: SparkSession, path: str) -> DataFrame:
    """(key, pos, list) of the arrays of a dump, read by as many tasks as the file has splits.

    The text is cut at closing brackets, so that each record ends one inner list, or an
    array. Keys open a section; the lists after a key follow each other. Anything else
    between two lists, and a bracket within a code, stops the job. The text may stand in
    several files of a folder, in the order of their names, each of whole lists.
    """
    key_pattern = r'"((?:[^"\\]|\\.)*)"\s*:\s*\['
    # Records that open no list end an array, the object or a file; they take no place.
    text = spark.read.text(path, lineSep="]").where(F.col("value").contains("["))
    marked = _marked(text).select(
        "_split", "_at", "value", F.regexp_extract("value", key_pattern, 1).alias("key"),
        F.regexp_extract("value", r"(?s)^(.*)\[", 1).alias("head"), F.regexp_extract("value", r"(?s)([^\[]*)$", 1).alias("body"),
    )
    records = _numbered(cut_lineage(marked, "dump"))
    starts = records.filter("key <> ''").select("pos", "key").orderBy("pos").collect()  # one row for each key of the object
    section, start = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for r in starts:
        section = F.when(F.col("pos") >= r["pos"], F.lit(r["key"])).otherwise(section)
        start = F.when(F.col("pos") >= r["pos"], F.lit(r["pos"])).otherwise(start)
    # The first list of a section stands in the record of the key, behind two brackets unless the array is flat or empty.
    placed = records.withColumns({"section": section, "start": start}).filter(F.col("section").isin(list(DUMP_KEYS)))
    plain = F.col("head").rlike(r'^[\s,]*$') | F.col("head").rlike(r'^[\s,{]*"[^"\\]*"\s*:\s*(\[\s*)?$')
    whole = F.length(F.regexp_replace("body", r'(?s)\\.|[^"]', "")) % 2 == 0
    broken = F.raise_error(F.lit("a dump holds lists of codes without brackets only")).cast("array<string>")
    items = F.when(plain & whole, F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<string>")).otherwise(broken)
    nested = F.col("value").rlike(r"\[\s*\[") | (F.col("key") == "")
    return placed.select(F.col("section").alias("key"), (F.col("pos") - F.col("start")).cast("int").alias("pos"), nested.alias("nested"), items.alias("list"))


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A prediction dump: one row per position, and its label vocabulary.

    The file is one JSON object of parallel arrays of lists; it is read in splits.
    """
    lists = cut_lineage(_dump_lists(spark, path), "dump-lists")
    columns = {name: key for key, name in DUMP_KEYS.items() if name}
    rows = lists.filter(F.col("nested") & F.col("key").isin(list(columns.values()))).groupBy("pos").agg(
        *[F.max_by("list", F.when(F.col("key") == key, 1)).alias(name) for name, key in columns.items()]
    )
    return rows, lists.filter("key = 'unique_labels' AND NOT nested").select(F.explode("list").alias("code"))


def read_metrics(spark: SparkSession, path: str, name: str = "collection") -> DataFrame:
    """A metric table from CSV; the first column is the run name, the others are numbers."""
    raw = spark.read.csv(path, header=True)
    first, *rest = raw.columns
    return raw.select(F.col(f"`{first}`").alias(name), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
