"""Sources, sinks, data checks and incremental evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.answers import results
from catalog.evaluation import MM_SQL
from catalog.inputs import ADMISSIONS, CODE_ROWS, LISTS, MM_COLUMNS, admissions, answer_lists, rounded, rounded_sql, table
from catalog.registry import CATALOG, query
from catalog.selecting import SCORED, scored
from scorefold.operators import filters as FL, quality as Q
from scorefold.plans import scorecard as SC
from scorefold.session import cut_lineage, shared_dir
from scorefold.sources import readers as RD, sinks as SK
from scorefold.streaming import incremental as INC


@query("s05_file_names", "SELECT 'orders' AS stem, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.option("mergeSchema", "true").parquet(f"{d}/orders.parquet", f"{d}/events.parquet")
    return rows.groupBy(RD.file_stem().alias("stem")).agg(F.count("*").alias("n"))


@query("s04_pruned_scan", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query(
    "s01_j01_u01_read_notes",
    """SELECT o_orderkey AS hadm_id, CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 10 END::INT AS "ICD_version", CASE WHEN o_custkey % 2 = 0 THEN 'hosp' ELSE 'icu' END AS data_source,
      CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'dev' ELSE 'test' END AS split, CASE WHEN o_orderpriority <> '5-LOW' THEN 'discharge ' || o_orderkey END AS discharge_note FROM orders""",
)
def read_notes(spark: SparkSession, d: str) -> DataFrame:
    """Orders written in the folder layout of the notes, one folder per version, source and split."""
    root = shared_dir(spark, "notes")
    rows = table(spark, d, "orders").join(admissions(spark, d), F.col("o_orderkey") == F.col("id")).select(
        F.col("id").alias("hadm_id"), "subject_id", F.col("o_orderdate").alias("charttime"), "split", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", 9).otherwise(10).alias("icd"), F.when(F.col("o_custkey") % 2 == 0, "hosp").otherwise("icu").alias("source"),
        F.array(F.lit("A00")).alias("LONG_CODES"), F.concat(F.lit("admission "), "id").alias("TEXT"), F.concat(F.lit("discharge "), "id").alias("text_"),
    )
    for icd in (9, 10):
        for source in ("hosp", "icu"):
            for split in ("train", "dev", "test"):
                part = rows.filter((F.col("icd") == icd) & (F.col("source") == source) & (F.col("split") == split))
                tail = f"icd-{icd}/{source}/{split}_{icd}_{source}.pq"
                part.select("subject_id", "hadm_id", "charttime", "LONG_CODES", "TEXT").write.parquet(f"{root}/admission_notes/{tail}")
                part.filter("o_orderpriority <> '5-LOW'").select("hadm_id", F.col("text_").alias("text")).write.parquet(f"{root}/discharge_notes/{tail}")
    return RD.read_notes(spark, root).select("hadm_id", "ICD_version", "data_source", "split", "discharge_note")


@query("s06_models_without_own_output", "SELECT 'm' || CAST(event_id % 3 AS VARCHAR) AS gen_model, count(*) AS n FROM events GROUP BY 1")
def models_without_own_output(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "models")
    events = table(spark, d, "events").select("event_id", "value")
    for m in range(3):
        events.filter(F.col("event_id") % 3 == m).write.parquet(f"{root}/m{m}.pq")
    RD.read_models(spark, root).write.parquet(f"{root}/combined.pq")
    return RD.read_models(spark, root).groupBy("gen_model").agg(F.count("*").alias("n"))


@query(
    "s08_s12_results_by_collection",
    f"WITH {CODE_ROWS}, {LISTS} SELECT system AS collection, count(*) AS n, sum(len(pred))::BIGINT AS n_pred FROM lists GROUP BY 1",
)
def results_by_collection(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "results")
    rows = answer_lists(spark, d)
    for system in ("A", "N", "R"):
        rows.filter(F.col("system") == system).drop("system").write.parquet(f"{root}/eval_results_{system}/eval_results_{system}.pq")
    return RD.read_results(spark, root).groupBy("collection").agg(F.count("*").alias("n"), F.sum(F.size("pred")).alias("n_pred"))


@query(
    "s09_partitioned_sink",
    f"WITH {ADMISSIONS} SELECT split, complaint, count(*) AS n FROM adm WHERE split = 'test' GROUP BY ALL",
)
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "table")
    SK.write_table(admissions(spark, d), path, ["split"])
    return spark.read.parquet(path).filter("split = 'test'").groupBy("split", "complaint").agg(F.count("*").alias("n"))


@query("s10_report_sink", "SELECT event_type AS collection, count(*)::DOUBLE AS n, round(avg(value), 3) AS mean FROM events GROUP BY 1")
def report_sink(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "report")
    report = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"))
    SK.write_report(report, path)
    return RD.read_metrics(spark, path)


@query("s13_cohort_sink", "SELECT DISTINCT o_orderpriority AS cc, o_custkey AS subject_id FROM orders")
def cohort_sink(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "cohort")
    SK.write_cohort(admissions(spark, d).select(F.col("complaint").alias("cc"), "subject_id").distinct(), path)
    return SK.read_cohort(spark, path).select("cc", "subject_id")


@query("s14_round_checkpoint", f"WITH {SCORED} SELECT stage, round, count(*) AS n, count(score) AS n_valid FROM cand GROUP BY ALL")
def round_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Rounds saved one after the other, the last one twice."""
    path = shared_dir(spark, "rounds")
    rows = scored(spark, d)
    SK.append_round(rows.filter("round < 4"), path)
    for _ in range(2):
        SK.append_round(rows.filter("round = 4"), path)
    return SK.read_rounds(spark, path).groupBy("stage", "round").agg(F.count("*").alias("n"), F.count("score").alias("n_valid"))


@query(
    "s15_s16_newest_versions",
    "SELECT 'exp' AS experiment, (event_id % 5)::INT AS version, count(*) AS n FROM events WHERE event_id % 5 >= 2 GROUP BY ALL",
)
def newest_versions(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "versions")
    events = table(spark, d, "events").select("event_id", "value")
    for v in range(5):
        SK.export_version(events.filter(F.col("event_id") % 5 == v), f"{root}/exp", f"v{v}", "data.pq")
    newest = RD.read_newest(spark, root, ["exp"], 3)
    return newest.groupBy("experiment", "version").agg(F.count("*").alias("n"))


# --- dictionaries and dumps in files -------------------------------------------------


@query(
    "s02_read_diseases",
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'back pain' ELSE 'cough' END AS chief_complaint, (row_number() OVER (PARTITION BY p_size % 2 ORDER BY p_partkey) - 1)::INT AS pos,
    'part ' || p_partkey AS disease, '^' || p_type AS icd10_regex, (p_size % 3 - 1) || ',' || (p_partkey % 3 - 1) AS features FROM part""",
)
def read_diseases(spark: SparkSession, d: str) -> DataFrame:
    """Parts as two dictionaries in CSV files; their order in the file is kept."""
    root = shared_dir(spark, "diseases")
    for odd, name in enumerate(("back_pain", "cough")):
        lines = table(spark, d, "part").filter(F.col("p_size") % 2 == odd).select(
            F.concat(F.lit("part "), "p_partkey").alias("Disease"), F.lit("").alias("Synonyms"), F.concat(F.lit("^"), "p_type").alias("icd10_regex"),
            (F.col("p_size") % 3 - 1).alias("Onset: Acute"), (F.col("p_partkey") % 3 - 1).alias("Pain"), "p_partkey",
        )
        lines.coalesce(1).sortWithinPartitions("p_partkey").drop("p_partkey").write.csv(f"{root}/{name}.csv", header=True)
    return RD.read_diseases(spark, root, ["back pain", "cough"]).select(
        "chief_complaint", "pos", "disease", "icd10_regex", F.array_join(F.col("features").cast("array<string>"), ",").alias("features")
    )


@query(
    "s03_read_schemes",
    """SELECT lower(r_name) AS chief_complaint, n_name AS feature, -(n_nationkey % 2)::INT AS min_value, (n_nationkey % 3)::INT AS max_value,
    (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS pos FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def read_schemes(spark: SparkSession, d: str) -> DataFrame:
    """Nations as features of one scheme file per region."""
    root = shared_dir(spark, "schemes")
    line = F.concat("n_name", F.lit(": ["), (-(F.col("n_nationkey") % 2)).cast("string"), F.lit(", "), (F.col("n_nationkey") % 3).cast("string"), F.lit("]"))
    for r in table(spark, d, "region").collect():  # one file for each region
        features = table(spark, d, "nation").filter(F.col("n_regionkey") == r["r_regionkey"])
        lines = features.coalesce(1).sortWithinPartitions("n_nationkey").select(line)
        lines.write.text(f"{root}/{r['r_name'].lower().replace(' ', '_')}.yaml")
    return RD.read_schemes(spark, root).select("chief_complaint", "feature", "min_value", "max_value", "pos")


@query(
    "s07_read_dump",
    f"""WITH {CODE_ROWS}, {LISTS}, x AS (SELECT *, row_number() OVER (ORDER BY system, id) - 1 AS pos FROM lists)
    SELECT pos::INT AS pos, array_to_string(gold, ',') AS gold, array_to_string(pred, ',') AS "full", array_to_string(pred[1:2], ',') AS top_n FROM x""",
)
def read_dump(spark: SparkSession, d: str) -> DataFrame:
    """All lists as the parallel arrays of one JSON object, written in order by ranges, one file each, and read in splits."""
    path = shared_dir(spark, "dump")
    rows = cut_lineage(answer_lists(spark, d), "lists")
    first = rows.agg(F.min(F.struct("system", "id"))).first()[0]
    columns = {"annotated_codes": F.col("gold"), "predicted_codes": F.col("pred"), "predicted_codes@20": F.slice("pred", 1, 2)}
    starts = F.array(*[F.lit(("{" if k == 0 else "], ") + f'"{c}": [') for k, c in enumerate(columns)])
    opens = (F.col("system") == first["system"]) & (F.col("id") == first["id"])
    lines = rows.select("system", "id", F.posexplode(F.array(*[F.to_json(c) for c in columns.values()])).alias("k", "v")).select(
        "k", "system", "id", F.concat(F.when(opens, F.get(starts, F.col("k"))).otherwise(", "), "v").alias("line")
    )
    end = spark.createDataFrame([(len(columns), "", 0, '], "unique_labels": ["A00"]}')], lines.schema)
    lines.unionByName(end).orderBy("k", "system", "id").select("line").write.text(f"{path}/dump.json")
    rows, _ = RD.read_dump(spark, f"{path}/dump.json")
    return rows.select("pos", *[F.array_join(c, ",").alias(c) for c in ("gold", "full", "top_n")])


# --- incremental evaluation ---------------------------------------------------------


@query("st1_incremental_evaluation", f"{MM_SQL}, n AS (SELECT system, count(DISTINCT id) AS n_samples FROM code_rows GROUP BY 1) SELECT system AS collection, tp, fp, fn, n_labels, n_samples, {rounded_sql(MM_COLUMNS)} FROM mm JOIN n USING (system)")
def incremental_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Two arrivals of prediction files; the second run reads only the new ones."""
    inbox, evaluation = shared_dir(spark, "inbox"), INC.Evaluation(INC.new_state(spark), INC.list_tallies(), INC.list_scores)
    rows = answer_lists(spark, d).withColumnRenamed("system", "collection")
    rows = rows.select("collection", "id", "gold", "pred")
    for arrivals in (F.col("collection") == "A", F.col("collection") != "A"):
        rows.filter(arrivals).write.mode("append").parquet(inbox)
        evaluation.run(INC.prediction_stream(spark, inbox, rows.schema))
    return rounded(evaluation.scores(spark), MM_COLUMNS)


@query("st1_streaming_scorecard", CATALOG["a26_scorecard"][1])
def streaming_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """The full scorecard of results that arrive in two parts of each run; the second batch is taken twice, then compacted."""
    inbox = shared_dir(spark, "inbox")
    evaluation = INC.Evaluation(INC.new_state(spark), SC.scorecard_tallies, SC.scorecard_of)
    rows = cut_lineage(SC.parsed_results(results(spark, d)), "results")
    first = F.col("id") % 3 == 0
    rows.filter(first).write.parquet(inbox)
    evaluation.run(INC.prediction_stream(spark, inbox, rows.schema))
    rows.filter(~first).write.mode("append").parquet(inbox)
    evaluation.run(INC.prediction_stream(spark, inbox, rows.schema))
    evaluation.take(rows.filter(~first), 1)
    evaluation.store.compact(spark, 1)
    evaluation.take(rows.filter(~first), 1)
    return evaluation.scores(spark)


# --- data checks -------------------------------------------------------------------


@query(
    "qb_key_differences",
    """WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), h AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '2-HIGH')
    SELECT k, 'left' AS side FROM u WHERE k NOT IN (FROM h) UNION ALL SELECT k, 'right' FROM h WHERE k NOT IN (FROM u)""",
)
def key_differences(spark: SparkSession, d: str) -> DataFrame:
    subjects = admissions(spark, d).select(F.col("subject_id").alias("k"), "complaint")
    return Q.key_differences(subjects.filter("complaint = '1-URGENT'"), subjects.filter("complaint = '2-HIGH'"), "k")


@query(
    "j12_qc_misaligned",
    f"WITH {CODE_ROWS}, {LISTS} SELECT system || '-' || id AS pos FROM lists WHERE len(gold) > 1 AND substr(gold[1], 1, 3) <> substr(gold[2], 1, 3) AND id % 5 = 0",
)
def misaligned(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth gold list is swapped at its head; exactly the lists that change must be found."""
    rows = answer_lists(spark, d).select("id", F.concat_ws("-", "system", F.col("id").cast("string")).alias("pos"), F.col("gold").alias("SHORT_CODES"))
    cut = F.transform("SHORT_CODES", lambda c: F.substring(c, 1, 3))
    swapped = F.concat(F.slice("SHORT_CODES", 2, 1), F.slice("SHORT_CODES", 1, 1), F.slice("SHORT_CODES", 3, F.size("SHORT_CODES")))
    gold = F.when((F.col("id") % 5 == 0) & (F.size("SHORT_CODES") > 1), F.transform(swapped, lambda c: F.substring(c, 1, 3))).otherwise(cut)
    return Q.misaligned(rows.select("pos", gold.alias("gold")), rows.drop("id"))


@query(
    "j17_qd_split_membership",
    f"WITH {ADMISSIONS}, ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 48) SELECT split, count(ids.id) AS n_ids FROM adm LEFT JOIN ids USING (id) GROUP BY split",
)
def split_membership(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("id"))
    return Q.split_membership(ids, admissions(spark, d), "id")


@query(
    "qd_leaks",
    f"WITH {ADMISSIONS} SELECT split, count(DISTINCT id) AS n_ids FROM adm JOIN lineitem ON l_orderkey = id WHERE l_quantity > 48 AND split <> 'test' GROUP BY split",
)
def leaks(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("id"))
    return Q.leaks(ids, admissions(spark, d), "id")


@query("qe_uneven_sizes", "SELECT event_type, min(n) AS min_n, max(n) AS max_n FROM (SELECT event_type, event_id % 3 AS seed, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1 HAVING min(n) <> max(n)")
def uneven_sizes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 3).alias("seed")).agg(F.count("*").alias("n_samples"))
    return Q.uneven_sizes(files, "event_type")


@query("qf_length_mismatches", f"WITH {CODE_ROWS}, {LISTS} SELECT system, count(*) AS n FROM lists WHERE len(gold) <> len(pred) GROUP BY 1")
def length_mismatches(spark: SparkSession, d: str) -> DataFrame:
    bad = Q.length_mismatches(answer_lists(spark, d), F.col("gold"), F.col("pred"))
    return bad.groupBy("system").agg(F.count("*").alias("n"))


@query("qh_unknown_splits", "SELECT lang AS split, count(*) AS count FROM documents WHERE lang <> 'en' GROUP BY 1")
def unknown_splits(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("lang") == "en", "val").otherwise(F.col("lang"))
    return FL.unknown_splits(table(spark, d, "documents").select(split.alias("split")))


@query("qi_repeated_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return Q.repeated_ids(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("j08_qc_unmatched", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    return Q.unmatched(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])
