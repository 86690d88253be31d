"""Run names, seeds and report tables over per-run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import counts_sql, code_column, micro_macro_sql, rounded, scored_sql, table
from catalog.registry import query
from scorefold.functions import text as X
from scorefold.functions.scoring import mean_of
from scorefold.operators import filters as FL, names as N, reports as RP, set_metrics as SM
from scorefold.plans import result_tables as RT
from scorefold.session import cut_lineage, shared_dir
from scorefold.sources import metric_table as MT

METRICS = ["f1_micro", "f1_macro", "precision_macro", "recall_macro"]


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as (run name, admission, code) rows."""
    size = F.element_at(F.array(*[F.lit(s) for s in ("06", "8", "14", "32")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(s) for s in (
        "test-medgemma-27b-it", "test-meditron3-8b", "foo-seed45-e1", "test-8b-other-seed43-e1-seed43")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    data = F.element_at(F.array(*[F.lit(s) for s in ("icd2", "mimic", "replace", "thrfull")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    seed = (42 + F.col("l_quantity").cast("int") % 3).cast("string")
    tail = F.when(seed != "42", F.concat(F.lit("-seed"), seed)).otherwise("")
    epoch = F.concat(F.lit("-e"), (1 + F.col("l_linenumber") % 4).cast("string"))
    kind = F.col("l_partkey") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("test-"), size, F.lit("b-base"), tail, tail))
        .when(kind == 1, F.concat(F.lit("test-"), size, F.lit("b-full"), tail, epoch, tail))
        .when(kind == 2, F.concat(F.lit("8b-full-"), data, epoch))
        .when(kind == 3, F.concat(size, F.lit("b-base")))
        .when(kind == 4, other)
        .otherwise(F.concat(F.lit("14b-r128"), epoch))
    )
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        name.alias("collection"), F.col("l_orderkey").alias("id"), code_column().alias("code"),
        (F.col("l_quantity") <= 35).alias("is_gold"), (F.col("l_quantity") >= 15).alias("is_pred"),
    )


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """One metric row per run."""
    pairs = SM.distinct_pairs(run_rows(spark, d), ["collection", "id"])
    sizes = pairs.groupBy("collection").agg(F.count_distinct("id").alias("n_samples"))
    scores = SM.micro_macro(SM.code_counts(pairs, ["collection"]), ["collection"])
    return scores.select("collection", *[F.round(F.col(c) * 100, 2).alias(c) for c in METRICS]).join(sizes, "collection")


def saved_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric table written once, for reports that read it several times."""
    return cut_lineage(metrics(spark, d), "metrics")


RUNS_SQL = f"""run_rows AS (SELECT CASE l_partkey % 6
      WHEN 0 THEN 'test-' || size || 'b-base' || tail || tail WHEN 1 THEN 'test-' || size || 'b-full' || tail || epoch || tail
      WHEN 2 THEN '8b-full-' || ['icd2', 'mimic', 'replace', 'thrfull'][l_suppkey % 4 + 1] || epoch WHEN 3 THEN size || 'b-base'
      WHEN 4 THEN ['test-medgemma-27b-it', 'test-meditron3-8b', 'foo-seed45-e1', 'test-8b-other-seed43-e1-seed43'][l_suppkey % 4 + 1]
      ELSE '14b-r128' || epoch END AS collection, * FROM (
    SELECT *, ['06', '8', '14', '32'][l_suppkey % 4 + 1] AS size, CASE WHEN l_quantity::INT % 3 = 0 THEN '' ELSE '-seed' || (42 + l_quantity::INT % 3) END AS tail, '-e' || (1 + l_linenumber % 4) AS epoch,
      concat(CASE p_type WHEN 'SMALL' THEN 'Z' WHEN 'STANDARD' THEN 'R' WHEN 'PROMO' THEN 'I' ELSE substr(p_type, 1, 1) END,
        lpad(CAST(CASE WHEN p_type = 'SMALL' THEN 50 + p_size % 50 ELSE p_size END AS VARCHAR), 2, '0'), CAST(l_linenumber AS VARCHAR)) AS code
    FROM lineitem JOIN part ON l_partkey = p_partkey)),
  pairs AS (SELECT collection, l_orderkey AS id, code, bool_or(l_quantity <= 35) AS is_gold, bool_or(l_quantity >= 15) AS is_pred FROM run_rows GROUP BY ALL),
  {counts_sql('collection')}, {scored_sql()}, {micro_macro_sql('collection')},
  met AS (SELECT collection, {', '.join(f'round({c} * 100, 2) AS {c}' for c in METRICS)}, n_samples
    FROM mm JOIN (SELECT collection, count(DISTINCT id) AS n_samples FROM pairs GROUP BY 1) USING (collection))"""


def _values(name: str, columns: str, table_: dict) -> str:
    rows = ", ".join("('" + "', '".join([k, *(v if isinstance(v, tuple) else (v,))]) + "')" for k, v in table_.items())
    return f"{name}({columns}) AS (VALUES {rows})"


TABLE_SQL = rf"""{RUNS_SQL}, {_values('fam', 'family, fs, fd, fm', N.FAMILIES)}, {_values('tfam', 'family, ts, td, tm', N.TEST_FAMILIES)}, {_values('ext', 'collection, title', N.EXTERNAL_MODELS)},
  named AS (SELECT met.*, title, regexp_matches(collection, '^(test-)?\d+b-base(-seed\d+-seed\d+)?$') AS is_base, regexp_matches(collection, '^test-.+-seed\d+-e\d+-seed\d+$') AS sr,
      regexp_replace(regexp_extract(collection, '(\d+)b-base', 1), '^0', '0.') || 'b' AS base_size,
      coalesce(nullif(regexp_extract(collection, '^(test-.+)-seed\d+-e\d+-seed\d+$', 1), ''), regexp_extract(collection, '^(.+)-e\d+$', 1)) AS family FROM met LEFT JOIN ext USING (collection)),
  dims AS (SELECT n.*, CASE WHEN is_base THEN base_size ELSE coalesce(ts, fs) END AS model_size, coalesce(td, fd) AS dataset, CASE WHEN title IS NOT NULL THEN 'external' ELSE coalesce(tm, fm) END AS mode,
      CASE WHEN NOT is_base AND coalesce(ts, fs) IS NOT NULL THEN CAST(regexp_extract(collection, '-e(\d+)', 1) AS INT) END AS epoch, starts_with(collection, 'test-') AS is_test, title IS NOT NULL AS is_external,
      coalesce(CAST(nullif(regexp_extract(collection, '-seed(\d+)', 1), '') AS INT), 42) AS seed, title AS model_name
    FROM named n LEFT JOIN tfam USING (family) LEFT JOIN (SELECT fam.* FROM fam) f ON f.family = n.family AND NOT sr),
  ck AS (SELECT collection, model_size, dataset, mode, epoch, is_base, is_test, is_external, seed, model_name, {', '.join(METRICS)}, n_samples FROM dims WHERE model_size IS NOT NULL OR is_external)"""


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return N.checkpoint_table(saved_metrics(spark, d))


@query("f12_d09_checkpoint_table", f"WITH {TABLE_SQL} SELECT * FROM ck")
def checkpoint_table(spark: SparkSession, d: str) -> DataFrame:
    return checkpoints(spark, d)


@query(
    "a38_checkpoint_summary",
    f"""WITH {TABLE_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_base) AS n_base, count(*) FILTER (WHERE is_test) AS n_test, count(*) FILTER (WHERE is_external) AS n_external,
      count(*) - count(*) FILTER (WHERE is_base) - count(*) FILTER (WHERE is_test) AS n_dev_runs, count(*) FILTER (WHERE seed <> 42) AS n_seed_repeats FROM ck""",
)
def checkpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.checkpoint_summary(checkpoints(spark, d))


@query(
    "a38_datasets_per_size",
    f"""WITH {TABLE_SQL} SELECT model_size, coalesce(string_agg(DISTINCT dataset, ',' ORDER BY dataset) FILTER (WHERE NOT is_base), '') AS datasets, bool_or(is_base) AS has_base
    FROM ck WHERE model_size IS NOT NULL GROUP BY model_size""",
)
def datasets_per_size(spark: SparkSession, d: str) -> DataFrame:
    return N.datasets_per_size(checkpoints(spark, d))


@query(
    "f11_f14_c29_c30_run_names",
    rf"""WITH {RUNS_SQL} SELECT collection, coalesce(CAST(nullif(regexp_extract(collection, '-seed(\d+)', 1), '') AS INT), 42) AS seed,
      CAST(nullif(regexp_extract(collection, '-ep?(\d+)(-s\d+)?$', 1), '') AS INT) AS epoch FROM met
    WHERE collection LIKE '%8b%' AND coalesce(CAST(nullif(regexp_extract(collection, '-seed(\d+)', 1), '') AS INT), 42) IN (42, 43, 44)""",
)
def run_names(spark: SparkSession, d: str) -> DataFrame:
    listed = metrics(spark, d).select(F.concat(F.lit("eval_results_"), "collection").alias("collection"))
    kept = FL.named(FL.allowed_seeds(listed), "8b").withColumn("collection", X.without_prefix(F.col("collection")))
    return kept.select("collection", X.seed_of(F.col("collection")).alias("seed"), X.epoch_of(F.col("collection")).alias("epoch"))


_AGG = ", ".join(f"round(avg({c}), 4) AS {c}" for c in METRICS)
_STD0 = ", ".join(f"round(coalesce(stddev_samp({c}), 0), 4) AS {c}_std" for c in METRICS)
_STD = ", ".join(f"round(stddev_samp({c}), 4) AS {c}_std" for c in METRICS)
STD_COLUMNS = [*METRICS, *[f"{c}_std" for c in METRICS]]


@query("a27_w10_seeds_by_size", f"WITH {TABLE_SQL} SELECT model_size, mode, {_AGG}, {_STD0}, count(*) AS n_seeds FROM ck WHERE is_test AND NOT is_external GROUP BY ALL")
def seeds_by_size(spark: SparkSession, d: str) -> DataFrame:
    tested = checkpoints(spark, d).filter("is_test AND NOT is_external")
    return RP.in_size_order(rounded(RP.seed_aggregate(tested, ["model_size", "mode"], METRICS), STD_COLUMNS, 4))


@query("a27_by_run", f"WITH {RUNS_SQL} SELECT regexp_replace(collection, '-seed4[34]', '', 'g') AS run, {_AGG}, {_STD}, count(*) AS n_seeds FROM met GROUP BY 1")
def by_run(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RP.by_run(metrics(spark, d), METRICS), STD_COLUMNS, 4)


_LONG = " UNION ALL ".join(f"SELECT arm, '{c}' AS metric, {c} AS v FROM a" for c in METRICS)


@query(
    "a28_robustness",
    f"""WITH {RUNS_SQL}, a AS (SELECT regexp_replace(collection, '-seed4[34]', '', 'g') AS arm, * FROM met), l AS ({_LONG})
    SELECT arm, metric, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS min, round(max(v), 3) AS max, round(max(v) - min(v), 3) AS range,
      round(stddev_samp(v) / nullif(avg(v), 0) * 100, 3) AS cv_pct FROM l GROUP BY ALL""",
)
def robustness(spark: SparkSession, d: str) -> DataFrame:
    arms = metrics(spark, d).withColumn("arm", X.without_seed(F.col("collection")))
    return RP.robustness(arms, "arm", METRICS)


BEST_SQL = f"""{TABLE_SQL}, tuned AS (SELECT * FROM ck WHERE mode = 'full' AND NOT is_test),
  chosen AS (SELECT dataset, epoch AS chosen_epoch, f1_macro FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1_macro DESC, epoch) AS rn FROM tuned) WHERE rn = 1)"""


@query("a36_best_epoch", f"WITH {BEST_SQL} SELECT * FROM chosen")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return RP.best_epoch(checkpoints(spark, d).filter("mode = 'full' AND NOT is_test"), ["dataset"], "f1_macro")


def _close(c: str, source: str) -> str:
    return f"coalesce(abs({c} - (SELECT max({c}) FROM {source})) <= 1e-8 + 1e-5 * abs((SELECT max({c}) FROM {source})), false)"


@query(
    "j14_d10_ablation_table",
    f"""WITH {BEST_SQL}, picked AS (SELECT t.* FROM tuned t JOIN chosen c ON c.dataset = t.dataset AND c.chosen_epoch = t.epoch),
    rows AS (SELECT dataset, epoch, false AS is_base, f1_micro, f1_macro FROM picked UNION ALL SELECT dataset, epoch, true, f1_micro, f1_macro FROM ck WHERE model_size = '8b' AND is_base AND NOT is_test)
    SELECT *, NOT is_base AND {_close('f1_micro', 'picked')} AS f1_micro_best, NOT is_base AND {_close('f1_macro', 'picked')} AS f1_macro_best FROM rows""",
)
def ablation_table(spark: SparkSession, d: str) -> DataFrame:
    return RT.ablation_table(checkpoints(spark, d).filter("NOT is_test"), "f1_macro", ["f1_micro", "f1_macro"])


@query(
    "a37_epoch_sweep",
    f"""WITH {TABLE_SQL}, expected AS (SELECT DISTINCT model_size, mode, unnest([1, 2, 3, 4, 5]) AS epoch FROM ck WHERE is_test AND mode = 'full')
    SELECT e.model_size, e.mode, e.epoch, f1_macro, c.collection IS NULL AS missing FROM expected e LEFT JOIN (SELECT * FROM ck WHERE is_test AND seed = 42) c
      ON c.model_size = e.model_size AND c.mode = e.mode AND c.epoch = e.epoch""",
)
def epoch_sweep(spark: SparkSession, d: str) -> DataFrame:
    runs = checkpoints(spark, d)
    tested = runs.filter("is_test AND seed = 42").select("model_size", "mode", "epoch", "f1_macro")
    expected = runs.filter("is_test AND mode = 'full'").select("model_size", "mode").distinct()
    expected = expected.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return RP.epoch_sweep(tested, expected, ["model_size", "mode"])


MAIN_RUNS = ["test-06b-base", "test-8b-base", "test-14b-base", "test-32b-base", "test-8b-full-e3", "test-32b-full-e3", "test-medgemma-27b-it"]
_RUN_LIST = ", ".join(f"'{r}'" for r in MAIN_RUNS)


@query(
    "a35_d10_main_table",
    f"""WITH {RUNS_SQL}, t AS (SELECT regexp_replace(collection, '-seed4[34]', '', 'g') AS run, avg(f1_micro) AS m, avg(f1_macro) AS f, stddev_samp(f1_micro) AS ms, stddev_samp(f1_macro) AS fs, count(*) AS n_seeds FROM met GROUP BY 1),
    r AS (SELECT * FROM t WHERE run IN ({_RUN_LIST}))
    SELECT run, n_seeds, round(m, 1) AS f1_micro, round(ms, 1) AS f1_micro_std, round(f, 1) AS f1_macro, round(fs, 1) AS f1_macro_std,
      {_close('m', 'r')} AS f1_micro_best, {_close('f', 'r')} AS f1_macro_best FROM r""",
)
def main_table(spark: SparkSession, d: str) -> DataFrame:
    return RT.main_table(saved_metrics(spark, d), MAIN_RUNS, ["f1_micro", "f1_macro"])


@query(
    "d10_single_seed_table",
    f"WITH {RUNS_SQL}, r AS (SELECT collection, f1_micro, recall_macro FROM met WHERE collection IN ({_RUN_LIST})) SELECT *, {_close('f1_micro', 'r')} AS f1_micro_best, {_close('recall_macro', 'r')} AS recall_macro_best FROM r",
)
def single_seed_table(spark: SparkSession, d: str) -> DataFrame:
    return RT.single_seed_table(saved_metrics(spark, d), MAIN_RUNS, ["f1_micro", "recall_macro"])


@query(
    "a40_variant_delta",
    f"""WITH {TABLE_SQL}, v AS (SELECT model_size, CASE WHEN is_base THEN 'base' ELSE mode END AS variant, f1_micro, f1_macro FROM ck WHERE is_test AND seed = 42 AND (is_base OR epoch = 3))
    SELECT model_size, {', '.join(f"round(max({c}) FILTER (WHERE variant = 'full') - max({c}) FILTER (WHERE variant = 'base'), 1) AS {c}" for c in ('f1_micro', 'f1_macro'))} FROM v WHERE model_size IS NOT NULL GROUP BY 1""",
)
def variant_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpoints(spark, d).filter("is_test AND seed = 42 AND (is_base OR epoch = 3) AND model_size IS NOT NULL")
    rows = rows.withColumn("variant", F.when(F.col("is_base"), "base").otherwise(F.col("mode")))
    return RP.variant_delta(rows, ["model_size"], ["f1_micro", "f1_macro"])


@query(
    "a41_row_mean",
    f"WITH {TABLE_SQL} SELECT collection, round(list_avg(list_filter([f1_micro, CASE WHEN is_base THEN NULL ELSE f1_macro END, epoch::DOUBLE], lambda x: x IS NOT NULL)), 6) AS mean FROM ck",
)
def row_mean(spark: SparkSession, d: str) -> DataFrame:
    columns = [F.col("f1_micro"), F.when(~F.col("is_base"), F.col("f1_macro")), F.col("epoch")]
    return checkpoints(spark, d).select("collection", F.round(mean_of(columns), 6).alias("mean"))


QA_SQL = f"""{TABLE_SQL}, m AS (SELECT collection, model_size, CASE WHEN is_base THEN 'base' ELSE 'full' END AS mode FROM ck WHERE is_test AND seed = 42 AND model_size IS NOT NULL AND (is_base OR (mode = 'full' AND epoch = 3))),
  p3 AS (SELECT model_size, mode, l_orderkey AS id, substr(code, 1, 3) AS code, bool_or(l_quantity <= 35) AS is_gold, bool_or(l_quantity >= 15) AS is_pred FROM run_rows JOIN m USING (collection) GROUP BY ALL),
  {counts_sql('model_size, mode', 'p3', name='c3')}, {scored_sql('c3', 's3')},
  freq AS (SELECT code, count(*) AS n_train FROM (SELECT DISTINCT l_orderkey, substr(code, 1, 3) AS code FROM run_rows WHERE l_quantity <= 35) GROUP BY code),
  strat AS (SELECT model_size, mode, CASE WHEN n_train >= 100 THEN 'head' WHEN n_train >= 10 THEN 'body' ELSE 'tail' END AS stratum, f FROM s3 JOIN freq USING (code) WHERE tp + fn > 0),
  pf AS (SELECT model_size, mode, l_orderkey AS id, code, bool_or(l_quantity <= 35) AS is_gold, bool_or(l_quantity >= 15) AS is_pred FROM run_rows JOIN m USING (collection) GROUP BY ALL),
  {counts_sql('model_size, mode', 'pf', name='cf')}, {scored_sql('cf', 'sf')}"""


@query(
    "j15_d10_code_class_table",
    f"""WITH {QA_SQL}, rates AS (SELECT model_size, mode, count(*) AS n_pairs FROM p3 GROUP BY ALL), full_f AS (SELECT model_size, mode, avg(f) AS f FROM sf GROUP BY ALL)
    SELECT r.model_size, r.mode, r.n_pairs, {', '.join(f"round(100 * coalesce((SELECT avg(f) FROM strat s WHERE s.model_size = r.model_size AND s.mode = r.mode AND stratum = '{s}'), 0), 4) AS f1_{s}" for s in ('head', 'body', 'tail'))},
      round(100 * full_f.f, 4) AS full_code_f1 FROM rates r JOIN full_f USING (model_size, mode)""",
)
def code_class_table(spark: SparkSession, d: str) -> DataFrame:
    keys = ["model_size", "mode"]
    chosen = checkpoints(spark, d).filter("is_test AND seed = 42 AND model_size IS NOT NULL AND (is_base OR (mode = 'full' AND epoch = 3))")
    chosen = chosen.select("collection", "model_size", F.when(F.col("is_base"), "base").otherwise("full").alias("mode"))
    rows = run_rows(spark, d).join(chosen, "collection")
    short = SM.distinct_pairs(rows.withColumn("code", F.substring("code", 1, 3)), [*keys, "id"])
    gold = run_rows(spark, d).filter("is_gold").select("id", F.substring("code", 1, 3).alias("code")).distinct()
    frequency = gold.groupBy("code").agg(F.count("*").alias("n_train"))
    strata = SM.strata_scores(SM.code_counts(short, keys), frequency, keys)
    full = SM.micro_macro(SM.code_counts(SM.distinct_pairs(rows, [*keys, "id"]), keys), keys)
    granular = full.select(*keys, F.lit("full").alias("granularity"), F.lit("macro").alias("metric_type"), F.col("f1_macro").alias("f1"))
    rates = short.groupBy(*keys).agg(F.count("*").alias("n_pairs"))
    return rounded(RP.code_class_table(rates, strata, granular, keys, ["n_pairs"]), ["f1_head", "f1_body", "f1_tail", "full_code_f1"], 4)


@query("j11_new_collections", f"WITH {RUNS_SQL} SELECT collection, collection NOT LIKE 'test-%' AS is_new FROM met")
def new_collections(spark: SparkSession, d: str) -> DataFrame:
    table_ = saved_metrics(spark, d)
    listed = table_.select(F.concat(F.lit("eval_results_"), "collection").alias("collection"))
    new, done = RP.new_and_done(listed, table_.filter(F.col("collection").startswith("test-")))
    return new.withColumn("is_new", F.lit(True)).unionByName(done.withColumn("is_new", F.lit(False)))


@query(
    "s11_upsert",
    f"WITH {RUNS_SQL} SELECT collection, CASE WHEN collection LIKE '%base%' THEN NULL ELSE f1_micro END AS f1_micro, CASE WHEN collection LIKE '%base%' THEN n_samples END AS n_samples FROM met",
)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """A metric table on disk; the base runs are replaced, with another column, twice."""
    table_, path = saved_metrics(spark, d), shared_dir(spark, "metrics")
    MT.create(table_.select("collection", "f1_micro"), path, buckets=16)
    for _ in range(2):
        MT.upsert(table_.filter(F.col("collection").contains("base")).select("collection", "n_samples"), path)
    return MT.read(spark, path)


@query("s12_append_metrics", f"WITH {RUNS_SQL} SELECT collection, f1_micro, CASE WHEN collection LIKE 'test-%' THEN NULL ELSE f1_macro END AS f1_macro, n_samples FROM met")
def append_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All runs are brought to a table that has the test runs; those stay as they are."""
    table_, path = saved_metrics(spark, d), shared_dir(spark, "metrics")
    old = table_.filter(F.col("collection").startswith("test-")).select("collection", "f1_micro", "n_samples")
    MT.create(old, path, buckets=16)
    MT.append(table_.select("collection", "f1_micro", "f1_macro", "n_samples"), path)
    stored = MT.read(spark, path)
    return RP.append_metrics(stored, stored.limit(0))
