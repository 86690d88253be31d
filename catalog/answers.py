"""Stored answers: parsing, shortening, templates, and scorecards over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.cohort import COMPLAINTS
from catalog.inputs import (
    ADMISSIONS, CODE_ROWS, LISTS, MM_COLUMNS, admissions, answer_lists, counts_sql, micro_macro_sql, scored_sql, table,
)
from catalog.registry import query
from scorefold.functions import codes as C, parsing as P, rendering as R, scoring as S
from scorefold.operators import filters as FL
from scorefold.plans import scorecard as SC


def results(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation results as stored: lists and vectors are text, some are missing."""
    rows = answer_lists(spark, d).join(admissions(spark, d), "id")
    names = F.array_distinct(F.transform("pred", lambda c: F.substring(c, 1, 3)))
    position = F.array_position(F.array(*[F.lit(c) for c in COMPLAINTS]), F.col("complaint"))
    steps = F.sequence(F.lit(1), (position + 4).cast("int"))
    printed = F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))
    vector = F.concat(F.lit("["), F.array_join(F.transform(steps, lambda i: ((i + F.col("id")) % 3 - 1).cast("string")), ", "), F.lit("]"))
    return rows.select(
        F.col("system").alias("collection"), "id", F.col("complaint").alias("chief_complaint"), F.col("gold").alias("ICD_CODES"),
        F.substring(F.get("gold", F.lit(0)), 1, 3).alias("disease"), F.transform(steps, lambda i: (i % 3 - 1).cast("int")).alias("disease_vector"),
        F.when(F.col("id") % 7 == 0, F.lit("None")).otherwise(printed).alias("v4_preds"),
        F.when(F.size("pred") > 0, F.to_json(names)).alias("v2_preds"), F.when(F.col("id") % 3 != 0, vector).alias("v1_preds"),
        F.when(F.col("id") % 3 != 0, vector).alias("v1_json"), F.when(F.size("pred") > 0, F.lit("[]")).otherwise(F.lit("None")).alias("v2_json"),
        F.when(F.col("id") % 7 == 0, F.lit("None")).otherwise(printed).alias("v4_json"),
    )


RESULTS_SQL = f"""{CODE_ROWS}, {LISTS}, {ADMISSIONS},
  r0 AS (SELECT system AS collection, id, complaint, list_transform(gold, lambda c: substr(c, 1, 3)) AS gs, list_transform(pred, lambda c: substr(c, 1, 3)) AS cats,
      list_position([{', '.join(f"'{c}'" for c in COMPLAINTS)}], complaint) + 4 AS k FROM lists JOIN adm USING (id)),
  res AS (SELECT *, gs[1] AS disease, list_filter(cats, lambda c, i: list_position(cats, c) = i) AS names, CASE WHEN id % 7 = 0 THEN [] ELSE list_distinct(cats) END AS codes,
      list_transform(range(1, k + 1), lambda i: (i % 3 - 1)::DOUBLE) AS t, CASE WHEN id % 3 <> 0 THEN list_transform(range(1, k + 1), lambda i: ((i + id) % 3 - 1)::DOUBLE) ELSE list_transform(range(1, k + 1), lambda i: 0.0::DOUBLE) END AS p FROM r0),
  vec AS (SELECT *, list_inner_product(p, t) AS dp, list_inner_product(p, p) AS pp, list_inner_product(t, t) AS tt, list_position(names, disease) AS pos FROM res)"""

_RANKS = ", ".join(f"avg((coalesce(pos, 0) BETWEEN 1 AND {k})::INT) AS recall_at_{k}" for k in (1, 3, 5, 10))
CARD_COLUMNS = [
    "precision_micro", "recall_micro", "f1_micro", "precision_macro", "recall_macro", "f1_macro", "mrr", "recall_at_1", "recall_at_3",
    "recall_at_5", "recall_at_10", "f1_micro_at_1", "f1_macro_at_1", "cos_sim", "dot_product", "v1_json_valid", "v2_json_valid", "v4_json_valid",
]


@query(
    "a26_scorecard",
    f"""WITH {RESULTS_SQL},
    pairs AS (SELECT collection, id, code, bool_or(s = 'g') AS is_gold, bool_or(s = 'p') AS is_pred FROM (SELECT collection, id, unnest(gs) AS code, 'g' AS s FROM res UNION ALL SELECT collection, id, unnest(codes), 'p' FROM res) GROUP BY ALL),
    {counts_sql('collection')}, {scored_sql()}, {micro_macro_sql('collection')},
    tops AS (SELECT collection, disease AS truth, coalesce(names[1], '') AS guess FROM res),
    tp AS (SELECT collection, truth AS code, true AS is_gold, truth = guess AS is_pred FROM tops WHERE truth IS NOT NULL UNION ALL SELECT collection, guess, false, true FROM tops WHERE guess IS DISTINCT FROM truth),
    {counts_sql('collection', 'tp', name='tc')}, {scored_sql('tc', 'ts')}, {micro_macro_sql('collection', 'ts', 'tm')},
    g AS (SELECT collection, k, count(*) AS n, round(avg(CASE WHEN pp > 0 AND tt > 0 THEN dp / (sqrt(pp) * sqrt(tt)) ELSE 0 END), 4) AS cos, round(avg((dp + tt) / (2 * tt)), 4) AS dot FROM vec GROUP BY ALL),
    gv AS (SELECT collection, sum(cos * n) / sum(n) AS cos_sim, sum(dot * n) / sum(n) AS dot_product FROM g GROUP BY 1),
    rk AS (SELECT collection, count(*) AS n_samples, avg(coalesce(1.0::DOUBLE / nullif(pos, 0), 0)) AS mrr, {_RANKS}, avg((id % 3 <> 0)::INT) AS v1_json_valid, avg((len(cats) > 0)::INT) AS v2_json_valid, avg((id % 7 <> 0)::INT) AS v4_json_valid,
      round(avg(len(codes)), 2) AS code_len, round(avg(len(list_distinct(gs))), 2) AS code_label_len FROM vec GROUP BY 1),
    j AS (SELECT rk.*, cos_sim, dot_product, {', '.join('mm.' + c for c in MM_COLUMNS)}, tm.f1_micro AS f1_micro_at_1, tm.f1_macro AS f1_macro_at_1 FROM rk JOIN gv USING (collection) JOIN mm USING (collection) JOIN tm USING (collection))
    SELECT collection, {', '.join(f'round(round({c}, 4) * 100, 2) AS {c}' for c in CARD_COLUMNS)}, code_len, code_label_len, n_samples FROM j""",
)
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return SC.scorecard(SC.parsed_results(results(spark, d)), ["collection"])


@query(
    "a30_per_complaint",
    f"""WITH {RESULTS_SQL}, grp AS (SELECT * REPLACE (unnest([complaint, 'All']) AS complaint) FROM vec),
    pairs AS (SELECT collection, complaint, id, code, bool_or(s = 'g') AS is_gold, bool_or(s = 'p') AS is_pred FROM (
      SELECT collection, complaint, id, unnest(gs) AS code, 'g' AS s FROM grp UNION ALL SELECT collection, complaint, id, unnest(codes), 'p' FROM grp) GROUP BY ALL),
    {counts_sql('collection, complaint')}, {scored_sql()}, {micro_macro_sql('collection, complaint')},
    rk AS (SELECT collection, complaint, count(*) AS n, 100 * avg((dp + tt) / (2 * tt)) AS dot_product, 100 * avg((coalesce(pos, 0) = 1)::INT) AS recall_at_1, 100 * avg((coalesce(pos, 0) BETWEEN 1 AND 3)::INT) AS recall_at_3 FROM grp GROUP BY ALL)
    SELECT collection, complaint AS chief_complaint, n, round(dot_product, 1) AS dot_product, round(recall_at_1, 1) AS recall_at_1, round(recall_at_3, 1) AS recall_at_3, round(100 * f1_micro, 1) AS f1_micro, round(100 * f1_macro, 1) AS f1_macro
    FROM rk JOIN mm USING (collection, complaint)""",
)
def per_complaint(spark: SparkSession, d: str) -> DataFrame:
    return SC.per_complaint(SC.parsed_results(results(spark, d)), ["collection"])


@query(
    "c07_parse_lists",
    f"""WITH {RESULTS_SQL} SELECT collection, id, CASE WHEN id % 7 = 0 THEN '' ELSE array_to_string(names, ',') END AS codes, len(names) AS n_names,
      CASE WHEN id % 3 <> 0 THEN array_to_string(list_transform(p, lambda x: x::INT), ',') END AS vector FROM res""",
)
def parse_lists(spark: SparkSession, d: str) -> DataFrame:
    parsed = SC.parsed_results(results(spark, d))
    return parsed.select(
        "collection", "id", F.array_join("code_pred", ",").alias("codes"), F.size("name_pred").cast("bigint").alias("n_names"),
        F.array_join(F.col("vector_pred").cast("array<string>"), ",").alias("vector"),
    )


@query(
    "c10_shorten_reasons",
    r"""SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN regexp_replace(substr(text, 1, 1000), ' [^ ]*$', '') || '...' ELSE text END) AS digest FROM documents""",
)
def shorten_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(P.shortened(F.col("text"))).alias("digest"))


@query(
    "c18_fill_template",
    """SELECT doc_id, md5(substr('Note: ' || text || chr(10) || 'lang {' || lang || '} again ' || lang || ' and {missing}' || source, 1, 25000)) AS digest FROM documents""",
)
def fill_template(spark: SparkSession, d: str) -> DataFrame:
    template = F.lit("Note: {text}\nlang {open}{lang}{close} again {lang} and {{missing}}{source}")
    slots = {"text": F.col("text"), "lang": F.col("lang"), "source": F.col("source"), "open": F.lit("{"), "close": F.lit("}")}
    filled = R.fill_template(template, slots, R.MAX_PROMPT)
    return table(spark, d, "documents").select("doc_id", F.md5(filled).alias("digest"))


@query(
    "c13_c14_align_answers",
    f"""WITH {CODE_ROWS}, {LISTS}, x AS (SELECT system, id, gold, pred, list_transform(gold, lambda c: substr(c, 1, 3)) AS gs, list_transform(pred, lambda c: substr(c, 1, 3)) AS ps FROM lists)
    SELECT system, id, array_to_string(list_concat(list_filter(pred, lambda c: list_contains(gs, substr(c, 1, 3))), list_filter(gold, lambda c: NOT list_contains(ps, substr(c, 1, 3)))), ',') AS codes,
      array_to_string(list_concat([gold[1]], CASE WHEN list_contains(pred, gold[1]) THEN list_concat(pred[1:list_position(pred, gold[1]) - 1], pred[list_position(pred, gold[1]) + 1:]) ELSE pred END), ',') AS names FROM x""",
)
def align_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_lists(spark, d)
    codes = F.transform("pred", R.code_entry)
    names = F.transform("pred", R.name_entry)
    return rows.select(
        "system", "id", F.array_join(R.align_codes(codes, F.col("gold"))["icd_code"], ",").alias("codes"),
        F.array_join(R.target_first(names, F.get("gold", F.lit(0)))["name"], ",").alias("names"),
    )


@query(
    "u03_u04_w09_set_algebra",
    f"""WITH {CODE_ROWS}, {LISTS}, x AS (SELECT system, id, gold, list_transform(pred, lambda c: substr(c, 1, 3)) AS ps, list_transform(gold, lambda c: substr(c, 1, 3)) AS gs FROM lists)
    SELECT system, id, len(list_distinct(list_intersect(ps, gs))) AS n_common, len(list_distinct(list_filter(ps, lambda c: NOT list_contains(gs, c)))) AS n_extra,
      len(list_distinct(list_filter(gs, lambda c: NOT list_contains(ps, c)))) AS n_missed, array_to_string(list_filter(ps, lambda c, i: list_position(ps, c) = i)[1:3], ',') AS top FROM x""",
)
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    g, p = C.short_codes("gold"), C.short_codes("pred")
    return answer_lists(spark, d).select(
        "system", "id", F.size(F.array_intersect(p, g)).cast("bigint").alias("n_common"), F.size(F.array_except(p, g)).cast("bigint").alias("n_extra"),
        F.size(F.array_except(g, p)).cast("bigint").alias("n_missed"), F.array_join(F.slice(p, 1, 3), ",").alias("top"),
    )


@query(
    "c31_c32_prf_percent",
    """WITH c AS (SELECT user_id, count(*) FILTER (WHERE value > 10) AS tp, count(*) FILTER (WHERE value BETWEEN 5 AND 10) AS fp, count(*) FILTER (WHERE value < 1) AS fn FROM events GROUP BY 1)
    SELECT user_id, round(100 * coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 2) AS precision, round(100 * coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 2) AS recall,
      round(100 * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 2) AS f1 FROM c""",
)
def prf_percent(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    counts = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(value > 10).alias("tp"), F.count_if(value.between(5, 10)).alias("fp"), F.count_if(value < 1).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "user_id", S.percent(S.precision(tp, fp)).alias("precision"), S.percent(S.recall(tp, fn)).alias("recall"), S.percent(S.f1(tp, fp, fn)).alias("f1")
    )


@query(
    "f07_f08_f09_f10_cleaning",
    """SELECT doc_id, CASE lang WHEN 'de' THEN 'dev' WHEN 'en' THEN 'train' ELSE lang END AS split, coalesce(CASE WHEN quality = 1 THEN 'good' END, 'No laboratory results available.') AS labs
    FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR n_chars > 1000""",
)
def cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Rows with any score, canonical split names, default text and a tolerant projection."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("lang") == "de", "val").when(F.col("lang") == "en", "train").otherwise(F.col("lang")).alias("split"),
        F.col("quality").alias("v1_score"), F.when(F.col("n_chars") > 1000, F.lit(1)).alias("v2_score"), F.when(F.col("quality") == 1, F.lit("good")).alias("labs"),
    )
    kept = FL.with_any(joined, ["v1_score", "v2_score", "v3_score"])
    kept = kept.withColumn("split", FL.canonical_split(F.col("split"))).withColumn("labs", F.coalesce("labs", F.lit(R.NO_LABS)))
    return FL.existing(kept, ["doc_id", "split", "labs", "not_there"])
