"""Set, rank and vector metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import (
    ADMISSIONS, CODE_ROWS, LISTS, MM_COLUMNS, PAIRS, admissions, answer_lists, code_rows, counts_sql,
    lists_sql, micro_macro_sql, rounded, rounded_sql, scored_sql, table,
)
from catalog.registry import query
from scorefold.functions import codes as C, scoring as S
from scorefold.operators import frequency as FR, matching as M, rank_metrics as RM, reports as RP, set_metrics as SM

MM_SQL = f"WITH {CODE_ROWS}, {PAIRS}, {counts_sql('system')}, {scored_sql()}, {micro_macro_sql('system')}"


@query("a08_micro_macro", f"{MM_SQL} SELECT system, tp, fp, fn, n_labels, {rounded_sql(MM_COLUMNS)} FROM mm")
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    pairs = SM.distinct_pairs(code_rows(spark, d), ["system", "id"])
    return rounded(SM.micro_macro(SM.code_counts(pairs, ["system"]), ["system"]), MM_COLUMNS)


@query(
    "a08_micro_macro_short_codes",
    f"""WITH {CODE_ROWS}, pairs AS (
      SELECT system, id, substr(code, 1, 3) AS code, bool_or(is_gold) AS is_gold, bool_or(is_pred) AS is_pred
      FROM code_rows GROUP BY ALL), {counts_sql('system')}, {scored_sql()}, {micro_macro_sql('system')}
    SELECT system, tp, fp, fn, n_labels, {rounded_sql(MM_COLUMNS)} FROM mm""",
)
def micro_macro_short(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_lists(spark, d)
    pairs = SM.pairs_from_lists(rows, ["system"], C.short_codes("gold"), C.short_codes("pred"))
    return rounded(SM.micro_macro(SM.code_counts(pairs, ["system"]), ["system"]), MM_COLUMNS)


@query(
    "a09_macro_vocabulary",
    f"""WITH {CODE_ROWS}, {PAIRS}, {counts_sql('system')}, {scored_sql()},
    vocab AS (SELECT DISTINCT code FROM pairs WHERE is_gold AND system = 'R'),
    n AS (SELECT count(*) AS n FROM vocab)
    SELECT system, round(100 * coalesce(sum(r) FILTER (WHERE code IN (FROM vocab)), 0) / any_value(n.n), 6) AS recall,
      round(100 * coalesce(sum(p) FILTER (WHERE code IN (FROM vocab)), 0) / any_value(n.n), 6) AS precision,
      round(100 * coalesce(sum(f) FILTER (WHERE code IN (FROM vocab)), 0) / any_value(n.n), 6) AS f1
    FROM scored, n GROUP BY system""",
)
def macro_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    pairs = SM.distinct_pairs(code_rows(spark, d), ["system", "id"])
    vocabulary = SM.vocabulary_of(code_rows(spark, d).filter("system = 'R'"))
    scores = SM.macro_over(SM.code_counts(pairs, ["system"]), ["system"], vocabulary)
    return rounded(scores, ["recall", "precision", "f1"])


TRAIN = f"""{ADMISSIONS}, freq AS (
  SELECT code, count(*) AS n_train FROM (
    SELECT DISTINCT id, substr(code, 1, 3) AS code FROM code_rows SEMI JOIN (SELECT id FROM adm WHERE split = 'train') USING (id)
    WHERE is_gold) GROUP BY code)"""


def frequency(spark: SparkSession, d: str) -> DataFrame:
    """Training frequency straight from the exploded rows: distinct (id, code), then a count."""
    train = admissions(spark, d).filter("split = 'train'").select("id")
    gold = code_rows(spark, d).filter("is_gold").select("id", F.substring("code", 1, 3).alias("code"))
    pairs = gold.join(train, "id", "left_semi").distinct()
    return pairs.groupBy("code").agg(F.count("*").alias("n_train"))


@query("a07_training_frequency", f"WITH {CODE_ROWS}, {TRAIN} SELECT code, n_train FROM freq")
def training_frequency(spark: SparkSession, d: str) -> DataFrame:
    notes = answer_lists(spark, d, ("id",)).withColumnRenamed("gold", "ICD_CODES")
    train = admissions(spark, d).filter("split = 'train'")
    return SM.training_frequency(notes, train, key="id")


STRATUM = "CASE WHEN coalesce(n_train, 0) >= 100 THEN 'head' WHEN coalesce(n_train, 0) >= 10 THEN 'body' ELSE 'tail' END"


@query(
    "a10_strata_scores",
    f"""WITH {CODE_ROWS}, {TRAIN}, pairs AS (
      SELECT system, id, substr(code, 1, 3) AS code, bool_or(is_gold) AS is_gold, bool_or(is_pred) AS is_pred
      FROM code_rows SEMI JOIN (SELECT id FROM adm WHERE split = 'test') USING (id) GROUP BY ALL),
    {counts_sql('system')}, {scored_sql()},
    marked AS (SELECT s.*, {STRATUM} AS stratum FROM scored s LEFT JOIN freq USING (code) WHERE tp + fn > 0),
    cells AS (SELECT DISTINCT system, stratum FROM pairs, (VALUES ('head'), ('body'), ('tail')) v(stratum))
    SELECT c.system, c.stratum, round(100 * coalesce(avg(f), 0), 6) AS f1,
      round(coalesce(100 * sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 0), 6) AS recall, count(m.code) AS n_labels
    FROM cells c LEFT JOIN marked m USING (system, stratum) GROUP BY ALL""",
)
def strata_scores(spark: SparkSession, d: str) -> DataFrame:
    test = admissions(spark, d).filter("split = 'test'").select("id")
    rows = code_rows(spark, d).withColumn("code", F.substring("code", 1, 3)).join(test, "id", "left_semi")
    counts = SM.code_counts(SM.distinct_pairs(rows, ["system", "id"]), ["system"])
    return rounded(SM.strata_scores(counts, frequency(spark, d), ["system"]), ["f1", "recall"])


@query(
    "a11_stratum_composition",
    f"""WITH {CODE_ROWS}, {TRAIN}
    SELECT {STRATUM} AS stratum, count(*) AS n_codes, sum(n_train)::BIGINT AS occurrences,
      round(100 * sum(n_train) / (SELECT sum(n_train) FROM freq)::DOUBLE, 6) AS share_pct
    FROM freq GROUP BY 1""",
)
def stratum_composition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(SM.stratum_composition(frequency(spark, d)), ["share_pct"])


CHRONIC_SQL = "[" + ", ".join(f"'{c}'" for c in C.CHRONIC) + "]"
FAMILY_SQL = {
    "history": "c LIKE 'Z8%' OR c LIKE 'Z9%'", "medication": "c = 'Z79'",
    "chronic": f"list_contains({CHRONIC_SQL}, c)",
}


def _family_sql() -> str:
    parts = []
    for name, cond in FAMILY_SQL.items():
        g, p = f"list_filter(g, lambda c: {cond})", f"list_filter(p, lambda c: {cond})"
        parts.append(f"""sum(len(list_intersect({g}, {p}))) AS i_{name}, sum(len({g})) AS g_{name}, sum(len({p})) AS p_{name},
          avg((len(list_filter({g}, lambda c: NOT list_contains(p, c))) > 0)::INT) AS missed_{name}""")
    return ", ".join(parts)


def _prf_sql(i: str, g: str, p: str, names: tuple[str, str, str]) -> str:
    r, q = f"coalesce({i} / nullif({g}, 0)::DOUBLE, 0)", f"coalesce({i} / nullif({p}, 0)::DOUBLE, 0)"
    f = f"coalesce(2 * {q} * {r} / nullif({q} + {r}, 0), 0)"
    return f"round({r}, 6) AS {names[0]}, round({q}, 6) AS {names[1]}, round({f}, 6) AS {names[2]}"


RATE_COLUMNS = [
    "missed_history", "missed_medication", "missed_chronic", "missed_primary", "missed_any", "symptom_fp",
    "extra_codes", "duplicate_subcodes", "hallucinated_fp", "recall_primary_at_1", "recall_primary_at_2",
    "recall_primary_at_3",
]
ERROR_SQL = f"""WITH {CODE_ROWS}, {LISTS},
  cut AS (SELECT system, list_transform(gold, lambda c: substr(c, 1, 3)) AS gl, list_transform(pred, lambda c: substr(c, 1, 3)) AS pl FROM lists),
  ranked AS (SELECT *, list_distinct(gl) AS g, list_filter(pl, lambda c, i: list_position(pl, c) = i) AS p FROM cut),
  sums AS (
    SELECT system, count(*) AS n, sum(len(list_intersect(g, p))) AS i, sum(len(g)) AS ng, sum(len(p)) AS np, {_family_sql()},
      avg((len(gl) > 0 AND NOT list_contains(p, gl[1]))::INT) AS missed_primary,
      avg((len(list_filter(g, lambda c: NOT list_contains(p, c))) > 0)::INT) AS missed_any,
      avg((len(list_filter(p, lambda c: NOT list_contains(g, c) AND c LIKE 'R%')) > 0)::INT) AS symptom_fp,
      avg((len(p) > len(g))::INT) AS extra_codes, avg((len(p) <> len(pl))::INT) AS duplicate_subcodes,
      avg((len(list_filter(p, lambda c: NOT list_contains(g, c))) > 0)::INT) AS hallucinated_fp,
      avg((len(gl) > 0 AND list_contains(p[1:1], gl[1]))::INT) AS recall_primary_at_1,
      avg((len(gl) > 0 AND list_contains(p[1:2], gl[1]))::INT) AS recall_primary_at_2,
      avg((len(gl) > 0 AND list_contains(p[1:3], gl[1]))::INT) AS recall_primary_at_3
    FROM ranked GROUP BY system)
  SELECT system, n, {_prf_sql('i', 'ng', 'np', ('recall', 'precision', 'micro_f1'))},
    {', '.join(_prf_sql(f'i_{k}', f'g_{k}', f'p_{k}', (f'recall_{k}', f'precision_{k}', f'f1_{k}')) for k in FAMILY_SQL)},
    {rounded_sql(RATE_COLUMNS)}, round(1 - missed_primary, 6) AS recall_primary
  FROM sums"""


@query("a12_error_rates", ERROR_SQL)
def error_rates(spark: SparkSession, d: str) -> DataFrame:
    rates = SM.error_rates(answer_lists(spark, d), ["system"], "gold", "pred")
    return rounded(rates, [c for c in rates.columns if c not in ("system", "n")])


RAW_SQL = f"""{CODE_ROWS}, {LISTS},
  raw AS (SELECT system, id, gold, list_transform(pred, lambda c: CASE
      WHEN substr(c, 4, 1) = '7' THEN substr(c, 1, 3) || '-' || c
      ELSE c END) AS entries FROM lists),
  valid AS (SELECT system, id, gold, entries, list_filter(entries, lambda c: c NOT LIKE '%-%') AS pred FROM raw)"""


def raw_answers(spark: SparkSession, d: str) -> DataFrame:
    """Predicted entries as models write them: dots, lower case, two in one, invalid ranges."""
    digit = lambda c: F.substring(c, 4, 1)
    entry = lambda c: (
        F.when(digit(c) == "7", F.concat(F.substring(c, 1, 3), F.lit("-"), c))
        .when(digit(c) == "1", F.concat(F.substring(c, 1, 3), F.lit("."), digit(c)))
        .when(digit(c) == "2", F.lower(c))
        .when(digit(c) == "3", F.concat(F.substring(c, 1, 3), F.lit("_"), digit(c), F.lit(" ")))
        .when(digit(c) == "4", F.concat(c, F.lit(", "), F.lower(c)))
        .otherwise(c)
    )
    return answer_lists(spark, d).withColumn("raw_codes", F.transform("pred", entry))


@query(
    "c06_clean_codes",
    f"""WITH {RAW_SQL} SELECT system, sum(len(pred))::BIGINT AS n_valid, sum(len(entries))::BIGINT AS n_raw,
      sum(len(entries) - len(pred))::BIGINT AS n_invalid, count(DISTINCT array_to_string(pred, ' ')) AS n_distinct_lists
    FROM valid GROUP BY system""",
)
def clean_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = raw_answers(spark, d)
    return rows.groupBy("system").agg(
        F.sum(F.size(C.full_codes("raw_codes"))).alias("n_valid"),
        F.sum(C.raw_entry_count("raw_codes")).cast("bigint").alias("n_raw"),
        F.sum(C.invalid_entry_count("raw_codes")).cast("bigint").alias("n_invalid"),
        F.count_distinct(F.array_join(C.full_codes("raw_codes"), " ")).alias("n_distinct_lists"),
    )


FULL_NAMES = [f"{m}_{a}" for a in ("micro", "macro") for m in ("recall", "precision", "f1")]
FULL_SQL = f"""WITH {RAW_SQL},
  lv AS (SELECT system, id, 'full' AS level, gold AS g, pred AS p FROM valid UNION ALL
    SELECT system, id, 'category', list_distinct(list_transform(gold, lambda c: substr(c, 1, 3))),
      list_distinct(list_transform(pred, lambda c: substr(c, 1, 3))) FROM valid),
  pairs AS (SELECT system, level, id, code, bool_or(s = 'g') AS is_gold, bool_or(s = 'p') AS is_pred FROM (
    SELECT system, level, id, unnest(g) AS code, 'g' AS s FROM lv UNION ALL SELECT system, level, id, unnest(p), 'p' FROM lv) GROUP BY ALL),
  {counts_sql('system, level')}, {scored_sql()}, {micro_macro_sql('system, level')},
  spec AS (SELECT system, count(*) AS n, sum(len(list_intersect(gold, pred)))::BIGINT AS exact,
      sum(len(list_filter(gold, lambda c: list_contains(list_transform(pred, lambda q: substr(q, 1, 3)), substr(c, 1, 3)))))::BIGINT AS covered,
      sum(len(entries) - len(pred)) / sum(len(entries))::DOUBLE AS invalid
    FROM valid GROUP BY system)
  SELECT system, n, {', '.join(f"round(max({c}) FILTER (WHERE level = '{l}'), 6) AS {c}_{l}" for l in ('category', 'full') for c in FULL_NAMES)},
    {', '.join(f"max(n_labels) FILTER (WHERE level = '{l}') AS n_labels_{l}" for l in ('category', 'full'))},
    round(any_value(exact) / any_value(covered)::DOUBLE, 6) AS specificity_given_cat_hit, any_value(exact) AS cat_hit_exact,
    any_value(covered) - any_value(exact) AS cat_hit_inexact, round(any_value(invalid), 6) AS invalid_token_rate
  FROM mm JOIN spec USING (system) GROUP BY system, n"""


def full_code_table(spark: SparkSession, d: str) -> DataFrame:
    return SM.full_code_scores(raw_answers(spark, d), ["system"], "gold", "raw_codes")


@query("a13_a14_a15_full_code_scores", FULL_SQL)
def full_code_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = full_code_table(spark, d)
    exact = {"system", "n", "n_labels_category", "n_labels_full", "cat_hit_exact", "cat_hit_inexact"}
    return rounded(scores, [c for c in scores.columns if c not in exact])


LONG_CELLS = " UNION ALL ".join(
    f"SELECT system, '{l}' AS granularity, '{a}' AS metric_type, recall_{a}_{l} AS recall, precision_{a}_{l} AS precision, f1_{a}_{l} AS f1 FROM w"
    for l in ("category", "full") for a in ("micro", "macro")
)


@query("a39_wide_to_long", f"WITH w AS ({FULL_SQL}) {LONG_CELLS}")
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(RP.wide_to_long(full_code_table(spark, d), ["system"]), ["recall", "precision", "f1"])


AP_SQL = """list_sum(list_transform(list_filter(list_transform(range(1, len(k) + 1), lambda i:
      CASE WHEN list_contains(gold, k[i]) THEN len(list_filter(k[1:i], lambda c: list_contains(gold, c))) / i::DOUBLE END),
      lambda x: x IS NOT NULL), lambda x: x))"""


def _card_sql(budgets: str) -> str:
    return f"""WITH {CODE_ROWS}, {LISTS}, b AS ({budgets}),
    ap AS (SELECT *, CASE WHEN len(gold) > 0 THEN coalesce({AP_SQL}, 0) / len(gold) END AS ap FROM (SELECT *, pred[1:20] AS k FROM b)),
    ranks AS (SELECT system, budget, 100 * avg(ap) AS map_at_n,
        100 * avg((len(gold) > 0 AND list_contains(pred, gold[1]))::INT) AS md_acc, avg(len(pred)) AS codes_per_adm
      FROM ap GROUP BY ALL),
    pairs AS (SELECT system, budget, id, code, bool_or(s = 'g') AS is_gold, bool_or(s = 'p') AS is_pred FROM (
      SELECT system, budget, id, unnest(gold) AS code, 'g' AS s FROM b UNION ALL SELECT system, budget, id, unnest(pred), 'p' FROM b) GROUP BY ALL),
    {counts_sql('system, budget')}, {scored_sql()}, {micro_macro_sql('system, budget')},
    vocab AS (SELECT DISTINCT code FROM pairs WHERE is_gold), n AS (SELECT count(*) AS n FROM vocab),
    macro AS (SELECT system, budget, 100 * sum(r) FILTER (WHERE code IN (FROM vocab)) / any_value(n.n) AS recall,
        100 * sum(p) FILTER (WHERE code IN (FROM vocab)) / any_value(n.n) AS precision,
        100 * sum(f) FILTER (WHERE code IN (FROM vocab)) / any_value(n.n) AS f1 FROM scored, n GROUP BY ALL)
    SELECT system, budget, {rounded_sql(['map_at_n', 'md_acc', 'codes_per_adm', 'recall', 'precision', 'f1'], 4)},
      100 * round(f1_micro, 4) AS micro_f1
    FROM ranks JOIN macro USING (system, budget) JOIN mm USING (system, budget)"""


@query(
    "a22_a23_a24_system_scorecard",
    _card_sql("SELECT *, 'full' AS budget FROM lists UNION ALL SELECT system, id, gold, pred[1:3] AS pred, 'top-3' AS budget FROM lists"),
)
def system_scorecard(spark: SparkSession, d: str) -> DataFrame:
    budgets = F.array(
        F.struct(F.lit("full").alias("budget"), F.col("pred").alias("pred")),
        F.struct(F.lit("top-3").alias("budget"), F.slice("pred", 1, 3).alias("pred")),
    )
    rows = answer_lists(spark, d).select("system", "gold", F.inline(budgets))
    card = SM.score_systems(rows, ["system", "budget"])
    return rounded(card, ["map_at_n", "md_acc", "codes_per_adm", "recall", "precision", "f1"], 4)


@query(
    "c24_set_f1",
    f"""WITH {CODE_ROWS}, {LISTS},
    s AS (SELECT system, id, len(list_intersect(gold, pred))::DOUBLE AS i, len(gold) AS g, len(pred) AS p FROM lists)
    SELECT system, id, round(CASE WHEN i > 0 THEN 2 * (i / p) * (i / g) / (i / p + i / g) ELSE 0 END, 6) AS score FROM s""",
)
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    score = S.set_f1(F.col("pred"), F.col("gold"))
    return answer_lists(spark, d).select("system", "id", F.round(score, 6).alias("score"))


@query(
    "c05_c25_short_in_label_space",
    f"""WITH {CODE_ROWS}, {LISTS}, space AS (SELECT list(DISTINCT substr(code, 1, 3)) AS s FROM code_rows WHERE is_gold)
    SELECT system, id, array_to_string(list_filter(r, lambda c, i: list_position(r, c) = i AND list_contains(s, c)), ',') AS codes
    FROM (SELECT system, id, list_transform(pred, lambda c: substr(c, 1, 3)) AS r FROM lists), space""",
)
def short_in_label_space(spark: SparkSession, d: str) -> DataFrame:
    space = code_rows(spark, d).filter("is_gold").select(C.short_code("code").alias("code"))
    kept = M.keep_known(answer_lists(spark, d).withColumn("ranked", C.ranked_categories("pred")), "ranked", space, ["system", "id"])
    return kept.select("system", "id", F.array_join("ranked", ",").alias("codes"))


@query("a34_label_space", f"WITH {CODE_ROWS}, {ADMISSIONS} SELECT DISTINCT complaint, substr(code, 1, 3) AS label FROM code_rows JOIN adm USING (id) WHERE is_gold")
def label_space(spark: SparkSession, d: str) -> DataFrame:
    gold = code_rows(spark, d).filter("is_gold").join(admissions(spark, d), "id")
    return FR.label_space(gold, C.short_code("code"), ["complaint"])


RANK_SQL = f"""WITH {CODE_ROWS}, {LISTS}, r AS (SELECT system, pred, gold[1] AS truth, list_position(pred, gold[1]) AS pos FROM lists)"""


@query(
    "a16_a17_ranking",
    f"""{RANK_SQL} SELECT system, round(avg(coalesce(1.0::DOUBLE / nullif(pos, 0), 0)), 6) AS mrr,
      {', '.join(f'round(avg((coalesce(pos, 0) BETWEEN 1 AND {k})::INT), 6) AS recall_at_{k}' for k in (1, 3, 5, 10))} FROM r GROUP BY system""",
)
def ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_lists(spark, d).withColumn("truth", F.get("gold", F.lit(0)))
    scores = RM.ranking(rows, ["system"], F.col("pred"), F.col("truth"))
    return rounded(scores, [c for c in scores.columns if c != "system"])


@query(
    "a18_top1_f1",
    f"""WITH rows AS (SELECT lang, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth,
        CASE WHEN n_chars < 40 THEN '' WHEN n_chars < 2000 THEN 'good' ELSE 'bad' END AS guess
      FROM documents JOIN labels USING (doc_id)),
    pairs AS (SELECT lang, truth AS code, true AS is_gold, truth = guess AS is_pred FROM rows UNION ALL
      SELECT lang, guess, false, true FROM rows WHERE guess <> truth),
    {counts_sql('lang')}, {scored_sql()}, {micro_macro_sql('lang')}
    SELECT lang, round(f1_micro, 6) AS f1_micro_at_1, round(f1_macro, 6) AS f1_macro_at_1 FROM mm""",
)
def top1_f1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    truth = F.when(F.col("quality") == 1, "good").otherwise("bad")
    guess = F.when(F.col("n_chars") < 40, F.array().cast("array<string>")).otherwise(
        F.array(F.when(F.col("n_chars") < 2000, "good").otherwise("bad"))
    )
    return rounded(RM.top1_f1(docs, ["lang"], guess, truth), ["f1_micro_at_1", "f1_macro_at_1"])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Whole embeddings, lengthened by label, rounded to -1 / 0 / 1 twice."""

    def signs(low: float):
        cut = F.concat("embedding", F.slice("embedding", 1, F.col("label")))
        return F.transform(cut, lambda x: F.when(x > low, 1).when(x < -low, -1).otherwise(0))

    pred = F.when(F.col("vec_id") % 7 != 0, signs(0.05))
    return table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") % 3).alias("collection"), pred.alias("pred"), signs(0.125).alias("truth")
    )


VEC_SQL = """WITH v AS (SELECT vec_id, label % 3 AS collection, label, list_concat(embedding, embedding[1:label]) AS e FROM embeddings),
  s AS (SELECT vec_id, collection, vec_id % 7 <> 0 AS has,
      list_transform(e, lambda x: CASE WHEN x::DOUBLE > 0.125 THEN 1.0 WHEN x::DOUBLE < -0.125 THEN -1.0 ELSE 0.0 END::DOUBLE) AS t,
      list_transform(e, lambda x: CASE WHEN vec_id % 7 = 0 THEN 0.0 WHEN x::DOUBLE > 0.05 THEN 1.0 WHEN x::DOUBLE < -0.05 THEN -1.0 ELSE 0.0 END::DOUBLE) AS p FROM v),
  m AS (SELECT *, list_inner_product(p, t) AS dp, list_inner_product(p, p) AS pp, list_inner_product(t, t) AS k FROM s)"""


@query(
    "a19_vector_agreement",
    f"""{VEC_SQL}, g AS (SELECT collection, len(t) AS l, count(*) AS n,
        round(avg(CASE WHEN pp > 0 AND k > 0 THEN dp / (sqrt(pp) * sqrt(k)) ELSE 0 END), 4) AS cos,
        round(avg(CASE WHEN k > 0 THEN (dp + k) / (2 * k) ELSE 0 END), 4) AS dot FROM m GROUP BY ALL)
    SELECT collection, round(sum(cos * n) / sum(n), 6) AS cos_sim, round(sum(dot * n) / sum(n), 6) AS dot_product FROM g GROUP BY collection""",
)
def vector_agreement(spark: SparkSession, d: str) -> DataFrame:
    scores = RM.vector_agreement(vectors(spark, d), ["collection"], F.col("pred"), F.col("truth"))
    return rounded(scores, ["cos_sim", "dot_product"])


@query(
    "c22_c23_c33_vector_scores",
    f"""{VEC_SQL} SELECT vec_id, CASE WHEN has THEN round(CASE WHEN k > 0 THEN (dp + k) / (2 * k) ELSE 0.5 END, 6) END AS norm_dot,
      round(CASE WHEN pp > 0 AND k > 0 THEN dp / (sqrt(pp) * sqrt(k)) ELSE 0 END, 6) AS cosine FROM m""",
)
def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    pred, truth = F.col("pred"), F.col("truth")
    return vectors(spark, d).select(
        "vec_id", F.round(S.norm_dot(pred, truth), 6).alias("norm_dot"),
        F.round(S.cosine(S.zero_filled(pred, truth), truth), 6).alias("cosine"),
    )


@query(
    "a20_answer_validity",
    """SELECT event_type, round(avg((CAST(json_extract(props, '$.k') AS INT) >= 20)::INT), 6) AS v1_valid,
      round(avg((value >= 5)::INT), 6) AS v2_valid FROM events GROUP BY event_type""",
)
def answer_validity(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, d, "events").select(
        "event_type", F.when(k >= 20, F.col("props")).otherwise(F.lit("None")).alias("v1_json"),
        F.when(F.col("value") >= 5, F.col("props")).alias("v2_json"),
    )
    rates = RM.answer_validity(rows, ["event_type"], {"v1_valid": "v1_json", "v2_valid": "v2_json"})
    return rounded(rates, ["v1_valid", "v2_valid"])


@query(
    "a21_list_lengths",
    f"WITH {CODE_ROWS}, {LISTS} SELECT system, round(avg(len(pred)), 2) AS pred_len, round(avg(len(gold)), 2) AS gold_len FROM lists GROUP BY system",
)
def list_lengths(spark: SparkSession, d: str) -> DataFrame:
    return RM.list_lengths(answer_lists(spark, d), ["system"], {"pred_len": F.col("pred"), "gold_len": F.col("gold")})


@query(
    "a06_w08_code_frequency",
    f"""WITH {CODE_ROWS}, c AS (SELECT substr(code, 1, 3) AS code, count(*) AS n FROM code_rows WHERE is_gold GROUP BY 1)
    SELECT code, n, row_number() OVER (ORDER BY n DESC, code) AS rank,
      round(sum(n) OVER (ORDER BY n DESC, code ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c)::DOUBLE, 6) AS cum_share FROM c""",
)
def code_frequency(spark: SparkSession, d: str) -> DataFrame:
    gold = code_rows(spark, d).filter("is_gold").select(C.short_code("code").alias("code"))
    return rounded(FR.cumulative_share(FR.code_frequency(gold)), ["cum_share"])


@query(
    "a06_cutoff_rank",
    f"""WITH {CODE_ROWS}, c AS (SELECT substr(code, 1, 3) AS code, count(*) AS n FROM code_rows WHERE is_gold GROUP BY 1),
    s AS (SELECT sum(n) OVER (ORDER BY n DESC, code ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM c)::DOUBLE AS share FROM c)
    SELECT count(*) FILTER (WHERE share < 0.8) + 1 AS cutoff_rank FROM s""",
)
def cutoff_rank(spark: SparkSession, d: str) -> DataFrame:
    gold = code_rows(spark, d).filter("is_gold").select(C.short_code("code").alias("code"))
    return FR.cutoff_rank(FR.cumulative_share(FR.code_frequency(gold)), 0.8)


MATCH_SQL = f"""{CODE_ROWS}, {LISTS}, {ADMISSIONS},
  ranks AS (SELECT system, id, complaint, split, coalesce(list_position(pred, gold[1]), 0) - 1 AS a, coalesce(list_position(gold, pred[1]), 0) - 1 AS b
    FROM lists JOIN adm USING (id)),
  cats AS (SELECT *, CASE WHEN least(a, b) < 0 THEN -1 WHEN greatest(a, b) <= 2 THEN greatest(a, b) ELSE 3 END AS match_category FROM ranks)"""


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the first gold code among the predictions and the other way round."""
    rows = answer_lists(spark, d).join(admissions(spark, d), "id")
    a = S.position_of(F.col("pred"), F.get("gold", F.lit(0)))
    b = S.position_of(F.col("gold"), F.get("pred", F.lit(0)))
    return rows.select("system", "id", "complaint", "split", a.alias("a"), b.alias("b")).withColumn(
        "match_category", S.match_category(F.col("a"), F.col("b"))
    )


@query("w02_c26_match_category", f"WITH {MATCH_SQL} SELECT system, id, a::INT AS a, b::INT AS b, match_category::INT AS match_category FROM cats")
def match_category(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select("system", "id", "a", "b", "match_category")


_CATS = {0: "cat_0", 1: "cat_1", 2: "cat_2", 3: "cat_3", -1: "cat_m1"}
_CAT_SQL = ", ".join(f"count(*) FILTER (WHERE match_category = {c}) AS {a}" for c, a in _CATS.items())


@query(
    "a03_category_summary",
    f"WITH {MATCH_SQL} SELECT coalesce(split, 'total') AS split, {_CAT_SQL}, count(*) AS total FROM cats GROUP BY ROLLUP (split)",
)
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return FR.category_summary(matched(spark, d))


@query(
    "a04_category_shares",
    f"""WITH {MATCH_SQL}, w AS (SELECT complaint, {_CAT_SQL}, count(*) AS total FROM cats GROUP BY complaint)
    SELECT *, {', '.join(f'round(100 * {a} / total::DOUBLE, 1) AS {a}_pct' for a in _CATS.values())} FROM w""",
)
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    return FR.category_shares(matched(spark, d), "complaint")


_BUCKET = "CASE WHEN {0} = -1 THEN '-1' WHEN {0} BETWEEN 0 AND 2 THEN CAST({0} AS VARCHAR) ELSE '3+' END"


@query(
    "a05_c27_rank_grid",
    f"WITH {MATCH_SQL} SELECT {_BUCKET.format('a')} AS bucket_a, {_BUCKET.format('b')} AS bucket_b, count(*) AS n FROM cats GROUP BY ALL",
)
def rank_grid(spark: SparkSession, d: str) -> DataFrame:
    return FR.rank_grid(matched(spark, d), "a", "b", 3)


SEED_COLUMNS = ["f1_micro", "f1_macro", "precision_macro", "recall_macro"]


@query(
    "a29_seed_average",
    f"""WITH {CODE_ROWS}, pairs AS (SELECT system, seed, id, code, bool_or(is_gold) AS is_gold, bool_or(is_pred) AS is_pred FROM code_rows GROUP BY ALL),
    {counts_sql('system, seed')}, {scored_sql()}, {micro_macro_sql('system, seed')},
    sizes AS (SELECT system, seed, count(DISTINCT id) AS n_samples FROM pairs GROUP BY ALL)
    SELECT system, {', '.join(f'round(avg({c}) * 100, 2) AS {c}' for c in SEED_COLUMNS)}, max(n_samples) AS n_samples,
      min(n_samples) = max(n_samples) AS same_size FROM mm JOIN sizes USING (system, seed) GROUP BY system""",
)
def seed_average(spark: SparkSession, d: str) -> DataFrame:
    by = ["system", "seed"]
    pairs = SM.distinct_pairs(code_rows(spark, d), [*by, "id"])
    sizes = pairs.groupBy(*by).agg(F.count_distinct("id").alias("n_samples"))
    scores = SM.micro_macro(SM.code_counts(pairs, by), by).join(sizes, by)
    return RP.seed_average(scores, ["system"], SEED_COLUMNS)


@query(
    "a25_audit",
    f"""WITH {CODE_ROWS}, pairs AS (SELECT system, seed, id, code, bool_or(is_gold) AS is_gold, bool_or(is_pred) AS is_pred FROM code_rows GROUP BY ALL),
    {counts_sql('system, seed')}, {scored_sql()}, {micro_macro_sql('system, seed')},
    long AS (SELECT system, 'f1' AS metric, 100 * f1_macro AS value FROM mm UNION ALL SELECT system, 'recall', 100 * recall_macro FROM mm),
    {counts_sql('system', name='counts2')}, {scored_sql('counts2', 'scored2')}, {micro_macro_sql('system', 'scored2', 'mm2')},
    pub AS (SELECT system, 'f1' AS metric, round(100 * f1_macro, 2) AS published, true AS asserted FROM mm2
      UNION ALL SELECT system, 'recall', round(100 * recall_macro, 2), false FROM mm2),
    m AS (SELECT system, metric, avg(value) AS value FROM long GROUP BY ALL)
    SELECT system, metric, published, round(value, 2) AS recomputed, round(value - published, 2) AS delta, asserted,
      asserted AND abs(value - published) > 0.01 AS failed FROM m JOIN pub USING (system, metric)""",
)
def audit(spark: SparkSession, d: str) -> DataFrame:
    pairs = SM.distinct_pairs(code_rows(spark, d), ["system", "seed", "id"])
    per_seed = SM.micro_macro(SM.code_counts(pairs, ["system", "seed"]), ["system", "seed"])
    pooled = SM.micro_macro(SM.code_counts(pairs, ["system"]), ["system"])
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), (100 * F.col(f"{m}_macro")).alias("value")) for m in ("f1", "recall")
    ])
    published = pooled.select("system", F.inline(cells)).select(
        "system", "metric", F.round("value", 2).alias("published"), (F.col("metric") == "f1").alias("asserted")
    )
    return RP.audit(per_seed.select("system", F.inline(cells)), published, ["system"])


@query(
    "j13_align_to_reference",
    f"""WITH {CODE_ROWS}, {LISTS}, ref AS (SELECT id, gold FROM lists WHERE system = 'A')
    SELECT l.system, l.id, len(list_intersect(l.pred, ref.gold)) AS n_common, len(ref.gold) AS n_gold FROM lists l JOIN ref USING (id)""",
)
def align_to_reference(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_lists(spark, d)
    aligned = SM.align_to_reference(rows, rows.filter("system = 'A'"), "id")
    return aligned.select(
        "system", "id", F.size(F.array_intersect("pred", "gold")).cast("bigint").alias("n_common"), F.size("gold").cast("bigint").alias("n_gold")
    )
