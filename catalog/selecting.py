"""Candidate scoring, best-of selection, retry accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.cohort import SIM_SQL, ranked_embeddings
from catalog.inputs import ADMISSIONS, CODE_ROWS, LISTS, admissions, answer_lists, code_rows, table
from catalog.registry import query
from scorefold.functions import parsing as P
from scorefold.operators import filters as FL, selection as SE, similarity as SI
from scorefold.sources import sinks as SK

# --- scored candidates ----------------------------------------------------------


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scored candidates; large quantities have no valid answer."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"), (1 + F.col("l_suppkey") % 4).cast("int").alias("stage"),
        (1 + F.col("l_linenumber") % 4).alias("round"), F.col("l_partkey").alias("choice_idx"),
        F.when(F.col("l_quantity") <= 45, F.round(F.col("l_discount") * 10, 2)).alias("score"),
    )


SCORED = """cand AS (SELECT l_orderkey AS hadm_id, 1 + l_suppkey % 4 AS stage, 1 + l_linenumber % 4 AS round, l_partkey AS choice_idx,
    CASE WHEN l_quantity <= 45 THEN round(l_discount * 10, 2) END AS score FROM lineitem)"""
BEST_CHOICE = """rounds AS (SELECT hadm_id, stage, round, choice_idx, score FROM (SELECT *, row_number() OVER (
    PARTITION BY hadm_id, stage, round ORDER BY score DESC NULLS LAST, choice_idx) AS rn FROM cand) WHERE rn = 1)"""
KEY = ["hadm_id", "stage", "round"]


@query("w03_best_choice", f"WITH {SCORED}, {BEST_CHOICE} SELECT * FROM rounds")
def best_choice(spark: SparkSession, d: str) -> DataFrame:
    return SE.best_choice(scored(spark, d), KEY)


@query(
    "w03_first_valid_choice",
    f"""WITH {SCORED} SELECT hadm_id, stage, round, choice_idx, score FROM (SELECT *, row_number() OVER (
      PARTITION BY hadm_id, stage, round ORDER BY (score IS NULL)::INT, choice_idx, score DESC) AS rn FROM cand) WHERE rn = 1""",
)
def first_valid_choice(spark: SparkSession, d: str) -> DataFrame:
    # A repeated choice number is settled by the score.
    best = scored(spark, d).groupBy(*KEY, "choice_idx").agg(F.max("score").alias("score"))
    return SE.best_choice(best, KEY, eval_mode=True)


BEST_ROUND = """SELECT hadm_id, stage, round, score FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id, stage
    ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN -round ELSE round END) AS rn FROM {source}) WHERE rn = 1"""


@query("w04_best_round", f"WITH {SCORED}, {BEST_CHOICE} {BEST_ROUND.format(source='rounds')}")
def best_round(spark: SparkSession, d: str) -> DataFrame:
    best = SE.best_round(SE.best_choice(scored(spark, d), KEY), ["hadm_id", "stage"])
    return best.select("hadm_id", "stage", "round", "score")


_LIMIT = "CASE stage WHEN 1 THEN 0.6 WHEN 2 THEN 0.5 WHEN 3 THEN 0.8 ELSE 0.55 END"


def _accept_sql(passes: str, source: str = "rounds", name: str = "acc") -> str:
    best = BEST_ROUND.format(source=f"{name}_c").replace("round, score FROM", "round, score, rounds_used, accepted FROM", 1)
    return f"""{name}_w AS (SELECT *, min(CASE WHEN {passes} THEN round END) OVER (PARTITION BY hadm_id, stage) AS a FROM {source}),
  {name}_c AS (SELECT *, max(round) OVER (PARTITION BY hadm_id, stage) AS rounds_used, a IS NOT NULL AS accepted FROM {name}_w WHERE a IS NULL OR round <= a),
  {name} AS ({best})"""


@query("l02_accept_retry", f"WITH {SCORED}, {BEST_CHOICE}, {_accept_sql(f'score > {_LIMIT}')} SELECT * FROM acc")
def accept_retry(spark: SparkSession, d: str) -> DataFrame:
    rounds = SE.best_choice(scored(spark, d), KEY)
    limit = F.element_at(F.create_map(*[F.lit(v) for pair in SE.THRESHOLDS.items() for v in pair]), F.col("stage"))
    out = SE.accept(rounds, ["hadm_id", "stage"], limit)
    return out.select("hadm_id", "stage", "round", "score", "rounds_used", "accepted")


STAGES_SQL = f"""{SCORED}, {BEST_CHOICE}, first3 AS (SELECT * FROM rounds WHERE stage <> 3),
  {_accept_sql(f'score > {_LIMIT}', 'first3', 'o')}, third AS (SELECT r.*, o.score AS floor FROM rounds r
    LEFT JOIN o ON o.hadm_id = r.hadm_id AND o.stage = 2 WHERE r.stage = 3),
  {_accept_sql(f'score > {_LIMIT} AND score >= coalesce(floor, score)', 'third', 't')},
  chain AS (SELECT * FROM o UNION ALL SELECT * FROM t)"""


@query("l03_stage_chain", f"WITH {STAGES_SQL} SELECT * FROM chain")
def stage_chain(spark: SparkSession, d: str) -> DataFrame:
    chain = SE.accept_stages(scored(spark, d), ["hadm_id"])
    return chain.select("hadm_id", "stage", "round", "score", "rounds_used", "accepted")


_EVAL_KEPT = "SELECT hadm_id, stage, round, choice_idx, max(score) AS score FROM cand WHERE stage <> 3 GROUP BY ALL"
_EVAL_SQL = f"""{SCORED}, kept AS ({_EVAL_KEPT}),
  firsts AS (SELECT hadm_id, stage, round, score FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id, stage, round ORDER BY (score IS NULL)::INT, choice_idx) AS rn FROM kept) WHERE rn = 1),
  {_accept_sql('score >= -1', 'firsts', 'e')}"""


@query("l03_evaluation_chain", f"WITH {_EVAL_SQL} SELECT * FROM e")
def evaluation_chain(spark: SparkSession, d: str) -> DataFrame:
    """Stages 1, 2 and 4 in evaluation mode: the first valid choice of the first round that has one."""
    best = scored(spark, d).groupBy(*KEY, "choice_idx").agg(F.max("score").alias("score"))
    chain = SE.accept_stages(best, ["hadm_id"], eval_mode=True)
    return chain.select("hadm_id", "stage", "round", "score", "rounds_used", "accepted")


@query(
    "s14_next_step",
    f"""WITH {_EVAL_SQL}, last AS (SELECT max(struct_pack(stage := stage, round := round)) AS m FROM cand),
    o AS (SELECT count(*) AS n FROM (SELECT DISTINCT hadm_id FROM cand) WHERE hadm_id NOT IN (SELECT hadm_id FROM e, last WHERE accepted AND stage = m.stage))
    SELECT m.stage::INT AS stage, m.round::INT AS round, n AS n_open, n = 0 OR m.round >= 4 AS stage_done FROM last, o""",
)
def next_step(spark: SparkSession, d: str) -> DataFrame:
    """Where an evaluation run resumes: its last stage and round, and the items without an accepted answer there."""
    rows = scored(spark, d)
    best = rows.groupBy(*KEY, "choice_idx").agg(F.max("score").alias("score"))
    accepted = SE.accept_stages(best, ["hadm_id"], eval_mode=True)
    step = SK.next_step(rows, accepted, rows.select("hadm_id").distinct(), ["hadm_id"], SE.BUDGET)
    return step.withColumns({"stage": F.col("stage").cast("int"), "round": F.col("round").cast("int")})


@query(
    "l04_missing_answers",
    "SELECT l_orderkey AS hadm_id, count(*) AS n FROM lineitem WHERE l_quantity > 45 OR l_linenumber = 3 GROUP BY 1",
)
def missing_answers(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation mode: what is asked again are rows without an answer, whatever their score."""
    answer = F.when(F.col("l_linenumber") == 3, "None").when(F.col("l_quantity") <= 45, "[]")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), answer.alias("v1_json"))
    return FL.without_answer(rows, "v1_json").groupBy("hadm_id").agg(F.count("*").alias("n"))


@query(
    "l04_open_items",
    f"WITH {STAGES_SQL} SELECT DISTINCT hadm_id FROM rounds WHERE hadm_id NOT IN (SELECT hadm_id FROM chain WHERE stage = 4 AND accepted)",
)
def open_items(spark: SparkSession, d: str) -> DataFrame:
    chain = SE.accept_stages(scored(spark, d), ["hadm_id"])
    items = scored(spark, d).select("hadm_id").distinct()
    return SE.open_items(items, chain.filter("stage = 4"), ["hadm_id"])


@query("f15_still_open", f"WITH {SCORED} SELECT hadm_id, count(*) AS n FROM cand WHERE score IS NULL OR score <= 0.8 OR score < choice_idx % 2 GROUP BY 1")
def still_open(spark: SparkSession, d: str) -> DataFrame:
    kept = FL.still_open(scored(spark, d), F.col("score"), F.lit(0.8), (F.col("choice_idx") % 2).cast("double"))
    return kept.groupBy("hadm_id").agg(F.count("*").alias("n"))


@query(
    "a31_round_means",
    f"""WITH {SCORED}, {BEST_CHOICE} SELECT stage, round, round(avg(coalesce(score, 0)), 3) AS mean_score, round(avg(score), 3) AS mean_valid_score
    FROM rounds GROUP BY ALL""",
)
def round_means(spark: SparkSession, d: str) -> DataFrame:
    return SE.round_means(SE.best_choice(scored(spark, d), KEY), ["stage", "round"])


@query(
    "w05_best_generator",
    """WITH e AS (SELECT user_id, event_type, event_id % 3 AS model, max(CASE WHEN value >= 2 THEN value END) AS score FROM events GROUP BY ALL)
    SELECT user_id, event_type, model, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC NULLS LAST, model) AS rn FROM e) WHERE rn = 1""",
)
def best_generator(spark: SparkSession, d: str) -> DataFrame:
    per_model = table(spark, d, "events").groupBy("user_id", "event_type", (F.col("event_id") % 3).alias("model")).agg(
        F.max(F.when(F.col("value") >= 2, F.col("value"))).alias("score")
    )
    return SE.best_generator(per_model, ["user_id", "event_type"], "score")


@query(
    "w06_keep_first",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
)
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return SE.keep_first(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# --- scoring answers in free text ------------------------------------------------------


def code_answers(spark: SparkSession, d: str) -> DataFrame:
    """Responses that hold a first draft, the final code list and a broken list."""
    draft = '[{"icd_code": "A00", "reason": "draft"}, {"icd_code": "B00", "reason": "draft"}, {"icd_code": "C00", "reason": "draft"}]'
    entries = F.transform("pred", lambda c: F.struct(c.alias("icd_code"), F.concat(F.lit("it's "), c).alias("reason")))
    text = F.concat(
        F.lit("<think>first " + draft + "</think> Final:\n```json\n"), F.to_json(entries),
        F.lit('\n``` or [{"icd_code": 7, "reason": "broken"}]'),
    )
    return answer_lists(spark, d).select(
        F.col("id").alias("hadm_id"), F.lit("any").alias("chief_complaint"), F.col("system").alias("model"),
        F.lit(4).alias("stage"), F.lit(1).alias("round"), F.lit(0).alias("choice_idx"), text.alias("text"),
    )


@query(
    "c08_c09_extract_codes",
    f"""WITH {CODE_ROWS}, {LISTS} SELECT id AS hadm_id, system AS model,
      CASE WHEN len(pred) BETWEEN 3 AND 30 THEN array_to_string(pred, ',') ELSE 'A00,B00,C00' END AS codes FROM lists""",
)
def extract_codes(spark: SparkSession, d: str) -> DataFrame:
    answer = P.extract_codes(F.col("text"))
    return code_answers(spark, d).select("hadm_id", "model", F.array_join(answer["icd_code"], ",").alias("codes"))


@query(
    "l01_score_code_answers",
    f"""WITH {CODE_ROWS}, {LISTS}, g AS (SELECT id, list(DISTINCT substr(code, 1, 3)) AS gs FROM code_rows WHERE is_gold GROUP BY 1),
    space AS (SELECT list(DISTINCT substr(code, 1, 3)) AS s FROM code_rows WHERE is_gold),
    p AS (SELECT l.id, l.system, gs, list_filter(list_distinct(list_transform(CASE WHEN len(pred) BETWEEN 3 AND 30 THEN pred ELSE ['A00', 'B00', 'C00'] END,
      lambda c: substr(c, 1, 3))), lambda c: list_contains(s, c)) AS ps FROM lists l LEFT JOIN g USING (id), space),
    m AS (SELECT *, len(list_intersect(ps, gs))::DOUBLE AS i FROM p)
    SELECT id AS hadm_id, system AS model, round(CASE WHEN gs IS NULL THEN NULL WHEN i > 0 THEN 2 * (i / len(ps)) * (i / len(gs)) / (i / len(ps) + i / len(gs)) ELSE 0 END, 3) AS score FROM m""",
)
def score_code_answers(spark: SparkSession, d: str) -> DataFrame:
    gold = code_rows(spark, d).filter("is_gold").groupBy(F.col("id").alias("hadm_id"), "code").agg(F.lit(1).alias("one"))
    gold = gold.groupBy("hadm_id").agg(F.collect_list("code").alias("ICD_CODES"))
    space = code_rows(spark, d).filter("is_gold").select(F.substring("code", 1, 3).alias("code")).distinct()
    # Admissions without any gold code have no reference to score against: their score is missing.
    return SE.score_codes(code_answers(spark, d), space, gold).select("hadm_id", "model", "score")


@query(
    "l01_w03_best_code_answer",
    f"""WITH {CODE_ROWS}, {LISTS}, g AS (SELECT id, list(DISTINCT substr(code, 1, 3)) AS gs FROM code_rows WHERE is_gold GROUP BY 1),
    p AS (SELECT l.id, l.system, gs, list_filter(list_distinct(list_transform(CASE WHEN len(pred) BETWEEN 3 AND 30 THEN pred ELSE ['A00', 'B00', 'C00'] END,
      lambda c: substr(c, 1, 3))), lambda c: c NOT IN ('A00', 'B00', 'C00')) AS ps FROM lists l LEFT JOIN g USING (id)),
    m AS (SELECT id, system, round(CASE WHEN gs IS NULL THEN NULL WHEN i > 0 THEN 2 * (i / len(ps)) * (i / len(gs)) / (i / len(ps) + i / len(gs)) ELSE 0 END, 3) AS score FROM (SELECT *, len(list_intersect(ps, gs))::DOUBLE AS i FROM p))
    SELECT id AS hadm_id, system AS model, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, system) AS rn FROM m) WHERE rn = 1""",
)
def best_code_answer(spark: SparkSession, d: str) -> DataFrame:
    """The systems as choices of one round: scored, best kept, text fetched last."""
    answers = code_answers(spark, d)
    choice = F.array_position(F.array(*[F.lit(s) for s in ("A", "N", "R")]), F.col("model")).cast("int")
    answers = answers.withColumn("choice_idx", choice)
    gold = code_rows(spark, d).filter("is_gold").select(F.col("id").alias("hadm_id"), "code").distinct()
    gold = gold.groupBy("hadm_id").agg(F.collect_list("code").alias("ICD_CODES"))
    space = code_rows(spark, d).select(F.substring("code", 1, 3).alias("code")).distinct()
    scores = SE.score_codes(answers, space, gold)
    best = SE.best_choice(scores, ["hadm_id", "stage", "round"])
    return SE.with_text(best, answers).filter(F.col("text").isNotNull()).select("hadm_id", "model", "score")


def name_answers(spark: SparkSession, d: str) -> DataFrame:
    """Ranked name lists from the similarity ranking, in the quotes older models write."""
    entries = F.transform("diseases", lambda n, i: F.concat(
        F.lit("{'name': '"), F.when(i % 2 == 0, n).otherwise(F.concat(F.lit("about "), n)), F.lit("', 'reason': 'close to "), n, F.lit("'}")
    ))
    text = F.concat(F.lit("ranking: ["), F.array_join(entries, ", "), F.lit("] done"))
    return ranked_embeddings(spark, d).select(
        F.col("vec_id").alias("hadm_id"), F.lit("any").alias("chief_complaint"), F.lit("m").alias("model"),
        F.lit(2).alias("stage"), F.lit(1).alias("round"), F.lit(0).alias("choice_idx"), text.alias("text"), F.col("truth").alias("disease"),
    )


@query(
    "l01_score_name_answers",
    f"WITH {SIM_SQL} SELECT vec_id AS hadm_id, 1.0::DOUBLE / list_position(diseases, 'L' || truth) AS score FROM ranked",
)
def score_name_answers(spark: SparkSession, d: str) -> DataFrame:
    answers = name_answers(spark, d)
    names = table(spark, d, "embeddings").select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("label")).distinct()
    known = names.select(F.lit("any").alias("chief_complaint"), F.col("label").alias("name"), "label")
    about = names.select(F.lit("any").alias("chief_complaint"), F.concat(F.lit("about "), "label").alias("name"), "label")
    scores = SE.score_diagnoses(answers.drop("disease"), known.unionByName(about), answers.select("hadm_id", "disease"))
    return scores.select("hadm_id", "score")


FEATURES = [f"finding {i}" for i in range(1, 65)]  # one for each component of an embedding


def _signs(column: str, low: float) -> Column:
    return F.transform(column, lambda x: F.when(x > low, 1).when(x < -low, -1).otherwise(0))


@query(
    "l01_c11_score_finding_answers",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > 0.125 THEN 1.0 WHEN x::DOUBLE < -0.125 THEN -1.0 ELSE 0.0 END::DOUBLE) AS t,
      list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > 0.0625 THEN 1.0 WHEN x::DOUBLE < -0.0625 THEN -1.0 ELSE 0.0 END::DOUBLE) AS p FROM embeddings),
    m AS (SELECT vec_id, list_inner_product(p, t) AS dp, list_inner_product(t, t) AS k FROM s)
    SELECT vec_id AS hadm_id, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN k = 0 THEN 0.5 ELSE round((dp + k) / (2 * k), 3) END AS score FROM m""",
)
def score_finding_answers(spark: SparkSession, d: str) -> DataFrame:
    """Finding maps as text; every fifth answer lacks one feature and is not valid."""
    emb = table(spark, d, "embeddings").withColumn("chief_complaint", F.concat(F.lit("c"), (F.col("label") % 2).cast("string")))
    values = _signs("embedding", 0.0625)
    pairs = F.zip_with(F.array(*[F.lit(f) for f in FEATURES]), values, lambda n, v: F.concat(
        F.lit('"'), n, F.lit('": {"value": '), v.cast("string"), F.lit(', "reasoning": "seen"}')
    ))
    kept = F.when(F.col("vec_id") % 5 == 0, F.slice(pairs, 1, F.size(pairs) - 1)).otherwise(pairs)
    text = F.concat(F.lit("Here: {"), F.array_join(kept, ", "), F.lit("}"))
    answers = emb.select(
        F.col("vec_id").alias("hadm_id"), "chief_complaint", F.lit("m").alias("model"),
        F.lit(1).alias("stage"), F.lit(1).alias("round"), F.lit(0).alias("choice_idx"), text.alias("text"),
    )
    gold = emb.select(F.col("vec_id").alias("hadm_id"), _signs("embedding", 0.125).alias("disease_vector"))
    schemes = spark.createDataFrame([("c0", FEATURES), ("c1", FEATURES)], "chief_complaint string, features array<string>")
    return SE.score_findings(answers, schemes, gold).select("hadm_id", "score")


@query(
    "w01_rank_rows",
    f"WITH {SIM_SQL} SELECT vec_id, name, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pos) AS rank FROM sims",
)
def rank_rows(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranked_embeddings(spark, d).select("vec_id", F.inline(F.arrays_zip(F.col("diseases").alias("name"), F.col("diseases_cossim_scores").alias("score"))))
    scored_rows = ranked.withColumn("pos", F.substring("name", 2, 10).cast("int"))
    return SI.rank_scored(scored_rows, ["vec_id"]).select("vec_id", "name", "rank")


@query(
    "f05_w11_split_head",
    f"WITH {ADMISSIONS} SELECT id, split FROM adm WHERE split IN ('dev', 'test') ORDER BY id LIMIT 30",
)
def split_head(spark: SparkSession, d: str) -> DataFrame:
    return FL.in_splits(admissions(spark, d), ["dev", "test"], ["id"], 30).select("id", "split")
