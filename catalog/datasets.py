"""Merging generators, instruction datasets, prompts and training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog.cohort import COMPLAINTS, PATTERNS, diseases
from catalog.inputs import ADMISSIONS, CODE_ROWS, LISTS, admissions, answer_lists, table, text_sum, text_sum_sql
from catalog.registry import query
from scorefold.functions import rendering as R, scoring as S
from scorefold.operators import assignment as A, filters as FL, quality as Q, reports as RP
from scorefold.plans import instructions as I, merge as MG

# --- merging generators ---------------------------------------------------------


def generated(spark: SparkSession, d: str) -> DataFrame:
    """Events as generated answers of three models; a user's week is an admission."""
    kind = F.col("event_type")
    cc = F.when(kind == "click", "cc_abdominal_pain").when(kind == "view", "cc_dyspnea").otherwise(F.concat(F.lit("cc_"), kind))
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    rows = table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("subject_id"), (F.col("user_id") * 10 + week).alias("hadm_id"), cc.alias("cc"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        (F.col("event_id") % 5 - 1).cast("int").alias("match_category"), F.col("value").alias("v4_score"),
    )
    split = F.element_at(F.array(*[F.lit(s) for s in ("val", "dev", "train", "test")]), (F.col("hadm_id") % 4 + 1).cast("int"))
    return rows.withColumn("split", split)


GEN_SQL = """gen AS (SELECT event_id, user_id AS subject_id, user_id * 10 + (day(ts) - 1) // 7 AS hadm_id,
    CASE event_type WHEN 'click' THEN 'cc_abdominal_pain' WHEN 'view' THEN 'cc_dyspnea' ELSE 'cc_' || event_type END AS cc,
    'm' || CAST(event_id % 3 AS VARCHAR) AS model, event_id % 5 - 1 AS match_category, value FROM events),
  kept AS (SELECT * FROM gen WHERE match_category BETWEEN 0 AND CASE WHEN cc IN ('cc_abdominal_pain', 'cc_dyspnea') THEN 1 ELSE 2 END),
  common AS (SELECT subject_id, hadm_id, cc FROM kept GROUP BY ALL HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM kept)),
  sizes AS (SELECT cc, count(*) AS size FROM common GROUP BY cc),
  assigned AS (SELECT subject_id, hadm_id, cc FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY size, cc) AS rn
    FROM common JOIN sizes USING (cc)) WHERE rn = 1),
  merged AS (SELECT kept.*, CASE hadm_id % 4 WHEN 2 THEN 'train' WHEN 3 THEN 'test' ELSE 'dev' END AS split
    FROM kept SEMI JOIN assigned USING (subject_id, hadm_id, cc))"""


@query("f03_rank_filter", f"WITH {GEN_SQL} SELECT cc, match_category::INT AS match_category, count(*) AS n FROM kept GROUP BY ALL")
def rank_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = FL.within_rank(generated(spark, d), FL.complaint_name(F.col("cc")))
    return kept.groupBy("cc", "match_category").agg(F.count("*").alias("n"))


@query("w07_u02_assignment", f"WITH {GEN_SQL} SELECT * FROM assigned")
def assignment(spark: SparkSession, d: str) -> DataFrame:
    return MG.merge_generators(generated(spark, d))[1]


@query("j10_d03_merge_generators", f"WITH {GEN_SQL} SELECT hadm_id, event_id, model AS gen_model, split FROM merged")
def merge_generators(spark: SparkSession, d: str) -> DataFrame:
    merged, _ = MG.merge_generators(generated(spark, d))
    combined = MG.combine(merged)
    # combine() keeps the columns of the common layout only.
    return combined.join(
        merged.select("subject_id", "hadm_id", F.col("model").alias("gen_model"), "v4_score", "event_id"),
        ["subject_id", "hadm_id", "gen_model", "v4_score"],
    ).select("hadm_id", "event_id", "gen_model", "split").distinct()


@query(
    "a33_before_after",
    f"""WITH {GEN_SQL}, b AS (SELECT model, cc, count(*) AS before FROM kept GROUP BY ALL), a AS (SELECT model, cc, count(*) AS after FROM merged GROUP BY ALL),
    j AS (SELECT model, cc, before, coalesce(after, 0) AS after FROM b LEFT JOIN a USING (model, cc))
    SELECT model, coalesce(cc, 'TOTAL') AS cc, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, sum(before - after)::BIGINT AS removed
    FROM j GROUP BY GROUPING SETS ((model, cc), (model))""",
)
def before_after(spark: SparkSession, d: str) -> DataFrame:
    kept = FL.within_rank(generated(spark, d), FL.complaint_name(F.col("cc")))
    merged, _ = MG.merge_generators(generated(spark, d))
    return A.before_after(kept, merged)


@query(
    "a33_cross_model_table",
    f"""WITH {GEN_SQL}, c AS (SELECT model, cc, count(*) AS before FROM kept GROUP BY ALL), a AS (SELECT model, cc, count(*) AS after FROM merged GROUP BY ALL),
    j AS (SELECT model, cc, before, coalesce(after, 0) AS after FROM c LEFT JOIN a USING (model, cc)),
    t AS (SELECT model, coalesce(cc, 'TOTAL') AS cc, sum(before)::BIGINT AS b, sum(after)::BIGINT AS a FROM j GROUP BY GROUPING SETS ((model, cc), (model)))
    SELECT cc, {', '.join(f"coalesce(max(b) FILTER (WHERE model = '{m}'), 0) || '→' || coalesce(max(a) FILTER (WHERE model = '{m}'), 0) AS {m}" for m in ('m0', 'm1', 'm2'))}
    FROM t GROUP BY cc""",
)
def cross_model_table(spark: SparkSession, d: str) -> DataFrame:
    return A.cross_model_table(before_after(spark, d), ["m0", "m1", "m2"])


@query("s13_complaint_subjects", f"WITH {GEN_SQL} SELECT DISTINCT replace(cc, 'cc_', '') AS cc, subject_id FROM assigned")
def complaint_subjects(spark: SparkSession, d: str) -> DataFrame:
    return A.subjects_per_complaint(MG.merge_generators(generated(spark, d))[1])


@query(
    "f04_rare_case_filter",
    f"WITH {GEN_SQL} SELECT cc, count(*) AS n FROM gen SEMI JOIN (SELECT DISTINCT cc, subject_id FROM assigned) USING (cc, subject_id) GROUP BY cc",
)
def rare_case_filter(spark: SparkSession, d: str) -> DataFrame:
    saved = MG.merge_generators(generated(spark, d))[1]
    return FL.in_cohort(generated(spark, d), saved, ["cc", "subject_id"]).groupBy("cc").agg(F.count("*").alias("n"))


@query(
    "d04_evaluation_dataset",
    f"""WITH {CODE_ROWS}, {LISTS}, {ADMISSIONS} SELECT DISTINCT id AS hadm_id, complaint AS "Chief Complaint", split FROM lists JOIN adm USING (id)
    WHERE split <> 'train'""",
)
def evaluation_dataset(spark: SparkSession, d: str) -> DataFrame:
    combined = patients(spark, d).withColumn("gen_model", F.col("model"))
    return MG.evaluation_dataset(combined).select("hadm_id", "Chief Complaint", "split")


# --- instruction rows ---------------------------------------------------------------


def patients(spark: SparkSession, d: str) -> DataFrame:
    """Merged per-model rows: scores, stored answers, texts and prompts of the four stages."""
    rows = answer_lists(spark, d).join(admissions(spark, d), "id")
    names = F.array_distinct(F.transform("pred", lambda c: F.substring(c, 1, 3)))
    # A diagnosis is known without codes too.
    disease = F.coalesce(F.substring(F.get("gold", F.lit(0)), 1, 3), F.lit("R69"))
    quoted = F.transform("pred", lambda c: F.concat(F.lit("{'icd_code': '"), c, F.lit("', 'reason': 'r "), c, F.lit("'}")))
    v4 = F.when(F.size("pred") > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))).otherwise(F.lit("None"))
    ranked = F.to_json(F.transform(names, lambda n: F.struct(n.alias("name"), F.concat(F.lit("n "), n).alias("reason"))))
    v2 = F.when(F.size("pred") > 0, ranked)
    flag = F.when(F.col("id") % 2 == 0, "1").otherwise("-1")
    v1 = F.concat(F.lit("{'Fever': {'value': "), flag, F.lit(", 'reasoning': 'seen'}, 'Cough': {'value': 0, 'reasoning': 'none'}}"))
    reciprocal = F.when(F.size("pred") > 0, S.reciprocal_rank(names, disease))
    text = F.concat(F.lit("<think>\nthinking about "), F.col("id").cast("string"), F.lit("\n</think> rest ```json``` more"))
    position = F.array_position(F.array(*[F.lit(c) for c in COMPLAINTS]), F.col("complaint"))
    vector = F.transform(F.sequence(F.lit(1), (position + 4).cast("int")), lambda i: (i % 3 - 1).cast("int"))

    def prompt(s: int) -> Column:
        p = F.concat(F.lit(f"Prompt {s} for "), F.col("id").cast("string"))
        return F.when(F.col("id") % 13 != 0, p) if s == 2 else p

    stages = {f"v{s}_text": text for s in I.STAGES} | {f"v{s}_prompt": prompt(s) for s in I.STAGES}
    return rows.select(
        F.col("id").alias("hadm_id"), "subject_id", "split", F.concat(F.lit("cc_"), "complaint").alias("cc"),
        F.col("complaint").alias("Chief Complaint"), F.col("system").alias("model"), F.col("gold").alias("ICD_CODES"),
        disease.alias("disease"), vector.alias("disease_vector"),
        F.concat(F.lit("Note of "), F.col("id").cast("string"), F.lit(" {labs}")).alias("admission_note"),
        F.when(F.col("id") % 3 == 0, F.lit("None")).when(F.col("id") % 3 == 1, F.lit("5.0 mg Na")).alias("labs"),
        ((F.col("id") % 11) / 10).alias("v1_score"), F.when(F.col("id") % 3 != 0, v1).alias("v1_json"),
        reciprocal.alias("v2_score"), v2.alias("v2_json"),
        (reciprocal / 2).alias("v3_score"), F.when(F.col("id") % 2 == 0, v2).alias("v3_json"),
        F.when(F.size("pred") > 1, F.round(S.set_f1(F.col("pred"), F.col("gold")), 3)).alias("v4_score"), v4.alias("v4_json"),
        *[c.alias(n) for n, c in stages.items()],
    )


def _json_sql(items: str, key: str) -> str:
    return f"""'[' || array_to_string(list_transform({items}, lambda x: '{{"{key}": "' || x.k || '", "reason": "' || x.r || '"}}'), ', ') || ']'"""


def _numbered_sql(items: str, sep: str = ": ") -> str:
    return f"array_to_string(list_transform({items}, lambda x, i: i || '{sep}' || x), chr(10))"


_NAME_AFTER = "'I think in order of likelihood this is the order of diseases:' || chr(10) || " + _numbered_sql("names") + " || chr(10) || 'After final reranking the diseases, I think this is the order of diseases:'"
_CODE_AFTER = "'I think the patient has the following ICD codes:' || chr(10) || " + _numbered_sql("pred") + " || chr(10) || 'After a final consideration, I think the patient has the following ICD codes:'"
_FINDINGS = """'{"Fever": {"value": ' || CASE WHEN id % 2 = 0 THEN '1' ELSE '-1' END || ', "reasoning": "seen"}, "Cough": {"value": 0, "reasoning": "none"}}'"""

PATIENTS_SQL = f"""{CODE_ROWS}, {LISTS}, {ADMISSIONS},
  pat0 AS (SELECT id, system AS model, subject_id, split, complaint, gold, pred, coalesce(substr(gold[1], 1, 3), 'R69') AS disease,
      list_transform(pred, lambda c: substr(c, 1, 3)) AS cats FROM lists JOIN adm USING (id)),
  pat1 AS (SELECT *, list_filter(cats, lambda c, i: list_position(cats, c) = i) AS names FROM pat0),
  pat AS (SELECT *, list_position(names, disease) AS pos, CASE WHEN len(pred) > 0 THEN coalesce(1.0::DOUBLE / nullif(list_position(names, disease), 0), 0) END AS rr,
      len(list_intersect(pred, gold))::DOUBLE AS hit FROM pat1),
  raw AS (SELECT id, model, subject_id, split, complaint, gold, pred, names, disease, pos, 'thinking about ' || id AS base, s AS stage,
      CASE s WHEN 1 THEN (id % 11) / 10 WHEN 2 THEN rr WHEN 3 THEN rr / 2 ELSE
        CASE WHEN len(pred) > 1 THEN round(CASE WHEN hit > 0 THEN 2 * (hit / len(pred)) * (hit / len(gold)) / (hit / len(pred) + hit / len(gold)) ELSE 0 END, 3) END END::DOUBLE AS score,
      CASE s WHEN 1 THEN id % 3 <> 0 WHEN 3 THEN len(pred) > 0 AND id % 2 = 0 ELSE len(pred) > 0 END AS usable,
      NOT (s = 2 AND id % 13 = 0) AS has_input
    FROM pat, (VALUES (1), (2), (3), (4)) v(s)),
  ready AS (SELECT *, 
      {_json_sql("list_transform(names, lambda n: {'k': n, 'r': 'n ' || n})", "name")} AS names_json,
      {_json_sql("list_transform(pred, lambda c: {'k': c, 'r': 'r ' || c})", "icd_code")} AS codes_json,
      {_json_sql('''list_concat(CASE WHEN coalesce(pos, 0) > 0 THEN [{'k': disease, 'r': 'n ' || disease}] ELSE [{'k': disease, 'r': 'Based on the admission note ' || disease || ' is suspected.'}] END,
        list_transform(list_filter(names, lambda n: n <> disease), lambda n: {'k': n, 'r': 'n ' || n}))''', "name")} AS names_fixed,
      {_json_sql('''list_concat(list_transform(list_filter(pred, lambda c: list_contains(list_transform(gold, lambda g: substr(g, 1, 3)), substr(c, 1, 3))), lambda c: {'k': c, 'r': 'r ' || c}),
        list_transform(list_filter(gold, lambda g: NOT list_contains(names, substr(g, 1, 3))), lambda g: {'k': g, 'r': 'Based on the admission note code ' || g || ' is suspected.'}))''', "icd_code")} AS codes_fixed,
      {_json_sql("[{'k': disease, 'r': 'Based on the admission note ' || disease || ' is suspected.'}]", "name")} AS names_gold,
      {_json_sql("list_transform(gold, lambda c: {'k': c, 'r': 'Based on the admission note code ' || c || ' is suspected.'})", "icd_code")} AS codes_gold
    FROM raw)"""


def _variant_rows_sql() -> str:
    def row(name: str, v: I.Variant) -> str:
        t = v.thresholds or I.NO_THRESHOLDS
        return f"('{name}', {v.best_per_id}, {', '.join(str(float(t[s])) for s in I.STAGES)}, {4 in v.duplicates}, {v.drop})"

    return "variants(variant, best, t1, t2, t3, t4, dup, drop_rows) AS (VALUES " + ", ".join(row(n, v) for n, v in I.VARIANTS.items()) + ")"


RENDER_SQL = f"""{PATIENTS_SQL}, {_variant_rows_sql()},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY id, stage ORDER BY score DESC NULLS LAST, model) AS rn FROM ready
    WHERE TRUE),
  used AS (SELECT * FROM ranked, variants WHERE (NOT best OR rn = 1)
    UNION ALL SELECT * FROM ranked, variants WHERE NOT best AND dup AND stage = 4),
  marked AS (SELECT *, coalesce(usable AND score > 0 AND score >= CASE stage WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END, false) AS trace FROM used),
  rendered AS (SELECT variant, id, model, subject_id, split, complaint, stage, score, trace,
      CASE WHEN NOT trace THEN '' WHEN stage IN (2, 3) AND score < 1 THEN base || {_NAME_AFTER} WHEN stage = 4 AND score < 1 THEN base || {_CODE_AFTER} ELSE base END AS thinking,
      CASE WHEN usable THEN CASE stage WHEN 1 THEN {_FINDINGS} WHEN 4 THEN CASE WHEN trace AND score >= 1 THEN codes_json ELSE codes_fixed END
          ELSE CASE WHEN trace AND score >= 1 THEN names_json ELSE names_fixed END END
        ELSE CASE stage WHEN 1 THEN NULL WHEN 4 THEN codes_gold ELSE names_gold END END AS output
    FROM marked WHERE has_input AND (trace OR NOT drop_rows)),
  final AS (SELECT * FROM rendered WHERE output IS NOT NULL)"""


@query(
    "d06_all_variants",
    f"""WITH {RENDER_SQL} SELECT variant, stage::INT AS "Verifier", trace, count(*) AS n, {text_sum_sql('output')} AS outputs, {text_sum_sql('thinking')} AS thoughts
    FROM final GROUP BY ALL""",
)
def all_variants(spark: SparkSession, d: str) -> DataFrame:
    return I.build_variants(patients(spark, d)).groupBy("variant", "Verifier", "trace").agg(
        F.count("*").alias("n"), text_sum(F.col("Output")).alias("outputs"), text_sum(F.col("Thinking")).alias("thoughts")
    )


@query(
    "d05_c12_c16_instruction_rows",
    f"""WITH {RENDER_SQL} SELECT subject_id, split, stage::INT AS "Verifier", count(*) AS n, round(sum(score), 4) AS score, {text_sum_sql('output')} AS outputs,
      {text_sum_sql("thinking || '|' || model || '|cc_' || complaint || '|Prompt ' || stage || ' for ' || id")} AS rest FROM final WHERE variant = 'thr_full' GROUP BY ALL""",
)
def instruction_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = I.build_instructions(patients(spark, d), I.VARIANTS["thr_full"])
    rest = F.concat_ws("|", "Thinking", "model", "chief_complaint", "Input")
    return rows.groupBy("subject_id", "split", "Verifier").agg(
        F.count("*").alias("n"), F.round(F.sum("Score"), 4).alias("score"), text_sum(F.col("Output")).alias("outputs"), text_sum(rest).alias("rest")
    )


@query(
    "a32_u05_trace_counts",
    f"""WITH {RENDER_SQL} SELECT variant, stage::INT AS "Verifier", count(*) AS total, count(*) FILTER (WHERE trace) AS reasoning,
      count(*) FILTER (WHERE NOT trace) AS fallback FROM final GROUP BY ALL""",
)
def trace_counts(spark: SparkSession, d: str) -> DataFrame:
    return RP.trace_counts(I.build_variants(patients(spark, d)), ["variant"])


# --- direct rows and prompts ----------------------------------------------------------

TEMPLATES = [
    (1, "generic", "Extract. {admission_note} {{json}}\n{symptom_format_example}"), (1, "1-URGENT", "Urgent! {admission_note}"),
    (2, "generic", "Rank. {admission_note}\n{potential_diagnoses}"), (3, "generic", "Rerank. {admission_note} {laboratory_results}\n{potential_diagnoses}"),
    (4, "generic", "Codes. {admission_note} {laboratory_results} end"),
]


def schemes(spark: SparkSession) -> DataFrame:
    rows = [(c, [f"f{n}" for n in range(1, 6 + i)]) for i, c in enumerate(COMPLAINTS)]
    return spark.createDataFrame(rows, "chief_complaint string, features array<string>")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "stage int, complaint string, template string")


_CAND_SQL = "cand(complaint, diag) AS (VALUES " + ", ".join(
    f"('{c}', '" + "' || chr(10) || '".join(f"{p + 1}. {n}" for p, (n, _) in enumerate(PATTERNS[: 5 - i // 2])) + "')" for i, c in enumerate(COMPLAINTS)
) + ")"
_DIM_SQL = "dim(complaint, k) AS (VALUES " + ", ".join(f"('{c}', {5 + i})" for i, c in enumerate(COMPLAINTS)) + ")"
_EXAMPLE = """'{' || chr(10) || array_to_string(list_transform(range(1, k + 1), lambda i: '    "f' || i || '": {' || chr(10) || '        "value": 0,' || chr(10) ||
  '        "reasoning": "Based on the admission note, f' || i || ' is suspected to be present / absent / unmentioned."' || chr(10) || '    }'), ',' || chr(10)) || chr(10) || '}'"""
_VECTOR = """'{' || chr(10) || array_to_string(list_transform(range(1, k + 1), lambda i: '    "f' || i || '": {' || chr(10) || '        "value": ' || (i % 3 - 1) || ',' || chr(10) ||
  '        "reasoning": "Extracted f' || i || ' from the admission note."' || chr(10) || '    }'), ',' || chr(10)) || chr(10) || '}'"""


@query(
    "d07_c17_c35_direct_rows",
    f"""WITH {PATIENTS_SQL}, {_CAND_SQL}, {_DIM_SQL},
    one AS (SELECT DISTINCT id, subject_id, split, complaint, gold, disease, names_gold, codes_gold, 'Note of ' || id || ' {{labs}}' AS note, CASE WHEN id % 3 = 1 THEN '5.0 mg Na' ELSE '' END AS labs
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY model, stage) AS rn FROM ready) WHERE rn = 1),
    st AS (SELECT *, unnest([1, 2, 3, 4, 4]) AS stage FROM one JOIN cand USING (complaint) JOIN dim USING (complaint)),
    io AS (SELECT *, CASE stage WHEN 1 THEN {_VECTOR} WHEN 4 THEN CASE WHEN len(gold) > 0 THEN codes_gold END ELSE names_gold END AS output,
      CASE stage WHEN 1 THEN CASE WHEN complaint = '1-URGENT' THEN 'Urgent! ' || note ELSE 'Extract. ' || note || ' {{json}}' || chr(10) || {_EXAMPLE} END
        WHEN 2 THEN 'Rank. ' || note || chr(10) || diag WHEN 3 THEN 'Rerank. ' || note || ' ' || labs || chr(10) || diag ELSE 'Codes. ' || note || ' ' || labs || ' end' END AS input FROM st)
    SELECT replace(complaint, ' ', '_') AS chief_complaint, split, stage::INT AS "Verifier", count(*) AS n, {text_sum_sql('output')} AS outputs, {text_sum_sql('input')} AS inputs FROM io GROUP BY ALL""",
)
def direct_rows(spark: SparkSession, d: str) -> DataFrame:
    combined = patients(spark, d).withColumn("gen_model", F.col("model"))
    rows = I.direct_rows(combined, schemes(spark), diseases(spark), templates(spark), duplicates=(4,))
    return rows.groupBy("chief_complaint", "split", "Verifier").agg(
        F.count("*").alias("n"), text_sum(F.col("Output")).alias("outputs"), text_sum(F.col("Input")).alias("inputs")
    )


@query(
    "c18_c19_c20_stage_prompts",
    f"""WITH {PATIENTS_SQL}, one AS (SELECT * FROM ready WHERE stage = 3),
    t AS (SELECT id, model, 'Note of ' || id || ' {{labs}}' AS note, CASE id % 3 WHEN 0 THEN 'None' WHEN 1 THEN '5.0 mg Na' ELSE 'No laboratory results available.' END AS labs,
      CASE WHEN id % 3 <> 0 THEN chr(10) || '#### Present Manifestations' || CASE WHEN id % 2 = 0 THEN chr(10) || '  - Fever: seen' ELSE '' END || chr(10) || chr(10) || '#### Absent Manifestations'
        || CASE WHEN id % 2 = 0 THEN '' ELSE chr(10) || '  - Fever: seen' END ELSE 'Failed to extract manifestations' END AS findings,
      CASE WHEN usable THEN array_to_string(list_transform(CASE WHEN pos > 5 THEN names[1:pos] ELSE names END, lambda n, i: '  ' || i || '. ' || n || ': n ' || n || chr(10)), '') ELSE 'Not assigned' END AS ranked FROM one)
    SELECT id AS hadm_id, count(*) AS n, {text_sum_sql("substr('A ' || note || ' B ' || labs || ' C ' || findings || ' D ' || ranked, 1, 25000)")} AS prompts FROM t GROUP BY id""",
)
def stage_prompts(spark: SparkSession, d: str) -> DataFrame:
    template = "A {admission_note} B {laboratory_results} C {clinical_manifestations} D {potential_diagnoses}"
    one = spark.createDataFrame([(4, "generic", template)], "stage int, complaint string, template string")
    prompts = I.build_prompts(patients(spark, d), schemes(spark), diseases(spark), one, 4)
    return prompts.groupBy("hadm_id").agg(F.count("*").alias("n"), text_sum(F.col("prompt")).alias("prompts"))


# --- training text -----------------------------------------------------------------------


def chats(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    turns = table(spark, d, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("Input"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Output"))
    thinking = F.when(F.col("conv_id") % 3 == 1, F.lit("")).when(F.col("conv_id") % 3 == 2, F.lit("\nplan\n"))
    split = F.when(F.col("conv_id") % 4 == 0, "dev").otherwise("train")
    return user.join(reply, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("hadm_id"), F.col("turn").alias("Verifier"), "Input", "Output", thinking.alias("Thinking"), split.alias("split")
    )


CHAT_SQL = """chats AS (SELECT u.conv_id, u.turn, CASE WHEN u.conv_id % 4 = 0 THEN 'dev' ELSE 'train' END AS split,
    '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || u.text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
    || CASE u.conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '<think>' || chr(10) || 'plan' || chr(10) || '</think>' || chr(10) || chr(10) END
    || a.text || '<|im_end|>' || chr(10) AS text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


@query("c21_d08_training_text", f"WITH {CHAT_SQL} SELECT conv_id AS hadm_id, turn AS \"Verifier\", md5(text) AS digest, split FROM chats")
def training_text(spark: SparkSession, d: str) -> DataFrame:
    texts = I.training_text(chats(spark, d), "Be brief.")
    return texts.select("hadm_id", "Verifier", F.md5("text").alias("digest"), "split")


@query(
    "f13_d08_training_splits",
    f"WITH {CHAT_SQL}, dev AS (SELECT * FROM chats WHERE split = 'dev' ORDER BY conv_id, turn, text LIMIT 20) SELECT 'train' AS part, count(*) AS n FROM chats WHERE split = 'train' UNION ALL SELECT 'dev', count(*) FROM dev",
)
def training_splits(spark: SparkSession, d: str) -> DataFrame:
    train, held_out = I.training_splits(I.training_text(chats(spark, d), "Be brief."), 20)
    out = train.agg(F.count("*").alias("n")).select(F.lit("train").alias("part"), "n")
    for split, rows in held_out.items():
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(split).alias("part"), "n"))
    return out


@query("qg_tagged_reasoning", "SELECT conv_id AS hadm_id, turn FROM conversations WHERE conv_id % 2 = 0 AND text LIKE '% de %'")
def tagged_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """Turns of even conversations get a tag where they hold a word; the check must find exactly those."""
    tag = F.when((F.col("conv_id") % 2 == 0) & F.col("text").contains(" de "), F.lit("</think>")).otherwise(F.lit(""))
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("hadm_id"), "turn", F.concat(F.replace("text", F.lit("think>"), F.lit("")), tag).alias("Thinking")
    )
    return Q.tagged_reasoning(rows).select("hadm_id", "turn")
