"""Cohort queries: timed events, sections, dictionaries, similarity ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.inputs import (
    ADMISSIONS, CODE_ROWS, LISTS, admissions, answer_lists, code_rows, rounded, table, text_sum, text_sum_sql,
)
from catalog.registry import query
from scorefold.functions import codes as C, scoring as S, text as X
from scorefold.operators import events as E, filters as FL, matching as M, similarity as SI
from scorefold.plans import cohort as plan

# --- timed events -----------------------------------------------------------


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as lab events; a user's stay runs from the first event for 20 days."""
    events = table(spark, d, "events").select(
        F.col("user_id").alias("hadm_id"), F.col("event_type").alias("itemid"), F.col("ts").alias("storetime"),
        F.when(F.col("value") >= 3, F.col("value")).alias("valuenum"),
        F.when(F.col("event_id") % 3 != 0, F.lit("mg")).alias("valueuom"),
        F.col("event_type").alias("label"),
        F.when(F.col("value") > 40, F.lit("abnormal")).when(F.col("value") < 5, F.lit("None")).alias("flag"),
    )
    return events


def stays(spark: SparkSession, d: str) -> DataFrame:
    first = F.min("ts")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("hadm_id")).agg(
        first.alias("admittime"), (first + F.make_dt_interval(days=F.lit(20))).alias("dischtime")
    )


EVENTS_SQL = """ev AS (SELECT user_id AS hadm_id, event_type AS itemid, ts AS storetime,
    CASE WHEN value >= 3 THEN value END AS valuenum, CASE WHEN event_id % 3 <> 0 THEN 'mg' END AS valueuom, event_type AS label,
    CASE WHEN value > 40 THEN 'abnormal' WHEN value < 5 THEN 'None' END AS flag FROM events),
  stay AS (SELECT user_id AS hadm_id, min(ts) AS admittime, min(ts) + INTERVAL 20 DAY AS dischtime FROM events GROUP BY 1),
  w AS (SELECT * FROM ev JOIN stay USING (hadm_id)
    WHERE storetime >= admittime AND storetime <= admittime + INTERVAL {h} HOUR AND storetime <= dischtime)"""

FIRST_SQL = """firsts AS (SELECT hadm_id, itemid, arg_min(valuenum, storetime) FILTER (WHERE valuenum IS NOT NULL) AS valuenum,
    arg_min(valueuom, storetime) FILTER (WHERE valueuom IS NOT NULL) AS valueuom, arg_min(label, storetime) AS label,
    arg_min(flag, storetime) FILTER (WHERE flag IS NOT NULL) AS flag FROM w GROUP BY ALL)"""


def _window(hours: int) -> str:
    return EVENTS_SQL.replace("{h}", str(hours))


@query("f02_j02_events_within_12h", f"WITH {_window(12)} SELECT hadm_id, itemid, count(*) AS n FROM w GROUP BY ALL")
def events_within(spark: SparkSession, d: str) -> DataFrame:
    timed = timed_events(spark, d).join(stays(spark, d), "hadm_id")
    return E.within_hours(timed, 12).groupBy("hadm_id", "itemid").agg(F.count("*").alias("n"))


@query("a01_first_per_item_120h", f"WITH {_window(120)}, {FIRST_SQL} SELECT hadm_id, itemid, valuenum, valueuom, flag FROM firsts")
def first_per_item(spark: SparkSession, d: str) -> DataFrame:
    timed = timed_events(spark, d).join(stays(spark, d), "hadm_id")
    return E.first_per_item(E.within_hours(timed, 120), ["hadm_id", "itemid"], ["valuenum", "valueuom", "flag"])


_LAB_TEXT = """concat_ws(' ', CAST(valuenum AS VARCHAR), valueuom, label, CASE WHEN flag <> 'None' THEN flag END)"""


@query(
    "a02_j03_add_lab_data",
    f"""WITH {_window(120)}, {FIRST_SQL}, t AS (SELECT hadm_id, string_agg({_LAB_TEXT}, ' | ' ORDER BY itemid) AS labs FROM firsts GROUP BY 1)
    SELECT c_custkey AS hadm_id, labs FROM customer LEFT JOIN t ON c_custkey = hadm_id""",
)
def add_lab_data(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("hadm_id"))
    return E.add_lab_data(notes, timed_events(spark, d), stays(spark, d), 120)


# --- sections and lines --------------------------------------------------------


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as notes with a complaint section and a diagnosis block."""
    head = F.when(F.col("lang") == "en", "Chief Complaint: ").when(F.col("lang") == "fr", "chief  ___ :\n").otherwise("History: ")
    return table(spark, d, "documents").select(
        "doc_id", "lang", "source",
        F.concat(head, F.col("text"), F.lit("\n\nDischarge Disposition:\nHome\nDischarge Diagnosis:\n"), F.col("text"),
                 F.lit("\n\nDischarge Condition:\nStable")).alias("note"),
    )


NOTES_SQL = """notes AS (SELECT doc_id, lang, source, text,
    CASE lang WHEN 'en' THEN 'Chief Complaint: ' WHEN 'fr' THEN 'chief  ___ :' || chr(10) ELSE 'History: ' END || text
      || chr(10) || chr(10) || 'Discharge Disposition:' || chr(10) || 'Home' || chr(10) || 'Discharge Diagnosis:' || chr(10) || text
      || chr(10) || chr(10) || 'Discharge Condition:' || chr(10) || 'Stable' AS note FROM documents)"""

# The text after the header, cut at the first blank line or header line.
SECTION_SQL = r"""sections AS (SELECT doc_id, lang, CASE WHEN lang IN ('en', 'fr') THEN
    nullif(regexp_split_to_array(substr(note, CASE lang WHEN 'en' THEN 17 ELSE 13 END), '\n\s*\.?\s*\n|\n[A-Za-z][A-Za-z ]+:')[1], '') END AS raw
    FROM notes),
  cc AS (SELECT doc_id, lang, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS cc_string FROM sections)"""


@query("c01_complaint_section", f"WITH {NOTES_SQL}, {SECTION_SQL} SELECT doc_id, length(cc_string) AS n, md5(cc_string) AS digest FROM cc")
def complaint_section(spark: SparkSession, d: str) -> DataFrame:
    section = X.chief_complaint(F.col("note"))
    return notes(spark, d).select("doc_id", section.alias("s")).select(
        "doc_id", F.length("s").cast("bigint").alias("n"), F.md5("s").alias("digest")
    )


RULES = X.LineRules(
    stop_lines=["SECONDARY:"], stop_prefixes=["OUTERWARD", "ZUR ", "PARA LA"], headings=["AS.", "ET.", "THE."],
    trim_prefixes=["THE", "AND", "OF", "IS", "LA", "DE", "UND", "EL"],
)

# The same passes as a recursive query: a document goes on while a pass changes it.
_PREFIX = "(?i)^(?:" + "|".join(sorted(RULES.trim_prefixes, key=lambda p: (-len(p), p))) + ")"
_STOPS = "(?i)^(?:" + "|".join(sorted(RULES.stop_prefixes, key=lambda p: (-len(p), p))) + ")"
_IS_STOP = f"upper(x) = 'SECONDARY:' OR regexp_matches(x, '{_STOPS}')"
_PASS_SQL = rf"""SELECT doc_id, i, lines, list_filter(list_transform(list_filter(k, lambda x: NOT regexp_matches(x, '^(=+|-+)$') AND upper(x) NOT IN ('AS.', 'ET.', 'THE.')),
      lambda x: CASE WHEN regexp_matches(x, '{_PREFIX}') THEN nullif(regexp_replace(x, '{_PREFIX}\s*', ''), '') ELSE x END), lambda x: x IS NOT NULL) AS done
  FROM (SELECT doc_id, i, lines, CASE WHEN len(list_filter(l, lambda x: {_IS_STOP})) > 0
      THEN l[1:list_position(list_transform(l, lambda x: {_IS_STOP}), true) - 1] ELSE l END AS k
    FROM (SELECT doc_id, i, lines, list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM fix))"""


@query(
    "c02_c03_primary_diagnosis",
    rf"""WITH RECURSIVE fix AS (
      SELECT doc_id, 0 AS i, string_split(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10)) AS lines FROM documents
      UNION ALL SELECT doc_id, i + 1, done FROM ({_PASS_SQL}) WHERE done <> lines),
    last AS (SELECT doc_id, arg_max(lines, i) AS lines FROM fix GROUP BY doc_id)
    SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id,
      nullif(regexp_replace(regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '^[.\-):+=]+', ''), ':+$', ''), '^\s+|\s+$', '', 'g'), '') AS s FROM last)""",
)
def primary_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    block = X.primary_diagnosis(F.col("note"), RULES)
    return notes(spark, d).select("doc_id", block.alias("s")).select(
        "doc_id", F.length("s").cast("bigint").alias("n"), F.md5("s").alias("digest")
    )


@query(
    "c34_text_from_marker",
    "SELECT page_id, md5(CASE WHEN instr(html, '<article') > 0 THEN substr(html, instr(html, '<article')) ELSE html END) AS digest FROM pages",
)
def text_from_marker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.text_from(F.col("html"), "<article")).alias("digest"))


# --- dictionaries ----------------------------------------------------------------

SYNONYMS = {
    "english": ["of the", "and the", "with"], "french": ["de la", "dans", "pour", "que"],
    "german": ["nicht", "und", "der"], "spanish": ["los", "por", "para la"],
}
SYSTEMS = {"english": "west", "french": "romance", "german": "west", "spanish": "romance"}


def _phrase_sql(column: str) -> str:
    ranked = sorted(
        ((p, k) for k, ps in SYNONYMS.items() for p in [*ps, k]), key=lambda pair: -len(pair[0])
    )
    hits = []
    for key in SYNONYMS:
        cases = " ".join(
            rf"WHEN regexp_matches({column}, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])" + p.replace(" ", r"\s+") + rf"([^\p{{L}}\p{{M}}\p{{N}}_]|$)') THEN {i}"
            for i, (p, k) in enumerate(ranked) if k == key
        )
        hits.append(f"{{'r': CASE {cases} END, 'k': '{key}'}}")
    return f"list_sort(list_filter([{', '.join(hits)}], lambda h: h.r IS NOT NULL))"


_SYSTEM_SQL = "CASE " + " ".join(f"WHEN k = '{k}' THEN '{s}'" for k, s in SYSTEMS.items()) + " END"


@query(
    "j05_j09_f06_complaint_matching",
    f"""WITH m AS (SELECT doc_id, list_transform({_phrase_sql('text')}, lambda h: h.k) AS ks FROM documents)
    SELECT doc_id, array_to_string(ks, ',') AS cc_list, array_to_string(list_transform(ks, lambda k: {_SYSTEM_SQL}), ',') AS system_list
    FROM m WHERE len(ks) > 0""",
)
def complaint_matching(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("cc_string"), F.lit("train").alias("split"))
    return M.add_complaints(docs, SYNONYMS, SYSTEMS).select(
        "doc_id", F.array_join("cc_list", ",").alias("cc_list"), F.array_join("system_list", ",").alias("system_list")
    )


# Patterns of a small disease dictionary per complaint; the first one wins.
PATTERNS = [("alpha", r"^E(0|1)\d"), ("beta", r"^[EM]\d[0-4]"), ("gamma", r"^R(0[1-9]|2\d)\d|Z79\d*$"), ("delta", r"^I\d*$"), ("omega", r"^.*7$")]
COMPLAINTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def diseases(spark: SparkSession) -> DataFrame:
    """The dictionary with one disease fewer per complaint, and a feature vector each."""
    rows = [
        (c, p, f"{name}", pattern, [1 if (i + p + f) % 3 == 0 else -1 if (i + p + f) % 3 == 1 else 0 for f in range(5 + i)])
        for i, c in enumerate(COMPLAINTS) for p, (name, pattern) in enumerate(PATTERNS[: 5 - i // 2])
    ]
    return spark.createDataFrame(rows, "chief_complaint string, pos int, disease string, icd10_regex string, features array<int>")


_DICT_SQL = "dict(complaint, pos, disease, pattern) AS (VALUES " + ", ".join(
    f"('{c}', {p}, '{name}', '^(?:{pattern})')" for i, c in enumerate(COMPLAINTS) for p, (name, pattern) in enumerate(PATTERNS[: 5 - i // 2])
) + ")"

CODE_MATCH_SQL = f"""{CODE_ROWS}, {LISTS}, {ADMISSIONS}, {_DICT_SQL},
  c AS (SELECT system, id, complaint, unnest(gold) AS code, unnest(range(len(gold))) AS code_pos FROM lists JOIN adm USING (id)),
  dc AS (SELECT complaint, code, arg_min(disease, pos) AS disease FROM (SELECT DISTINCT complaint, code FROM c) JOIN dict USING (complaint)
    WHERE regexp_matches(code, pattern) GROUP BY ALL),
  m AS (SELECT system, id, list(disease ORDER BY code_pos) AS ds, list(code_pos ORDER BY code_pos) AS rs FROM c JOIN dc USING (complaint, code) GROUP BY ALL)"""


def cohort_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = answer_lists(spark, d).join(admissions(spark, d), "id")
    return rows.withColumnRenamed("complaint", "chief_complaint").withColumnRenamed("gold", "ICD_CODES")


@query(
    "j04_code_pattern_match",
    f"""WITH {CODE_MATCH_SQL} SELECT l.system, l.id, coalesce(array_to_string(ds, ','), '') AS diseases, coalesce(array_to_string(rs, ','), '-1') AS ranks,
      coalesce(len(ds), 0) AS icd_codes_match_count, ds[1] AS disease_by_icd_match, coalesce(rs[1], -1)::INT AS disease_icd_rank
    FROM lists l JOIN adm USING (id) LEFT JOIN m USING (system, id)""",
)
def code_pattern_match(spark: SparkSession, d: str) -> DataFrame:
    matched = M.add_code_matches(cohort_rows(spark, d), diseases(spark), ["system", "id"])
    return matched.select(
        "system", "id", F.array_join("diseases_by_icd_match", ",").alias("diseases"),
        F.array_join(F.col("icd_codes_rank").cast("array<string>"), ",").alias("ranks"),
        F.col("icd_codes_match_count").cast("bigint").alias("icd_codes_match_count"),
        "disease_by_icd_match", "disease_icd_rank",
    )


@query(
    "j04_code_pattern_match_joined",
    f"""WITH {CODE_MATCH_SQL.replace("dict USING (complaint)\n    WHERE", "dict USING (complaint)\n    WHERE disease <> 'beta' AND")}
    SELECT l.system, l.id, coalesce(array_to_string(ds, ','), '') AS diseases, coalesce(rs[1], -1)::INT AS disease_icd_rank
    FROM lists l JOIN adm USING (id) LEFT JOIN m USING (system, id)""",
)
def code_pattern_match_joined(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary with missing patterns, and each pattern there twice: the place decides, nulls match nothing."""
    dictionary = diseases(spark).withColumn("icd10_regex", F.when(F.col("disease") != "beta", F.col("icd10_regex")))
    later = dictionary.withColumns({"pos": F.col("pos") + 100, "disease": F.lit("later")})
    matched = M.add_code_matches(cohort_rows(spark, d), dictionary.unionByName(later), ["system", "id"])
    return matched.select(
        "system", "id", F.array_join("diseases_by_icd_match", ",").alias("diseases"), "disease_icd_rank"
    )


@query(
    "j04_first_pattern_literal",
    f"WITH {CODE_ROWS} SELECT CASE " + " ".join(f"WHEN regexp_matches(code, '^(?:{p})') THEN '{n}'" for n, p in PATTERNS)
    + " END AS disease, count(*) AS n FROM code_rows GROUP BY 1",
)
def first_pattern_literal(spark: SparkSession, d: str) -> DataFrame:
    return code_rows(spark, d).groupBy(X.first_pattern(F.col("code"), PATTERNS).alias("disease")).agg(F.count("*").alias("n"))


# --- similarity ---------------------------------------------------------------------


def label_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean embedding of every label: the vocabulary to rank."""
    values = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = values.groupBy("label", "i").agg(F.avg("x").alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return means.groupBy("label").agg(vector.alias("embedding")).select(
        F.col("label").alias("pos"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), "embedding"
    )


SIM_SQL = """cen AS (SELECT label, list(x ORDER BY i) AS c FROM (
    SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
  sims AS (SELECT vec_id, e.label AS truth, cen.label AS pos, 'L' || cen.label AS name, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c) AS s FROM embeddings e, cen),
  ranked AS (SELECT vec_id, truth, list(name ORDER BY s DESC, pos) AS diseases, list(s ORDER BY s DESC, pos) AS scores FROM sims GROUP BY ALL)"""


def embedded_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.concat(F.lit("L"), F.col("label").cast("string")).alias("truth"), "embedding"
    )


def ranked_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return SI.rank_labels(embedded_items(spark, d), label_vectors(spark, d), ["vec_id"])


@query(
    "j06_w01_similarity_ranking",
    f"WITH {SIM_SQL} SELECT vec_id, array_to_string(diseases, ',') AS diseases, diseases[1] AS disease, round(scores[1], 5) AS best, round(list_sum(scores), 4) AS total FROM ranked",
)
def similarity_ranking(spark: SparkSession, d: str) -> DataFrame:
    scores = F.col("diseases_cossim_scores")
    return ranked_embeddings(spark, d).select(
        "vec_id", F.array_join("diseases", ",").alias("diseases"), "disease", F.round(F.get(scores, F.lit(0)), 5).alias("best"),
        F.round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


@query(
    "j06_similarity_ranking_joined",
    f"WITH {SIM_SQL} SELECT vec_id, array_to_string(diseases, ',') AS diseases, round(scores[1], 5) AS best FROM ranked",
)
def similarity_ranking_joined(spark: SparkSession, d: str) -> DataFrame:
    """Each label in a group of its own copy of the items: many groups, one plan."""
    groups = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("g")
    items = embedded_items(spark, d).select("*", groups).where("vec_id % 2 = g")
    labels = label_vectors(spark, d).select("*", groups)
    return SI.rank_labels(items, labels, ["vec_id", "g"], "g").select(
        "vec_id", F.array_join("diseases", ",").alias("diseases"),
        F.round(F.get("diseases_cossim_scores", F.lit(0)), 5).alias("best"),
    )


@query(
    "j06_best_and_wanted_label",
    f"WITH {SIM_SQL} SELECT vec_id, diseases[1] AS disease, round(scores[1], 5) AS best, list_position(diseases, 'L' || truth)::BIGINT AS position FROM ranked",
)
def best_and_wanted_label(spark: SparkSession, d: str) -> DataFrame:
    """The first label and the place of the true one, without the lists."""
    items, labels = embedded_items(spark, d), label_vectors(spark, d)
    best = SI.best_label(items, labels, ["vec_id"]).select("vec_id", "disease", F.round("best_score", 5).alias("best"))
    return best.join(SI.label_position(items, labels, ["vec_id"], "truth").select("vec_id", "position"), "vec_id")


@query(
    "j07_snap_names",
    f"""WITH {SIM_SQL}, names AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'L' || label ELSE 'v' || vec_id END AS name FROM embeddings)
    SELECT DISTINCT name, CASE WHEN name LIKE 'L%' THEN name ELSE diseases[1] END AS label FROM names JOIN ranked USING (vec_id)""",
)
def snap_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(
        F.lit("x").alias("chief_complaint"), "embedding",
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("L"), F.col("label").cast("string")))
        .otherwise(F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("name"),
    )
    labels = label_vectors(spark, d).withColumn("chief_complaint", F.lit("x"))
    free = rows.filter(F.col("name").startswith("v")).select("name", "embedding")
    return SI.snap_names(rows, labels, free).select("name", "label")


@query("j06_a16_ranked_mrr", f"""WITH {SIM_SQL} SELECT round(avg(1.0::DOUBLE / list_position(diseases, 'L' || truth)), 6) AS mrr,
  round(avg((list_position(diseases, 'L' || truth) <= 3)::INT), 6) AS recall_at_3 FROM ranked""")
def ranked_mrr(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranked_embeddings(spark, d)
    return ranked.agg(
        F.round(F.avg(S.reciprocal_rank(F.col("diseases"), F.col("truth"))), 6).alias("mrr"),
        F.round(F.avg(S.hit_at(F.col("diseases"), F.col("truth"), 3)), 6).alias("recall_at_3"),
    )


# --- composed ------------------------------------------------------------------------


@query(
    "d01_annotate_notes",
    f"""WITH {NOTES_SQL}, {SECTION_SQL}, {_window(120)}, {FIRST_SQL},
    t AS (SELECT hadm_id, string_agg({_LAB_TEXT}, ' | ' ORDER BY itemid) AS labs FROM firsts GROUP BY 1),
    m AS (SELECT doc_id, list_transform({_phrase_sql("coalesce(cc_string, '')")}, lambda h: h.k) AS ks FROM cc)
    SELECT array_to_string(ks, ',') AS cc_list, array_to_string(list_transform(ks, lambda k: {_SYSTEM_SQL}), ',') AS system_list, count(*) AS n, count(labs) AS n_labs, {text_sum_sql('cc_string')} AS sections
    FROM m JOIN cc USING (doc_id) LEFT JOIN t ON doc_id = hadm_id WHERE len(ks) > 0 GROUP BY 1, 2""",
)
def annotate_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = notes(spark, d).select(F.col("doc_id").alias("hadm_id"), F.col("note").alias("discharge_note"), F.lit("train").alias("split"))
    out = plan.annotate(rows, timed_events(spark, d), stays(spark, d), SYNONYMS, SYSTEMS, RULES, 120)
    return out.groupBy(F.array_join("cc_list", ",").alias("cc_list"), F.array_join("system_list", ",").alias("system_list")).agg(
        F.count("*").alias("n"), F.count("labs").alias("n_labs"), text_sum(F.col("cc_string")).alias("sections")
    )


def cohort_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answered admissions with their complaint and codes, the embeddings of some, and the label vectors per complaint."""
    lists = cohort_rows(spark, d).select(
        "system", F.col("id").alias("hadm_id"), "subject_id", "split", "ICD_CODES", F.lit(10).alias("ICD_version"),
        F.lit("hosp").alias("data_source"), F.array("chief_complaint").alias("cc_list"),
    )
    embeddings = table(spark, d, "embeddings").select(F.col("vec_id").alias("hadm_id"), "embedding")
    vectors = label_vectors(spark, d).select(F.col("pos").alias("v"), "embedding")
    labels = diseases(spark).select("chief_complaint", "pos", F.col("disease").alias("label"), F.col("pos").alias("v")).join(vectors, "v").drop("v")
    return lists, embeddings, labels


RANK_COHORT_SQL = f"""{CODE_MATCH_SQL}, cen AS (SELECT label, list(x ORDER BY i) AS c FROM (
    SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
  sim AS (SELECT e.vec_id AS id, cen.label AS pos, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), cen.c) AS s FROM embeddings e, cen),
  r AS (SELECT l.system, l.id, any_value(a.subject_id) AS subject_id, any_value(a.split) AS split, a.complaint, list(d.disease ORDER BY coalesce(sim.s, 0) DESC, d.pos) AS diseases
    FROM lists l JOIN adm a USING (id) JOIN dict d USING (complaint) JOIN cen ON cen.label = d.pos LEFT JOIN sim ON sim.id = l.id AND sim.pos = d.pos
    GROUP BY ALL),
  cohort AS (SELECT r.system, r.id, r.subject_id, r.split, r.complaint, r.diseases[1] AS disease, coalesce(m.rs[1], -1) AS a, coalesce(list_position(r.diseases, m.ds[1]), 0) - 1 AS b
    FROM r LEFT JOIN m ON m.id = r.id AND m.system = r.system),
  cats AS (SELECT *, CASE WHEN least(a, b) < 0 THEN -1 WHEN greatest(a, b) <= 2 THEN greatest(a, b) ELSE 3 END AS match_category FROM cohort)"""


def ranked_cohort(spark: SparkSession, d: str) -> DataFrame:
    lists, embeddings, labels = cohort_inputs(spark, d)
    return plan.rank_cohort(lists, embeddings, diseases(spark), labels, COMPLAINTS, keys=("system", "hadm_id"))


@query(
    "d02_j08_rank_cohort",
    f"""WITH {RANK_COHORT_SQL} SELECT system, id AS hadm_id, complaint AS chief_complaint, disease, match_category::INT AS match_category,
      CASE complaint {' '.join(f"WHEN '{c}' THEN {5 + i}" for i, c in enumerate(COMPLAINTS))} END AS n_features FROM cats""",
)
def rank_cohort(spark: SparkSession, d: str) -> DataFrame:
    return ranked_cohort(spark, d).select(
        "system", "hadm_id", "chief_complaint", "disease", "match_category", F.size("disease_vector").alias("n_features")
    )


@query(
    "d02_f03_f04_select_cohort",
    f"""WITH {RANK_COHORT_SQL} SELECT system, id AS hadm_id, complaint AS chief_complaint, match_category::INT AS match_category FROM cats
    WHERE match_category BETWEEN 0 AND 2 AND subject_id IN (SELECT subject_id FROM adm WHERE split <> 'dev')""",
)
def select_cohort(spark: SparkSession, d: str) -> DataFrame:
    saved = admissions(spark, d).filter("split <> 'dev'").select(F.col("complaint").alias("cc"), "subject_id")
    saved = saved.select("subject_id").distinct().withColumn("cc", F.explode(F.array(*[F.lit(c) for c in COMPLAINTS])))
    return plan.select_cohort(ranked_cohort(spark, d), saved).select("system", "hadm_id", "chief_complaint", "match_category")


@query(
    "f01_metadata_filter",
    f"WITH {CODE_ROWS}, {LISTS}, {ADMISSIONS} SELECT system, id AS hadm_id, len(gold) AS n_codes FROM lists JOIN adm USING (id) WHERE split = 'test' AND complaint = '2-HIGH'",
)
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    lists, _, _ = cohort_inputs(spark, d)
    kept = FL.by_metadata(lists, 10, "hosp", "test", "2-HIGH")
    return kept.select("system", "hadm_id", F.size("ICD_CODES").cast("bigint").alias("n_codes"))


@query(
    "c04_short_code_versions",
    f"""WITH {CODE_ROWS} SELECT CASE WHEN line % 2 = 0 AND lower(code[1]) = 'e' THEN substr(code, 1, 4) ELSE substr(code, 1, 3) END AS short, count(*) AS n
    FROM code_rows GROUP BY 1""",
)
def short_code_versions(spark: SparkSession, d: str) -> DataFrame:
    version = F.when(F.col("line") % 2 == 0, 9).otherwise(10)
    return code_rows(spark, d).groupBy(C.short_code("code", version).alias("short")).agg(F.count("*").alias("n"))
