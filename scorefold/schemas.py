"""Schemas of the tables the operators read and write, as DDL text."""

from __future__ import annotations

NOTES = (
    "subject_id bigint, hadm_id bigint, charttime timestamp, ICD_CODES array<string>, "
    "admission_note string, discharge_note string, ICD_version int, data_source string, split string"
)
ADMISSION_FILES = "subject_id bigint, hadm_id bigint, charttime timestamp, LONG_CODES array<string>, TEXT string"
DISCHARGE_FILES = "hadm_id bigint, text string"
ADMISSIONS = "hadm_id bigint, admittime timestamp, dischtime timestamp"
LABEVENTS = (
    "hadm_id bigint, itemid bigint, storetime timestamp, valuenum double, "
    "valueuom string, label string, flag string"
)
COMPLAINT_SYNONYMS = "chief_complaint string, synonyms string, systems string"
DISEASES = (
    "chief_complaint string, pos int, disease string, synonyms string, "
    "icd10_regex string, features array<int>"
)
SYMPTOM_SCHEME = (
    "chief_complaint string, pos int, feature string, min_value int, max_value int"
)
CANDIDATES = (
    "hadm_id bigint, chief_complaint string, model string, stage int, round int, "
    "choice_idx int, text string"
)
INSTRUCTIONS = (
    "hadm_id bigint, subject_id bigint, split string, chief_complaint string, model string, "
    "Verifier int, Score double, trace boolean, Input string, Thinking string, Output string"
)
DIRECT_INSTRUCTIONS = (
    "hadm_id bigint, subject_id bigint, split string, chief_complaint string, "
    "Verifier int, Input string, Output string"
)

INSTRUCTION_COLUMNS = [c.split()[0] for c in INSTRUCTIONS.split(", ")]

# Answer shapes, as DDL for from_json.
DIAGNOSIS_LIST = "array<struct<name:string,reason:string>>"
CODE_LIST = "array<struct<icd_code:string,reason:string>>"
FINDING_MAP = "map<string,struct<value:int,reasoning:string>>"

# The columns of the merged table, in output order.
COMBINED_COLUMNS = [
    "subject_id", "hadm_id", "ICD_CODES", "admission_note", "discharge_note", "split",
    "diagnose_string", "Chief Complaint", "diseases", "diseases_cossim_scores", "disease",
    "disease_vector", "match_category", "labs",
    "v1_score", "v1_json", "v1_text", "v1_preds",
    "v2_score", "v2_json", "v2_text", "v2_preds",
    "v3_score", "v3_json", "v3_text", "v3_preds",
    "v4_score", "v4_json", "v4_text", "v4_preds",
    "gen_model",
]

# The columns of the evaluation dataset, in output order.
TEST_COLUMNS = [
    "subject_id", "hadm_id", "split", "admission_note", "Chief Complaint",
    "disease", "disease_vector", "ICD_CODES", "labs",
]
