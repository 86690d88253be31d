import json
import re

import pytest
from pyspark.sql import functions as F

from scorefold.functions import codes as C, parsing as P, rendering as R, scoring as S, text as X


# --- codes --------------------------------------------------------------------


@pytest.mark.parametrize("code, version, short", [("E8001", 9, "E800"), ("E8001", 10, "E80"), ("K5660", 10, "K56"), ("e8001", 9, "e800")])
def test_short_code(value, code, version, short):
    assert value(C.short_code(F.lit(code), version)) == short


def test_clean_codes(value):
    raw = ["K56.6", "K86.0, K86.1", "C00-D04", "I82_31", "K 56.0", "k56.6", " ", None]
    assert value(C.full_codes("r"), "r array<string>", (raw,)) == ["K566", "K860", "K861", "I8231", "K560"]
    assert value(C.raw_entry_count("r"), "r array<string>", (raw,)) == 6
    assert value(C.invalid_entry_count("r"), "r array<string>", (raw,)) == 1


def test_ranked_and_distinct_codes(value):
    row = (["K56.6", "K5.70", "E8001", "E8002", ""],)
    assert value(C.ranked_categories("r"), "r array<string>", row) == ["K56", "K57", "E80"]
    assert value(C.distinct_codes("r"), "r array<string>", row) == ["K56.6", "K5.70", "E8001", "E8002"]


def test_chronic_list():
    assert len(C.CHRONIC) == len(set(C.CHRONIC))
    assert {"I05", "I13", "C00", "C96", "F19", "F20", "J47", "D69"} <= set(C.CHRONIC)
    assert not {"I14", "C97", "F21", "J48", "Z79"} & set(C.CHRONIC)


# --- scores ---------------------------------------------------------------------


@pytest.mark.parametrize("pred, label, row_score, batch_score", [
    ([1, 1, -1], [1, 0, -1], 1.0, 1.0), ([-1, 0, 1], [1, 0, -1], 0.0, 0.0), ([1, 0], [1, 0, -1], 0.0, 0.0),
    ([0, 0, 0], [0, 0, 0], 0.5, 0.0), ([0, 0, 0], [1, 0, 1], 0.5, 0.5), (None, [1], None, None),
])
def test_norm_dot(value, pred, label, row_score, batch_score):
    ddl = "p array<int>, l array<int>"
    assert value(S.norm_dot(F.col("p"), F.col("l")), ddl, (pred, label)) == row_score
    assert value(S.norm_dot(F.col("p"), F.col("l"), empty=0.0), ddl, (pred, label)) == batch_score


def test_cosine_zero_vector(value):
    ddl = "p array<int>, l array<int>"
    assert value(S.cosine(F.col("p"), F.col("l")), ddl, ([0, 0], [1, 0])) == 0.0
    assert value(S.cosine(F.col("p"), F.col("l")), ddl, ([1, 1], [1, 1])) == pytest.approx(1.0)


@pytest.mark.parametrize("truth, rr, hits", [("y", 0.5, (0, 1)), ("w", 0.0, (0, 0)), ("x", 1.0, (1, 1))])
def test_rank_scores(value, truth, rr, hits):
    ddl, row = "p array<string>, t string", (["x", "y", "z"], truth)
    assert value(S.reciprocal_rank(F.col("p"), F.col("t")), ddl, row) == rr
    assert tuple(value(S.hit_at(F.col("p"), F.col("t"), k), ddl, row) for k in (1, 3)) == hits


def test_average_precision(value):
    ddl = "p array<string>, g array<string>"
    assert value(S.average_precision(F.col("p"), F.col("g"), 20), ddl, (["a", "b", "c"], ["a", "c"])) == pytest.approx(0.8333, abs=1e-4)
    assert value(S.average_precision(F.col("p"), F.col("g"), 1), ddl, (["a", "b", "c"], ["a", "c"])) == 0.5
    assert value(S.average_precision(F.col("p"), F.col("g"), 20), ddl, (["a"], [])) is None


@pytest.mark.parametrize("a, b, category", [
    (0, 0, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1), (0, 2, 2), (2, 1, 2), (2, 2, 2), (3, 0, 3), (-1, 0, -1), (0, -1, -1), (7, 9, 3),
])
def test_match_category(value, a, b, category):
    assert value(S.match_category(F.lit(a), F.lit(b))) == category


def test_rank_bucket_and_mean(value):
    assert [value(S.rank_bucket(F.lit(r), 3)) for r in (-1, 0, 2, 3, 40)] == ["-1", "0", "2", "3+", "3+"]
    assert value(S.mean_of([F.lit(1), F.lit(None), F.lit(2)])) == 1.5
    assert value(S.mean_of([F.lit(None).cast("double")])) is None


# --- reading answers ----------------------------------------------------------------


@pytest.mark.parametrize("cell, expected", [
    ("['a', 'b']", ["a", "b"]), ('["a", "b"]', ["a", "b"]), ("['it''s']", None), ("None", []), (None, []), ("nan", []), ("", []),
    ("[oops", []), ("['a', None]", ["a", None]), ('["it\'s", \'x\']', ["it's", "x"]),
])
def test_parse_list(value, cell, expected):
    got = value(P.parse_list(F.col("c")), "c string", (cell,))
    if expected is not None:
        assert got == expected


def entries(n, key="icd_code", reason="r"):
    return [{key: f"A0{i}", "reason": reason} for i in range(n)]


def test_last_valid_list_wins(value):
    text = f"draft {json.dumps(entries(3))} final {entries(4)} broken [{{'icd_code': 'A'}}]"
    got = value(P.extract_codes(F.col("t")), "t string", (text,))
    assert [e["icd_code"] for e in got] == ["A00", "A01", "A02", "A03"]


@pytest.mark.parametrize("text, n", [
    (json.dumps(entries(2)), None), (json.dumps(entries(3)), 3), (json.dumps(entries(30)), 30), (json.dumps(entries(31)), None),
    (json.dumps(entries(3) + [{"icd_code": 5, "reason": "x"}]), None), ("no list here", None), (None, None),
])
def test_code_list_rules(value, text, n):
    got = value(P.extract_codes(F.col("t")), "t string", (text,))
    assert (len(got) if got is not None else None) == n


def test_diagnosis_list_sizes(value):
    for size, ok in ((2, False), (3, True), (10, True), (11, False)):
        got = value(P.extract_diagnoses(F.col("t")), "t string", (json.dumps(entries(size, "name")),))
        assert (got is not None) is ok


def test_findings(value):
    ddl = "t string, f array<string>"
    good = {"Fever": {"value": 1, "reasoning": "hot"}, "Cough": {"value": 0, "reasoning": "none"}}
    found = P.extract_findings(F.col("t"), F.col("f"))
    order = ["Cough", "Fever"]
    assert value(P.finding_vector(found, F.col("f")), ddl, (f"text {good} end", order)) == [0, 1]
    for broken in ({"Fever": good["Fever"]}, {**good, "Cough": {"value": 2, "reasoning": "x"}}, {**good, "Cough": {"value": 0}}):
        assert value(found, ddl, (json.dumps(broken), order)) is None


def test_shortened_reason(value):
    text = "word " * 300
    want = text[:1000].rsplit(" ", 1)[0] + "..."
    assert value(P.shortened(F.col("t")), "t string", (text,)) == want
    assert value(P.shortened(F.col("t")), "t string", ("short",)) == "short"


# --- text --------------------------------------------------------------------------


@pytest.mark.parametrize("note, section", [
    ("x\nChief Complaint: abdominal pain\n\nHistory", "abdominal pain"), ("CHIEF COMPLAINT:\n chest pain \nMajor Surgical: none", "chest pain"),
    ("___ Complaint: cough\n . \nmore", "cough"), ("Chief  ___ : back pain", "back pain"), ("nothing", None), ("Chief Complaint:", None), (None, None),
])
def test_complaint_section(value, note, section):
    assert value(X.chief_complaint(F.col("n")), "n string", (note,)) == section


RULES = X.LineRules(
    stop_lines=["secondary:"], stop_prefixes=["chronic"], headings=["primary"], trim_prefixes=["primary diagnosis:", "1.", "final:"],
)


def brute_clean(block):
    """Straight reading of the rules, repeated until stable."""
    trims = sorted((p.upper() for p in RULES.trim_prefixes), key=len, reverse=True)

    def once(lines):
        out = []
        for line in (x.strip() for x in lines):
            up = line.upper()
            if up in {"SECONDARY:"} or up.startswith("CHRONIC"):
                break
            if re.fullmatch(r"=+|-+", line) or up in {"PRIMARY"}:
                continue
            hit = next((p for p in trims if up.startswith(p)), None)
            if hit is None:
                out.append(line)
            elif line[len(hit):].lstrip():
                out.append(line[len(hit):].lstrip())
        return out

    lines = block.splitlines()
    while (new := once(lines)) != lines:
        lines = new
    return "\n".join(lines).lstrip(".-):+=").rstrip(":").strip() or None


@pytest.mark.parametrize("block", [
    "Primary Diagnosis: Appendicitis", "====\nPRIMARY\n1. final: 1. pancreatitis\nSecondary:\nHTN", "final: primary\nflu:", "1. 1. 1. 1. 1. deep\nfinal: chronic pain\nlost",
    "chronic only", "- -\n---\n  two\n\nlines ", "1.", "final: final: secondary:\nrest",
])
def test_diagnosis_block_against_brute_force(value, block):
    note = f"Discharge Disposition:\nHome\nDischarge Diagnosis:\n{block}\n\nDischarge Condition:\nok"
    assert value(X.primary_diagnosis(F.col("n"), RULES), "n string", (note,)) == brute_clean(block.strip())


def test_diagnosis_after_last_disposition(value):
    note = "Discharge Diagnosis: old\nFacility:\nDischarge Diagnosis: new\nCONDITION: ok"
    assert value(X.primary_diagnosis(F.col("n"), RULES), "n string", (note,)) == "new"
    assert value(X.primary_diagnosis(F.col("n"), RULES), "n string", ("no block",)) is None


def test_matching_keys(value):
    phrases = {"chest pain": ["chest", "pain in chest"], "Dyspnea": ["shortness of breath", "sob"], "cough": []}
    keys = lambda t: value(X.matching_keys(F.col("t"), phrases), "t string", (t,))
    assert keys("Shortness  of\nBREATH and chest tightness") == ["dyspnea", "chest pain"]
    assert keys("chesty sobbing coughs") == []
    assert keys("cough, pain in chest") == ["chest pain", "cough"]
    assert keys("écoughé") == []


def test_first_pattern_is_anchored(value):
    patterns = [("a", r"^I208\d*|I209\d*$"), ("b", r"I2")]
    assert [value(X.first_pattern(F.lit(c), patterns)) for c in ("I2089", "I2091", "I210", "XI209", "Z")] == ["a", "a", "b", None, None]


def test_reasoning(value):
    assert value(X.reasoning(F.lit("<think>\nplan\n</think>\nanswer"))) == "plan"
    assert value(X.reasoning(F.lit("plan ```json"))) == "plan "
    assert value(X.reasoning(F.lit(None).cast("string"))) == ""


# --- rendering ------------------------------------------------------------------------


def test_json_matches_python(value):
    items = [{"icd_code": 'K"5', "reason": 'a\\b "],"x":"y" é\n'}, {"icd_code": "A", "reason": '","reason":"'}]
    got = value(R.json_entries(F.col("e"), "icd_code"), "e array<struct<icd_code:string,reason:string>>", ([tuple(i.values()) for i in items],))
    assert got == json.dumps(items, ensure_ascii=False)


def test_findings_target_matches_python(value):
    got = value(R.findings_target(F.col("f"), F.col("v")), "f array<string>, v array<int>", (["Fever", "Cough"], [1, -1]))
    want = {n: {"value": v, "reasoning": f"Extracted {n} from the admission note."} for n, v in (("Fever", 1), ("Cough", -1))}
    assert got == json.dumps(want, indent=4)
    assert value(R.findings_target(F.col("f"), F.col("v")), "f array<string>, v array<int>", (["Fever"], [1, 0])) is None


def test_align_codes(value):
    ddl = "e array<struct<icd_code:string,reason:string>>, g array<string>"
    got = value(R.align_codes(F.col("e"), F.col("g")), ddl, ([("K56.6", "a"), ("A00", "b")], ["K5660", "B20", "B201"]))
    assert [tuple(x) for x in got] == [
        ("K56.6", "a"), ("B20", "Based on the admission note code B20 is suspected."), ("B201", "Based on the admission note code B201 is suspected."),
    ]


def test_target_first(value):
    ddl = "e array<struct<name:string,reason:string>>, t string"
    rows = [("a", "1"), ("b", "2"), ("b", "3")]
    names = lambda t: [x["reason"] for x in value(R.target_first(F.col("e"), F.col("t")), ddl, (rows, t))]
    assert names("b") == ["2", "1", "3"]
    assert names("z") == ["Based on the admission note z is suspected.", "1", "2", "3"]


def test_template_is_filled_once(value):
    template = F.lit("{{x}} {a} {b} {missing}|{a}")
    got = value(R.fill_template(template, {"a": F.lit("{b}"), "b": F.lit("2")}))
    assert got == "{x} {b} 2 |{b}"
    assert value(R.fill_template(template, {"a": F.lit("1"), "b": F.lit("2")}, 5)) == "{x} 1"
    with pytest.raises(Exception, match="unknown slot: missing"):
        value(R.fill_template(template, {"a": F.lit("1"), "b": F.lit("2")}, strict=True))
    known = {"a": F.lit("1"), "b": F.lit(None), "missing": F.lit("m")}
    assert value(R.fill_template(template, known, strict=True)) == "{x} 1  m|1"


def test_ranked_names_text(value):
    ddl = "e array<struct<name:string,reason:string>>, l string"
    rows = [(f"d{i}", "r") for i in range(8)]
    lines = lambda label: value(R.ranked_names_text(F.col("e"), F.col("l"), F.lit("none")), ddl, (rows, label)).count("\n")
    assert (lines("d6"), lines("d1"), lines("zz")) == (7, 8, 8)
    assert value(R.ranked_names_text(F.col("e"), F.col("l"), F.lit("none")), ddl, (None, "d1")) == "none"


def test_chat_text(value):
    def text(thinking):
        return value(R.chat_text(F.lit("s"), F.lit("u"), thinking, F.lit("o")))

    assert text(F.lit(None).cast("string")).endswith("<|im_start|>assistant\no<|im_end|>\n")
    assert "<think>\n\n</think>\n\no" in text(F.lit(""))
    assert "<think>\nplan\n</think>\n\no" in text(F.lit("\nplan\n"))


def test_quoted_words_stay(spark, value):
    assert value(P.parse_list(F.lit('["Allergies: None, stable", "b"]'))) == ["Allergies: None, stable", "b"]
    assert value(P.parse_list(F.lit("['on O2: True, weaned', None]"))) == ["on O2: True, weaned", None]
    assert value(P.parse_list(F.lit("['a\\xa0b', 'c']"))) == ["a\xa0b", "c"]
    assert value(P.parse_list(F.lit("['a\\\\xa0b']"))) == ["a\\xa0b"]


def test_types_are_checked_outside_reasons(value):
    entries = ', '.join('{"name": "%s", "reason": "the word \'name\': 5 or None, True]"}' % n for n in "ABC")
    assert [r["name"] for r in value(P.extract_diagnoses(F.lit(f"so: [{entries}]")))] == ["A", "B", "C"]
    assert value(P.extract_diagnoses(F.lit("[" + entries.replace('"A"', "5") + "]"))) is None


def test_last_of_repeated_keys(value):
    text = """{"f": {"value": 1, "reasoning": "a"}, "f": {"value": 0, "reasoning": "None, b"}}"""
    features = F.array(F.lit("f"))
    assert value(P.finding_vector(P.extract_findings(F.lit(text), features), features)) == [0]
