import datetime as dt
import functools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefold.functions import text as X
from scorefold.functions.patterns import literal_prefixes
from scorefold.operators import (
    assignment as A, events as E, filters as FL, frequency as FR, matching as M, names as N, quality as Q, rank_metrics as RM,
    reports as RP, selection as SE, set_metrics as SM, similarity as SI,
)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- set metrics -----------------------------------------------------------------


@pytest.fixture()
def two_rows(spark):
    data = [("s", ["A01", "B02"], ["A01", "C03"]), ("s", ["A01"], [])]
    return spark.createDataFrame(data, "system string, gold array<string>, pred array<string>")


def test_micro_macro_fixture(two_rows):
    pairs = SM.pairs_from_lists(two_rows, ["system"], F.col("gold"), F.col("pred"))
    counts = SM.code_counts(pairs, ["system"])
    got = SM.micro_macro(counts, ["system"]).collect()[0]
    assert (got["tp"], got["fp"], got["fn"], got["n_labels"]) == (1, 1, 2, 3)
    assert got["f1_micro"] == pytest.approx(0.4)
    assert got["f1_macro"] == pytest.approx(0.2222, abs=1e-4)
    over_gold = SM.macro_over(counts, ["system"], SM.vocabulary_of(pairs)).collect()[0]
    assert over_gold["f1"] == pytest.approx(33.3333, abs=1e-3)


def test_empty_input_has_no_scores(spark):
    empty = spark.createDataFrame([], "system string, code string, is_gold boolean, is_pred boolean")
    assert SM.micro_macro(SM.code_counts(empty, ["system"]), ["system"]).count() == 0


def test_strata(spark):
    frequency = spark.createDataFrame([("a", 100), ("b", 10), ("c", 9)], "code string, n_train long")
    data = [("s", c, 1, 0, 0) for c in "abc"] + [("s", "new", 0, 0, 1), ("s", "pred_only", 0, 5, 0)]
    counts = spark.createDataFrame(data, "system string, code string, tp long, fp long, fn long")
    got = {r["stratum"]: (r["f1"], r["recall"], r["n_labels"]) for r in SM.strata_scores(counts, frequency, ["system"]).collect()}
    assert got == {"head": (100.0, 100.0, 1), "body": (100.0, 100.0, 1), "tail": (50.0, 50.0, 2)}
    assert rows(SM.stratum_composition(frequency), "stratum", "n_codes") == [("body", 1), ("head", 1), ("tail", 1)]


def test_total_counts_equal_scoring_everything(two_rows):
    pairs = SM.pairs_from_lists(two_rows.withColumn("cc", F.col("gold")[0]), ["cc"], F.col("gold"), F.col("pred"))
    counts = SM.with_total(SM.code_counts(pairs, ["cc"]), "cc")
    assert rows(counts.filter("cc = 'All'"), "code", "tp", "fp", "fn") == [("A01", 1, 0, 1), ("B02", 0, 0, 1), ("C03", 0, 1, 0)]


def test_error_rates_fixture(spark):
    data = [("s", ["I10", "Z79", "Z85"], ["I10", "I10x", "R05"]), ("s", [], ["A00"])]
    got = SM.error_rates(spark.createDataFrame(data, "system string, g array<string>, p array<string>"), ["system"], "g", "p").collect()[0]
    assert got["recall"] == pytest.approx(1 / 3) and got["precision"] == pytest.approx(1 / 3)
    assert (got["missed_primary"], got["missed_history"], got["missed_medication"], got["missed_chronic"]) == (0.0, 0.5, 0.5, 0.0)
    assert (got["duplicate_subcodes"], got["symptom_fp"], got["hallucinated_fp"], got["extra_codes"]) == (0.5, 0.5, 1.0, 0.5)
    assert got["recall_primary_at_1"] == 0.5 and got["recall_primary"] == 1.0


def test_vector_agreement_keeps_group_rounding(spark):
    data = [("s", [1, 1, 0], [1, 1, 1]), ("s", [1, 1, 1], [1, 1, 1]), ("s", None, [1])]
    df = spark.createDataFrame(data, "c string, p array<int>, l array<int>")
    got = RM.vector_agreement(df, ["c"], F.col("p"), F.col("l")).collect()[0]
    assert got["dot_product"] == pytest.approx((round((5 / 6 + 1) / 2, 4) * 2 + 0.5) / 3)


def test_cumulative_share_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [(f"{chr(65 + int(i) % 5)}{i:03d}", int(n)) for i, n in enumerate(rng.integers(1, 6, 200))]
    got = FR.cumulative_share(spark.createDataFrame(data, "code string, n long")).collect()
    ordered = sorted(data, key=lambda r: (-r[1], r[0]))
    running = np.cumsum([n for _, n in ordered]) / sum(n for _, n in data)
    want = {c: (i + 1, running[i]) for i, (c, _) in enumerate(ordered)}
    assert {r["code"]: r["rank"] for r in got} == {c: w[0] for c, w in want.items()}
    assert all(r["cum_share"] == pytest.approx(want[r["code"]][1]) for r in got)


def test_cutoff_rank(spark):
    shares = FR.cumulative_share(spark.createDataFrame([("a", 50), ("b", 30), ("c", 15), ("d", 5)], "code string, n long"))
    assert FR.cutoff_rank(shares, 0.8).collect()[0]["cutoff_rank"] == 2


# --- events ---------------------------------------------------------------------------

ADMIT = dt.datetime(2024, 1, 1)


def lab(minutes, micro=0, item=1, value=None, unit=None, label=None, flag=None):
    return (1, item, ADMIT + dt.timedelta(minutes=minutes, microseconds=micro), value, unit, label, flag)


LAB = "hadm_id long, itemid long, storetime timestamp, valuenum double, valueuom string, label string, flag string"


def test_time_window_bounds(spark):
    stay = spark.createDataFrame([(1, ADMIT, ADMIT + dt.timedelta(days=3))], "hadm_id long, admittime timestamp, dischtime timestamp")
    data = [lab(0, item=1), lab(720, item=2), lab(720, 1, item=3), lab(-1 / 60, item=4)]
    timed = spark.createDataFrame(data, LAB).join(stay, "hadm_id")
    assert rows(E.within_hours(timed, 12), "itemid") == [(1,), (2,)]
    early = stay.withColumn("dischtime", F.lit(ADMIT + dt.timedelta(minutes=5)))
    timed = spark.createDataFrame(data, LAB).join(early, "hadm_id")
    assert rows(E.within_hours(timed, 12), "itemid") == [(1,)]


def test_first_value_is_per_column(spark):
    df = spark.createDataFrame([lab(1, value=None, unit="u"), lab(2, value=5.0, unit="v")], LAB)
    got = E.first_per_item(df, ["hadm_id", "itemid"], ["valuenum", "valueuom", "flag"])
    assert rows(got, "valuenum", "valueuom", "flag") == [(5.0, "u", None)]


def test_lab_text(spark):
    df = spark.createDataFrame([lab(1, item=1, value=5.0, unit="mg", label="Na"), lab(1, item=2, label="K", flag="abnormal"), lab(1, item=3, unit="None", label="nan")], LAB)
    stay = spark.createDataFrame([(1, ADMIT, ADMIT + dt.timedelta(days=3))], "hadm_id long, admittime timestamp, dischtime timestamp")
    assert E.lab_summaries(df, stay, 12).collect()[0]["labs"] == "5.0 mg Na | K abnormal | "


# --- selection -----------------------------------------------------------------------


def candidates(spark, scores, stage=1):
    data = [(7, stage, r, c, s) for r, choices in enumerate(scores, 1) for c, s in enumerate(choices)]
    return spark.createDataFrame(data, "hadm_id long, stage int, round int, choice_idx int, score double")


@pytest.mark.parametrize("scores, eval_mode, index", [
    ([None, 0.4, 0.4], False, 1), ([None, 0.4, 0.4], True, 1), ([None, None], False, 0), ([None, None], True, 0), ([0.1, 0.9], False, 1), ([0.1, 0.9], True, 0),
])
def test_best_choice(spark, scores, eval_mode, index):
    best = SE.best_choice(candidates(spark, [scores]), ["hadm_id", "round"], eval_mode)
    assert rows(best, "choice_idx") == [(index,)]


@pytest.mark.parametrize("scores, kept", [([0.5, 0.6, 0.6], 2), ([None, 0.2, None], 2), ([None, None, None], 3), ([0.5, 0.4], 1)])
def test_best_round(spark, scores, kept):
    assert rows(SE.best_round(candidates(spark, [[s] for s in scores]), ["hadm_id"]), "round") == [(kept,)]


@pytest.mark.parametrize("scores, options, want", [
    ([0.5, 0.6, 0.7, 0.9], {}, (3, 3, True)), ([0.5, 0.6, 0.7], {"strict": False}, (2, 2, True)), ([0.5, 0.4], {}, (1, 2, False)),
    ([None, 0.7], {}, (2, 2, True)), ([None, 0.7], {"compat": True}, (1, 1, False)), ([0.1, None, 0.7], {"compat": True}, (3, 3, True)),
    ([0.1, 0.2, 0.3, 0.4, 0.9], {}, (4, 4, False)), ([0.7, 0.9], {"floor": 0.8}, (2, 2, True)),
])
def test_accept(spark, scores, options, want):
    options = {k: F.lit(v) if k == "floor" else v for k, v in options.items()}
    got = SE.accept(candidates(spark, [[s] for s in scores]), ["hadm_id"], F.lit(0.6), **options)
    assert rows(got, "round", "rounds_used", "accepted") == [want]


def test_stage_three_must_reach_stage_two(spark):
    second = candidates(spark, [[0.9]], 2)
    third = candidates(spark, [[0.85], [0.95]], 3)
    got = SE.accept_stages(second.unionByName(third), ["hadm_id"])
    assert rows(got, "stage", "round", "accepted") == [(2, 1, True), (3, 2, True)]
    skipped = SE.accept_stages(second.unionByName(third), ["hadm_id"], eval_mode=True)
    assert rows(skipped, "stage") == [(2,)]


def test_stage_chain_reads_its_rows_once(spark, tmp_path):
    second, third = candidates(spark, [[0.9], [0.4]], 2), candidates(spark, [[0.85], [0.95], [0.99]], 3)
    second.unionByName(third).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    for mode in (False, True):
        plan = SE.accept_stages(stored, ["hadm_id"], eval_mode=mode)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "Join" not in plan


def test_evaluation_mode_counts_the_first_valid_round(spark):
    parts = [candidates(spark, [[None], [0.1], [0.9]], 1), candidates(spark, [[0.2]], 2), candidates(spark, [[0.9]], 3), candidates(spark, [[None], [None]], 4)]
    got = SE.accept_stages(functools.reduce(lambda a, b: a.unionByName(b), parts), ["hadm_id"], eval_mode=True)
    assert rows(got, "stage", "round", "rounds_used", "accepted") == [(1, 2, 2, True), (2, 1, 1, True), (4, 2, 2, False)]


def test_running_shares_are_balanced(spark):
    """Codes that all occur once are dealt out in ranges of like size; no window goes over the whole table."""
    counts = spark.range(20_000).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("code"), F.lit(1).alias("n"))
    shares = FR.cumulative_share(counts)
    plan = shares._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "Window [" in line)
    got = shares.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r["code"], r["rank"]) for r in got) == [(f"c{k:06}", k + 1) for k in range(20_000)]
    assert max(r["cum_share"] for r in got) == 1.0
    mixed = spark.createDataFrame([("b", 3), ("a", 3), ("c", 5), ("d", 1)], "code string, n long")
    assert rows(FR.cumulative_share(mixed), "rank", "code", "cum_share") == [(1, "c", 5 / 12), (2, "a", 8 / 12), (3, "b", 11 / 12), (4, "d", 1.0)]
    assert FR.cumulative_share(mixed.limit(0)).count() == 0


def test_phrase_index_agrees_with_patterns(spark):
    """The indexed join finds what one pattern per phrase finds, folded letters and words without letters included."""
    phrases = {
        "Chest Pain": ["pain in chest", "s/p fall", "CP"], "cough": ["tussis", "Kaltes İstanbul"], "odd": ["++", "-x"], "σας": ["μας"], "ß": ["straße"],
    }
    systems = {k: f"s{i}" for i, k in enumerate(phrases)}
    texts = [
        None, "", "chest  PAIN", "chestpain", "chest, pain", "Pain\nin\tchest and cough", "s/p fall; s/p  fall", "a ++ b", "a+++b", "1 -x", "y-x",
        "ΣΑΣ", "σας.", "ΜΑΣ μας", "STRASSE straße", "KALTES istanbul", "kaltes İSTANBUL", "tuſſis", "cp", "_cp", "cp\u0301", "coughs cough-", "cough" * 2000,
    ]
    df = spark.createDataFrame([(i, t, "train") for i, t in enumerate(texts)] + [(99, "cough", "dev")] * 2, "id int, cc_string string, split string")
    want = df.select("id", X.matching_keys(F.coalesce("cc_string", F.lit("")), phrases).alias("k")).collect()
    got = M.add_complaints(df, phrases, systems).select("id", "cc_list", "system_list").collect()
    lowered = {k.lower(): s for k, s in systems.items()}
    assert sorted((r["id"], r["k"]) for r in want if r["k"]) == sorted((r["id"], r["cc_list"]) for r in got)
    assert all(r["system_list"] == [lowered[k] for k in r["cc_list"]] for r in got)


def test_phrase_plan_has_constant_size(spark):
    df = spark.createDataFrame([("a phrase 77 here", "train")], "cc_string string, split string")
    many = {f"phrase {k}": [f"other words {k}"] for k in range(50_000)}
    few = {f"phrase {k}": [f"other words {k}"] for k in range(70, 80)}
    sizes = []
    for phrases in (few, many):
        out = M.add_complaints(df, phrases, {k: "s" for k in phrases})
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
        assert [r["cc_list"] for r in out.collect()] == [["phrase 77"]]
    assert sizes[1] < 1.1 * sizes[0]


@pytest.mark.parametrize("pattern", [
    "E(0|1)\\d", "[EM]\\d[0-4]", "R(0[1-9]|2\\d)\\d|Z79\\d*$", ".*7$", "A?B", "AB*C", "(AB)?C", "A{2}", "[^A]B", "(?i)a", "A\\.5", "()", "A|", "K56.?6",
    "[A-C-]x", "\\QA(\\E", "^I1[05]", "(A|B(1|2))+C", "A+B", "[0-9]+A", "\\w1", "x{0}A", "[[A]B]1", "(A", "A)B", "",
])
def test_matches_begin_with_a_literal_prefix(pattern):
    import itertools
    import re

    found = literal_prefixes(pattern)
    assert found
    try:
        compiled = re.compile(pattern.replace("\\QA(\\E", "A\\("))
    except re.error:
        return
    for size in range(5):
        for letters in itertools.product("AB1C05x7", repeat=size):
            text = "".join(letters)
            if compiled.match(text):
                assert any(text.startswith(p) for p in found), text


def test_nan_becomes_null(spark):
    assert spark.range(1).select(SE.no_nan(F.lit(float("nan"))).alias("s")).collect()[0]["s"] is None


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = SE.keep_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert rows(SE.keep_first(df, ["k"], ["id"]), "k", "id") == [(0, 0), (1, 1), (2, 2)]


# --- assignment ------------------------------------------------------------------------


def test_assignment_fixture(spark):
    data = [(1, 1, "cc1", m) for m in "ab"] + [(1, 1, "cc2", m) for m in "ab"] + [(1, 1, "cc3", "a"), (2, 2, "cc3", "b")]
    data += [(i, i, "cc1", m) for i in range(10, 19) for m in "ab"] + [(i, i, "cc2", m) for i in range(20, 23) for m in "ab"]
    index = spark.createDataFrame(data, "subject_id long, hadm_id long, cc string, model string")
    got = dict(rows(A.assign(index), "hadm_id", "cc"))
    assert got[1] == "cc2" and 2 not in got and got[10] == "cc1" and len(got) == 13


# --- matching and similarity -----------------------------------------------------------

DISEASES = "chief_complaint string, pos int, disease string, icd10_regex string, features array<int>"


def test_code_matches(spark):
    dictionary = spark.createDataFrame([("c", 0, "a", r"^I208\d*|I209\d*$", [1]), ("c", 1, "b", "I2", [0]), ("d", 0, "x", "Z", [0])], DISEASES)
    data = [(1, "c", ["Z1", "I2091", "I21"]), (2, "c", ["Z1"]), (3, "d", ["Z1", "I21"]), (4, "e", ["Z1"]), (5, "c", [])]
    df = spark.createDataFrame(data, "hadm_id long, chief_complaint string, ICD_CODES array<string>")
    got = {r["hadm_id"]: (r["diseases_by_icd_match"], r["icd_codes_rank"], r["icd_codes_match_count"], r["disease_by_icd_match"], r["disease_icd_rank"])
           for r in M.add_code_matches(df, dictionary, ["hadm_id"]).collect()}
    none = ([None], [-1], 0, None, -1)
    assert got == {1: (["a", "b"], [1, 2], 2, "a", 1), 2: none, 3: (["x"], [0], 1, "x", 0), 4: none, 5: none}
    with pytest.raises(Exception, match="not identified"):
        M.add_code_matches(df.union(df.where("hadm_id = 1")), dictionary, ["hadm_id"]).collect()
    bare = spark.createDataFrame([("c", 0, "a", None, [1])], DISEASES)
    text_none = spark.createDataFrame([(1, "c", ["None5"])], df.schema)
    assert M.add_code_matches(text_none, bare, ["hadm_id"]).first()["icd_codes_match_count"] == 0


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    choices = spark.createDataFrame([(1, 1, 0, nan), (1, 1, 1, 0.9)], "id int, round int, choice_idx int, score double")
    assert SE.best_choice(choices, ["id"]).first()["score"] == 0.9
    rounds = spark.createDataFrame([(1, 1, nan), (1, 2, 0.7), (2, 1, nan)], "id int, round int, score double")
    got = {r["id"]: (r["score"], r["accepted"], r["rounds_used"]) for r in SE.accept(rounds, ["id"], F.lit(0.5)).collect()}
    assert got == {1: (0.7, True, 2), 2: (None, False, 1)}
    assert {r["id"]: r["score"] for r in SE.best_round(rounds, ["id"]).collect()} == {1: 0.7, 2: None}
    means = {r["id"]: (r["mean_score"], r["mean_valid_score"]) for r in SE.round_means(rounds, ["id"]).collect()}
    assert means == {1: (0.35, 0.7), 2: (0.0, None)}


def test_similarity_keeps_rows_without_labels_or_vectors(spark):
    items = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", None), (3, "none", [1.0, 0.0]), (4, None, [1.0, 0.0])], "id long, cc string, embedding array<double>")
    labels = spark.createDataFrame([("g", 0, "a", [0.0, 1.0]), ("g", 1, "b", [1.0, 0.0]), ("g", 2, "c", None)], "cc string, pos int, label string, embedding array<double>")
    got = {r["id"]: (r["diseases"], r["diseases_cossim_scores"]) for r in SI.rank_labels(items, labels, ["id"], "cc").collect()}
    assert got == {1: (["b", "a", "c"], [1.0, 0.0, 0.0]), 2: (["a", "b", "c"], [0.0, 0.0, 0.0]), 3: (None, None), 4: (None, None)}


def test_similarity_against_numpy(spark):
    rng = np.random.default_rng(1)
    items = [(i, "g" if i % 3 else "h", rng.normal(size=8).tolist()) for i in range(60)]
    labels = [(g, p, f"{g}{p}", rng.normal(size=8).tolist()) for g in "gh" for p in range(7)]
    got = SI.rank_labels(
        spark.createDataFrame(items, "id long, cc string, embedding array<double>"),
        spark.createDataFrame(labels, "cc string, pos int, label string, embedding array<double>"), ["id"], "cc",
    ).collect()
    assert len(got) == 60
    for r in got:
        vec = np.array(items[r["id"]][2])
        sims = {name: vec @ np.array(v) / np.linalg.norm(vec) / np.linalg.norm(v) for g, _, name, v in labels if g == r["cc"]}
        want = sorted(sims, key=lambda n: -sims[n])
        assert r["diseases"] == want and r["disease"] == want[0]
        assert r["diseases_cossim_scores"] == pytest.approx([sims[n] for n in want])


def test_many_blocks_give_one_ranking(spark, monkeypatch):
    """Groups of several blocks and copies: lists, best label and wanted place against numpy; ties by place, then name."""
    monkeypatch.setattr(SI, "BLOCK", 7)
    monkeypatch.setattr(SI, "SPREAD", 2)
    rng = np.random.default_rng(6)
    grid = [v.tolist() for v in rng.integers(-1, 2, (30, 4)).astype(float)]  # many equal similarities
    items = [(i, "hot" if i % 5 else "cold", grid[i % 30], f"n{i % 41}") for i in range(160)]
    labels = [(g, p // 2, f"n{p}", grid[(p * 7) % 30]) for g in ("hot", "cold") for p in range(40)]
    df = spark.createDataFrame(items, "id long, cc string, embedding array<double>, truth string")
    names = spark.createDataFrame(labels, "cc string, pos int, label string, embedding array<double>")
    lists = {r["id"]: (r["diseases"], r["diseases_cossim_scores"]) for r in SI.rank_labels(df, names, ["id"], "cc").collect()}
    best = {r["id"]: (r["disease"], r["best_score"]) for r in SI.best_label(df, names, ["id"], "cc").collect()}
    place = {r["id"]: r["position"] for r in SI.label_position(df, names, ["id"], "truth", "cc").collect()}
    for i, _, vec, truth in items:
        found, scores = lists[i]
        assert sorted(found) == sorted(f"n{p}" for p in range(40)) and scores == sorted(scores, reverse=True)
        norm = np.linalg.norm
        for name, score in zip(found, scores):
            other = grid[(int(name[1:]) * 7) % 30]
            assert score == pytest.approx(np.dot(vec, other) / max(norm(vec) * norm(other), 1e-12), abs=1e-12)
        for (a, x), (b, y) in zip(zip(found, scores), zip(found[1:], scores[1:])):
            assert x > y or (int(a[1:]) // 2, a) < (int(b[1:]) // 2, b)
        assert best[i] == (found[0], scores[0])
        if truth == "n40":
            assert place[i] is None
        else:
            assert abs(scores[place[i] - 1] - scores[found.index(truth)]) < 1e-15
    with pytest.raises(Exception, match="not identified"):
        SI.rank_labels(df.union(df.where("id = 1")), names, ["id"], "cc").collect()


def test_dictionaries_must_agree(spark):
    df = spark.createDataFrame([("cough", "train")], "cc_string string, split string")
    with pytest.raises(ValueError):
        M.add_complaints(df, {"cough": []}, {"fever": "x"})
    with pytest.raises(ValueError):
        M.add_complaints(df.drop("split"), {"cough": []}, {"cough": "x"})


# --- names and reports --------------------------------------------------------------------


def test_run_names(spark):
    data = ["test-06b-full-seed43-e4-seed43", "32b-base", "test-8b-r128-e3", "foo", "test-06b-base-seed44-seed44", "8b-full-thrfull-icd2-seed43-e3-seed43",
            "test-medgemma-27b-it", "8b-full-mimic-e2", "8b-base-seed43-seed43", "test-9b-other-e1"]
    got = {r["collection"]: tuple(r[c] for c in N.DIMENSIONS) for r in N.parse_name(spark.createDataFrame([(n,) for n in data], "collection string")).collect()}
    assert got == {
        "test-06b-full-seed43-e4-seed43": ("0.6b", "thrfull-icd2", "full", 4, False, True, False, 43, None),
        "32b-base": ("32b", None, None, None, True, False, False, 42, None),
        "test-8b-r128-e3": ("8b", "thrfull-icd2", "lora", 3, False, True, False, 42, None),
        "test-06b-base-seed44-seed44": ("0.6b", None, None, None, True, True, False, 44, None),
        "test-medgemma-27b-it": (None, None, "external", None, False, True, True, 42, "MedGemma-27B-it"),
        "8b-full-mimic-e2": ("8b", "mimic", "full", 2, False, False, False, 42, None),
    }


def test_seed_aggregate_single_seed(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "run string, f double")
    assert rows(RP.seed_aggregate(df, ["run"], ["f"]), "run", "f", "f_std", "n_seeds") == [("a", 1.0, 0.0, 1), ("b", 2.0, pytest.approx(2 ** 0.5), 2)]


def test_upsert_replaces_and_aligns(spark):
    old = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 6.0)], "collection string, f double, g double")
    new = spark.createDataFrame([("b", 9.0)], "collection string, f double")
    assert rows(RP.upsert(old, new), "collection", "f", "g") == [("a", 1.0, 5.0), ("b", 9.0, None)]
    assert rows(RP.upsert(RP.upsert(old, new), new), "collection", "f") == [("a", 1.0), ("b", 9.0)]


def test_strict_audit_raises(spark):
    recomputed = spark.createDataFrame([("m", "f1", 9, 10.0), ("m", "f1", 10, 11.0)], "model string, metric string, version int, value double")
    published = spark.createDataFrame([("m", "f1", 10.4, True)], "model string, metric string, published double, asserted boolean")
    assert rows(RP.audit(recomputed, published, ["model"]), "delta", "failed") == [(0.1, True)]
    with pytest.raises(ValueError):
        RP.audit(recomputed, published, ["model"], strict=True)


def test_best_flags_use_a_tolerance(spark):
    df = spark.createDataFrame([("a", 50.0, False), ("b", 50.0000001, False), ("c", 60.0, True)], "run string, f double, base boolean")
    assert rows(RP.flag_best(df, ["f"], ~F.col("base")), "run", "f_best") == [("a", True), ("b", True), ("c", False)]


# --- filters and checks --------------------------------------------------------------------


def test_filters(spark):
    df = spark.createDataFrame([("cc_dyspnea", 2), ("cc_dyspnea", 1), ("cc_back_pain", 2), ("cc_back_pain", -1), ("cc_cough", 3)], "cc string, match_category int")
    assert rows(FL.within_rank(df, FL.complaint_name(F.col("cc"))), "cc", "match_category") == [("cc_back_pain", 2), ("cc_dyspnea", 1)]
    splits = spark.createDataFrame([("val",), ("train",), ("odd",)], "split string")
    assert rows(splits.select(FL.canonical_split(F.col("split")).alias("s")), "s") == [("dev",), ("odd",), ("train",)]
    assert rows(FL.unknown_splits(splits), "split", "count") == [("odd", 1)]
    open_rows = spark.createDataFrame([(1, None, "None"), (2, 0.6, None), (3, 0.7, "[]")], "id int, score double, v1_json string")
    assert rows(FL.still_open(open_rows, F.col("score"), F.lit(0.6)), "id") == [(1,), (2,)]
    assert rows(FL.without_answer(open_rows, "v1_json"), "id") == [(1,), (2,)]


def test_checks(spark):
    with pytest.raises(ValueError):
        Q.require_columns(spark.range(1), ["x"])
    with pytest.raises(ValueError):
        Q.require_names(["x"], ["y"])
    dump = spark.createDataFrame([(0, ["A00"]), (1, ["B00"])], "pos int, gold array<string>")
    full = spark.createDataFrame([(0, ["A001"]), (1, ["C001"]), (2, ["D001"])], "pos int, SHORT_CODES array<string>")
    assert rows(Q.misaligned(dump, full), "pos") == [(1,), (2,)]
    splits = spark.createDataFrame([(1, "train"), (2, "test")], "hadm_id int, split string")
    assert rows(Q.leaks(splits.select("hadm_id"), splits), "split", "n_ids") == [("train", 1)]


def test_scored_json_survives_a_round_trip(spark):
    data = [(1, "c", "m", 4, 1, 0, json.dumps([{"icd_code": f"A0{i}.1", "reason": "r"} for i in range(4)])), (1, "c", "m", 4, 1, 1, "nothing")]
    cands = spark.createDataFrame(data, "hadm_id long, chief_complaint string, model string, stage int, round int, choice_idx int, text string")
    gold = spark.createDataFrame([(1, ["A001", "A013", "B1"])], "hadm_id long, ICD_CODES array<string>")
    space = spark.createDataFrame([("A00",), ("A01",), ("A02",), ("B1",)], "code string")
    assert rows(SE.score_codes(cands, space, gold), "choice_idx", "score") == [(0, 0.667), (1, None)]
