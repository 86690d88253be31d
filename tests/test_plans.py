import functools
import json

import pytest
from pyspark.sql import functions as F

from scorefold.functions.text import LineRules
from scorefold.operators import selection as SE, set_metrics as SM
from scorefold.operators.selection import THRESHOLDS
from scorefold.functions import rendering as R
from scorefold.plans import cohort as CO, instructions as I, merge as MG, scorecard as SC
from scorefold.session import shared_dir
from scorefold.sources import metric_table as MT, readers as RD, sinks as SK
from scorefold.streaming import incremental as INC


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- instruction arms -------------------------------------------------------------

CODES = [{"icd_code": "K56.6", "reason": "a"}, {"icd_code": "Z99", "reason": "b"}]


def patients(spark, scores, answer):
    data = []
    for i, score in enumerate(scores):
        text = "<think>\nplan\n</think> x"
        data.append((i, 1, "train", "cc_x", "m", ["K5660", "B20"], "flu", None, None, None, score, None, None, None, answer(i)) + (text,) * 4 + ("p",) * 4)
    names = ["hadm_id long", "subject_id long", "split string", "cc string", "model string", "ICD_CODES array<string>", "disease string"]
    names += [f"v{s}_score double" for s in (1, 2, 3, 4)] + [f"v{s}_json string" for s in (1, 2, 3, 4)]
    names += [f"v{s}_text string" for s in (1, 2, 3, 4)] + [f"v{s}_prompt string" for s in (1, 2, 3, 4)]
    return spark.createDataFrame(data, ", ".join(names))


def test_instruction_arms(spark):
    scores = [1.0, 0.7, 0.5, 0.0]
    df = patients(spark, scores, lambda i: str(CODES))
    got = {r["hadm_id"]: r for r in I.build_instructions(df, I.Variant(THRESHOLDS)).filter("Verifier = 4").collect()}
    aligned = [CODES[0], {"icd_code": "B20", "reason": "Based on the admission note code B20 is suspected."}]
    assert json.loads(got[0]["Output"]) == CODES and got[0]["Thinking"] == "plan" and got[0]["trace"]
    assert json.loads(got[1]["Output"]) == aligned and got[1]["trace"]
    assert got[1]["Thinking"].startswith("planI think the patient has the following ICD codes:\n1: K56.6\n2: Z99\nAfter a final")
    for i in (2, 3):
        assert json.loads(got[i]["Output"]) == aligned and got[i]["Thinking"] == "" and not got[i]["trace"]
    dropped = I.build_instructions(df, I.Variant(THRESHOLDS, drop=True))
    assert rows(dropped.filter("Verifier = 4"), "hadm_id") == [(0,), (1,)]


def test_rows_without_answer_use_the_reference(spark):
    df = patients(spark, [0.4], lambda i: "None")
    got = {r["Verifier"]: r["Output"] for r in I.build_instructions(df).collect()}
    assert sorted(got) == [2, 3, 4]
    assert got[2] == '[{"name": "flu", "reason": "Based on the admission note flu is suspected."}]'
    assert [e["icd_code"] for e in json.loads(got[4])] == ["K5660", "B20"]


def test_unscored_patients_and_repeats(spark):
    df = patients(spark, [None, 0.9], lambda i: str(CODES))
    assert I.stage_rows(df).count() == 4
    twice = I.build_instructions(df, I.Variant(duplicates=(4,)))
    assert rows(twice.groupBy("Verifier").count(), "Verifier", "count") == [(2, 1), (3, 1), (4, 2)]
    with pytest.raises(ValueError):
        I.Variant(best_per_id=True, duplicates=(4,))


def test_variants_agree_with_single_builds(spark):
    df = patients(spark, [1.0, 0.7, 0.3, 0.0], lambda i: str(CODES))
    together = I.build_variants(df)
    for name, variant in I.VARIANTS.items():
        alone = I.build_instructions(df, variant)
        assert rows(together.filter(F.col("variant") == name), "hadm_id", "Verifier", "trace", "Output", "Thinking") == \
            rows(alone, "hadm_id", "Verifier", "trace", "Output", "Thinking")


def test_variants_are_made_in_one_pass_without_texts_in_a_sort(spark):
    df = patients(spark, [1.0, 0.7], lambda i: str(CODES))
    plan = I.build_variants(df)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "row_number" not in plan and plan.count("Window [") == 1
    order = [line for line in plan.splitlines() if "Sort [" in line]
    assert len(order) == 1 and "Verifier" not in order[0]


def test_values_without_a_slot_are_not_computed(spark):
    df = spark.createDataFrame([("{a} {{b}}", "x"), (None, "y")], "template string, a string")
    costly = F.raise_error(F.concat(F.lit("computed "), "a")).cast("string")
    filled = R.fill_template(F.col("template"), {"a": F.col("a"), "c": costly}, strict=True)
    assert [r["t"] for r in df.select(filled.alias("t")).collect()] == ["x {b}", None]


def test_lists_of_an_admission_meet_it_without_another_shuffle(spark):
    from catalog.inputs import admissions, answer_lists
    d = "/root/testdata/sf0.001"
    joined = answer_lists(spark, d).join(admissions(spark, d).hint("merge"), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(id") == 2 and "hashpartitioning(system#" in plan and plan.count("hashpartitioning(system#") == 1


def test_best_generator_of_each_stage(spark):
    """Ties go to the first name, a missing score is last, a repeated row is taken once."""
    def of(score, model):
        return patients(spark, [score], lambda i: str(CODES)).withColumn("model", F.lit(model)).withColumn("v2_score", F.lit(float("nan")))

    df = of(0.5, "c").unionByName(of(0.5, "b")).unionByName(of(0.5, "b")).unionByName(of(0.2, "a")).unionByName(of(None, "d").withColumn("v3_score", F.lit(0.9)))
    got = I.build_instructions(df, I.Variant(best_per_id=True))
    assert rows(got, "Verifier", "model") == [(2, "a"), (3, "d"), (4, "b")]


# --- cohort --------------------------------------------------------------------------


def test_annotate_fixture(spark):
    notes = spark.createDataFrame(
        [(1, "train", "Chief Complaint: chest pain\n\nFacility:\nDischarge Diagnosis:\nPrimary: Angina\nDischarge Condition:\nok"), (2, "train", "Chief Complaint: none")],
        "hadm_id long, split string, discharge_note string",
    )
    labs = spark.createDataFrame([], "hadm_id long, itemid long, storetime timestamp, valuenum double, valueuom string, label string, flag string")
    stays = spark.createDataFrame([], "hadm_id long, admittime timestamp, dischtime timestamp")
    out = CO.annotate(notes, labs, stays, {"chest pain": ["chest"]}, {"chest pain": "cardio"}, LineRules(trim_prefixes=["PRIMARY:"]))
    got = out.collect()
    assert [(r["hadm_id"], r["cc_list"], r["system_list"], r["diagnose_string"], r["labs"]) for r in got] == [(1, ["chest pain"], ["cardio"], "Angina", None)]


def test_merge_applies_the_rank_filter_first(spark):
    data = [(1, 1, "cc_cough", m, 0, "val") for m in "ab"] + [(1, 1, "cc_dyspnea", m, c, "val") for m, c in (("a", 1), ("b", 2))]
    df = spark.createDataFrame(data, "subject_id long, hadm_id long, cc string, model string, match_category int, split string")
    merged, assignment = MG.merge_generators(df)
    assert rows(assignment, "hadm_id", "cc") == [(1, "cc_cough")]
    assert rows(MG.combine(merged), "hadm_id", "split", "gen_model") == [(1, "dev", "a"), (1, "dev", "b")]


# --- sources ---------------------------------------------------------------------------


def test_disease_files_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "back_pain.csv").write_bytes("﻿Disease,Synonyms,icd10_regex,Onset Acute,Pain: Diffuse\nB,b,^M5,1,-1\nA,a,^M4,0,1\n".encode())
    (tmp_path / "cough.csv").write_text("Disease,Synonyms,icd10_regex,Fever\nC,c,^J2,1\n")
    got = RD.read_diseases(spark, str(tmp_path), ["back pain", "cough"])
    assert rows(got, "chief_complaint", "pos", "disease", "features") == [("back pain", 0, "B", [1, -1]), ("back pain", 1, "A", [0, 1]), ("cough", 0, "C", [1])]


def test_scheme_files(spark, tmp_path):
    (tmp_path / "back_pain.yaml").write_text("Onset Acute: [-1, 0, 1]\nPain: Low: [0, 1]\n\n")
    schemes = RD.read_schemes(spark, str(tmp_path))
    assert rows(schemes, "chief_complaint", "pos", "feature", "min_value", "max_value") == [("back pain", 0, "Onset Acute", -1, 1), ("back pain", 1, "Pain: Low", 0, 1)]
    assert rows(RD.schemes_by_complaint(schemes), "features") == [(["Onset Acute", "Pain: Low"],)]


def test_complaint_file(spark, tmp_path):
    (tmp_path / "cc.csv").write_text('chief_complaint,synonyms,systems\nchest pain,"[\'chest\', \'pain in chest\']",cardio\n')
    assert RD.read_complaints(spark, str(tmp_path / "cc.csv")) == ({"chest pain": ["chest", "pain in chest"]}, {"chest pain": "cardio"})


def test_prediction_dump(spark, tmp_path):
    dump = {"annotated_codes": [["a"], ["b", "c"]], "predicted_codes": [["a", "x"], []], "predicted_codes@20": [["a"], []], "unique_labels": ["a", "b"]}
    (tmp_path / "d.json").write_text(json.dumps(dump, indent=1))
    data, vocabulary = RD.read_dump(spark, str(tmp_path / "d.json"))
    assert rows(data, "pos", "gold", "full", "top_n") == [(0, ["a"], ["a", "x"], ["a"]), (1, ["b", "c"], [], [])]
    assert rows(vocabulary, "code") == [("a",), ("b",)]


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of 2 kB."""
    names = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_dictionary_of_several_splits_keeps_its_order(spark, tmp_path, small_splits):
    lines = "".join(f"name {k},,^A{k},{k % 3 - 1}\n" for k in range(3000))
    (tmp_path / "cough.csv").write_text("Disease,Synonyms,icd10_regex,Fever\n" + lines)
    assert spark.read.csv(str(tmp_path / "cough.csv"), header=True).rdd.getNumPartitions() > 5
    got = RD.read_diseases(spark, str(tmp_path), ["cough"]).collect()
    assert sorted((r["pos"], r["disease"]) for r in got) == [(k, f"name {k}") for k in range(3000)]


@pytest.mark.parametrize("indent", [None, 1])
def test_dump_of_several_splits(spark, tmp_path, small_splits, indent):
    gold = [[f"a{k}", 'q"\\b'] * (k % 3) for k in range(2000)]
    dump = {"annotated_codes": gold, "predicted_codes": [], "other": [[1, 2]], "predicted_codes@20": [["x"], [], ["y"]], "unique_labels": ["u", "v"]}
    (tmp_path / "d.json").write_text(json.dumps(dump, indent=indent))
    data, vocabulary = RD.read_dump(spark, str(tmp_path / "d.json"))
    got = sorted((r["pos"], r["gold"], r["full"], r["top_n"]) for r in data.collect())
    tops = dict(enumerate(dump["predicted_codes@20"]))
    assert got == [(k, g, None, tops.get(k)) for k, g in enumerate(gold)]
    assert rows(vocabulary, "code") == [("u",), ("v",)]


def test_dump_of_several_files(spark, tmp_path):
    """A folder of files, each of whole lists and with a line break at its end, is one dump; numbering it sorts nothing."""
    parts = ['{"annotated_codes": [["a0"]\n, ["a1"]\n', ', ["a2"]\n], "predicted_codes": [["p0"]\n', ', []\n', ', ["p2"]\n], "unique_labels": ["u"]}\n']
    (tmp_path / "d.json").mkdir()
    for k, text in enumerate(parts):
        (tmp_path / "d.json" / f"part-0000{k}.txt").write_text(text)
    data, vocabulary = RD.read_dump(spark, str(tmp_path / "d.json"))
    assert rows(data, "pos", "gold", "full") == [(0, ["a0"], ["p0"]), (1, ["a1"], []), (2, ["a2"], ["p2"])]
    assert rows(vocabulary, "code") == [("u",)]
    numbered = RD._in_order(spark.read.text(str(tmp_path / "d.json")))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("gold", [[["a]b"]], [None, ["a"]], [{"x": ["a"]}]])
def test_dump_of_other_values_stops(spark, tmp_path, gold):
    (tmp_path / "d.json").write_text(json.dumps({"annotated_codes": gold}))
    with pytest.raises(Exception, match="lists of codes"):
        RD.read_dump(spark, str(tmp_path / "d.json"))[0].collect()


def test_file_stem_looks_at_the_last_two_names_only(spark, tmp_path):
    """A folder further up that looks like a file does not count, and no long path is searched letter by letter."""
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "a.pq" / "b" / "m0.pq"))
    read = RD.read_models(spark, str(tmp_path / "a.pq"))
    assert rows(read, "gen_model") == [("m0",)]
    assert "substring_index(" in read._jdf.queryExecution().analyzed().toString()


def test_older_versions_are_not_opened(spark, tmp_path):
    for v in range(5):
        spark.createDataFrame([(v, "['a', 'b']", "None")], "n int, v2_preds string, other string").write.parquet(str(tmp_path / "e" / f"v{v}" / "e.pq"))
    for old in ("v0", "v1"):
        for file in (tmp_path / "e" / old).rglob("*.parquet"):
            file.write_bytes(b"not parquet")
    got = RD.read_newest(spark, str(tmp_path), ["e"], 3)
    assert rows(got, "version", "n", "v2_preds", "other") == [(v, v, ["a", "b"], "None") for v in (2, 3, 4)]
    assert all("/v0/" not in f and "/v1/" not in f for f in got.inputFiles())


def test_generated_and_newest_files(spark, tmp_path):
    for model in ("m1", "m2"):
        spark.range(2).write.parquet(str(tmp_path / "gen" / model / "cc_back_pain.pq"))
    spark.range(5).write.parquet(str(tmp_path / "gen" / "m1.pq"))
    got = RD.read_generated(spark, str(tmp_path / "gen")).groupBy("model", "cc").count()
    assert rows(got, "model", "cc", "count") == [("m1", "cc_back_pain", 2), ("m2", "cc_back_pain", 2)]
    for name, version in (("a", 1), ("a", 10), ("b", 10), ("b", 2), ("c", 11)):
        spark.range(1).write.parquet(str(tmp_path / "exp" / name / f"v{version}" / f"{name}.pq"))
    newest = RD.read_newest(spark, str(tmp_path / "exp"), ["b", "a"], 3)
    assert rows(newest, "experiment", "version") == [("a", 10), ("b", 2), ("b", 10)]


def test_versions_are_never_replaced(spark, tmp_path):
    SK.export_version(spark.range(1), str(tmp_path), "v1", "d")
    with pytest.raises(Exception, match="already exists"):
        SK.export_version(spark.range(1), str(tmp_path), "v1", "d")


def test_resume_point(spark):
    rounds = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "stage int, round int")
    accepted = spark.createDataFrame([(5, 2, True), (6, 2, False), (6, 1, True)], "hadm_id long, stage int, accepted boolean")
    items = spark.createDataFrame([(5,), (6,)], "hadm_id long")
    assert rows(SK.next_step(rounds, accepted, items, ["hadm_id"], 4), "stage", "round", "n_open", "stage_done") == [(2, 1, 1, False)]
    assert rows(SK.next_step(rounds, accepted, items, ["hadm_id"], 1), "stage_done") == [(True,)]


def test_shared_folder_setting(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")


# --- incremental evaluation ---------------------------------------------------------------


SETS = "collection string, gold array<string>, pred array<string>"


def evaluation(path, **more):
    return INC.Evaluation(str(path), INC.list_tallies(), INC.list_scores, **more)


def standing(ev, spark):
    return {r["collection"]: (r["tp"], r["fp"], r["fn"], r["n_samples"]) for r in ev.scores(spark).collect()}


def test_incremental_evaluation(spark, tmp_path):
    inbox, ev = str(tmp_path / "in"), evaluation(tmp_path / "state")

    def arrive(data):
        df = spark.createDataFrame(data, SETS)
        df.write.mode("append").parquet(inbox)
        ev.run(INC.prediction_stream(spark, inbox, df.schema))
        return standing(ev, spark)

    assert arrive([("a", ["x", "y"], ["x", "z"])]) == {"a": (1, 1, 1, 1)}
    assert arrive([("a", ["x"], ["x"]), ("b", ["q"], [])]) == {"a": (2, 1, 1, 2), "b": (0, 0, 1, 1)}


def test_evaluated_runs_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"], ["x"]), ("b", ["x"], [])], SETS)
    inbox, ev = str(tmp_path / "in"), evaluation(tmp_path / "state")
    df.write.parquet(inbox)
    ev.run(INC.prediction_stream(spark, inbox, df.schema), done=df.filter("collection = 'a'"))
    assert {k: v[2] for k, v in standing(ev, spark).items()} == {"b": 1}


def test_repeated_and_compacted_batches_add_up_once(spark, tmp_path):
    ev = evaluation(tmp_path, buckets=4, compact_every=2)
    batches = [spark.createDataFrame([(f"run{(k + j) % 5}", ["x", f"g{j}"], ["x", f"p{k}"]) for j in range(3)], SETS) for k in range(5)]
    nothing = spark.createDataFrame([], SETS)
    for number, batch in enumerate([nothing, *batches]):
        for _ in range(1 + number % 2):
            ev.take(batch, number)
    want = INC.list_scores(INC.list_tallies()(functools.reduce(lambda a, b: a.union(b), batches), ["collection"]), ["collection"])
    assert sorted(map(tuple, ev.scores(spark).collect())) == sorted(map(tuple, want.select(ev.scores(spark).columns).collect()))
    assert sorted(p.name for p in (tmp_path / "tallies" / "merged").iterdir()) == ["upto=1", "upto=3"]
    assert sorted(map(tuple, INC.list_scores(ev.store.read(spark), ["collection"]).collect())) == sorted(map(tuple, want.collect()))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "m")
    old = spark.range(40).selectExpr("concat('run', id) AS collection", "id AS n")
    MT.create(old, path, buckets=8)
    before = files(tmp_path / "m" / "data")
    new = spark.createDataFrame([("run3", -1, "x"), ("new", -2, None)], "collection string, n long, note string")
    touched = MT.upsert(new, path)
    after = files(tmp_path / "m" / "data")
    kept = {p for p in before if p in after and before[p] == after[p]}
    assert 1 <= len(touched) <= 2 and {int(p.split("name_bucket=")[1].split("/")[0]) for p in before if p not in kept} == set(touched) & set(range(8))
    want = {f"run{k}": (k, None) for k in range(40)} | {"run3": (-1, "x"), "new": (-2, None)}
    assert {r["collection"]: (r["n"], r["note"]) for r in MT.read(spark, path).collect()} == want
    MT.upsert(new, path)
    assert MT.read(spark, path).count() == len(want)
    MT.append(spark.createDataFrame([("run3", 5), ("other", 6)], "collection string, n long"), path)
    want["other"] = (6, None)
    assert {r["collection"]: (r["n"], r["note"]) for r in MT.read(spark, path).collect()} == want


def test_scorecards_read_their_rows_once(spark, tmp_path):
    """One scan in the plan of each fused report."""
    rows = spark.createDataFrame(
        [("s", "c", ["A1", "B2"], ["A1"], ["d"], "d", [1, 0], [1, 1], "[1]", "raw A01")],
        "collection string, chief_complaint string, code_gold array<string>, code_pred array<string>, name_pred array<string>, disease string, "
        "vector_pred array<int>, disease_vector array<int>, v1_json string, raw_codes string",
    )
    rows.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    for report in (
        SC.scorecard(stored, ["collection"]), SC.per_complaint(stored, ["collection"]),
        SM.full_code_scores(stored.withColumn("raw_codes", F.array("raw_codes")), ["collection"], "code_gold", "raw_codes"),
    ):
        plan = report._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "Join" not in plan
        assert report.count() >= 1


def test_scorecard_of_rows_without_anything(spark):
    schema = ("collection string, code_gold array<string>, code_pred array<string>, name_pred array<string>, disease string, "
              "vector_pred array<int>, disease_vector array<int>")
    rows = spark.createDataFrame([("s", None, None, None, None, None, None), ("s", ["A"], ["A"], ["d", "d"], "d", None, [1, -1])], schema)
    card = SC.scorecard(rows, ["collection"]).first()
    assert (card["n_samples"], card["f1_micro"], card["mrr"], card["code_len"], card["cos_sim"]) == (2, 100.0, 50.0, 0.5, 0.0)
    assert card["f1_micro_at_1"] == pytest.approx(66.67)
    assert SC.scorecard(rows.limit(0), ["collection"]).count() == 0


def test_label_space_is_joined(spark):
    answer = json.dumps([{"icd_code": f"A0{i}", "reason": "r"} for i in range(4)])
    data = [(1, "c", "m", 4, 1, 0, answer), (1, "c", "m", 4, 1, 1, "nothing")]
    cands = spark.createDataFrame(data, "hadm_id long, chief_complaint string, model string, stage int, round int, choice_idx int, text string")
    gold = spark.createDataFrame([(1, ["A001", "A013", "B1"])], "hadm_id long, ICD_CODES array<string>")
    space = spark.createDataFrame([("A00",), ("A01",), ("A02",), ("B1",)], "code string")
    scores = SE.score_codes(cands, space, gold)
    assert rows(scores, "choice_idx", "score") == [(0, 0.667), (1, None)]
    assert rows(SE.score_codes(cands, space, gold.where("false")), "choice_idx", "score") == [(0, None), (1, None)]
    with pytest.raises(Exception, match="not identified"):
        SE.score_codes(cands.union(cands), space, gold).collect()
    best = SE.best_choice(scores, ["hadm_id", "stage", "round"])
    assert rows(SE.with_text(best, cands), "choice_idx", "text") == [(0, answer)]
