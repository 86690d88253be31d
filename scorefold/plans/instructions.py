"""Instruction datasets: reasoning, fallback and direct rows, all variants in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorefold.functions import parsing as P, rendering as R
from scorefold.functions.scoring import no_nan
from scorefold.functions.text import reasoning, strip_newlines
from scorefold.operators.filters import with_any
from scorefold.operators.selection import THRESHOLDS, keep_first
from scorefold.schemas import CODE_LIST, DIAGNOSIS_LIST, FINDING_MAP, INSTRUCTION_COLUMNS

STAGES = (1, 2, 3, 4)
EVAL_SPLITS = ("dev", "val")
NO_THRESHOLDS = {s: 0.0 for s in STAGES}


@dataclass(frozen=True)
class Variant:
    """How one dataset is built; ``thresholds=None`` only sends missing and 0 scores to fallback."""

    thresholds: dict[int, float] | None = None
    models: tuple[str, ...] | None = None
    best_per_id: bool = False
    duplicates: tuple[int, ...] = field(default=())
    drop: bool = False

    def __post_init__(self) -> None:
        if self.duplicates and self.best_per_id:
            raise ValueError("repeated stages would collapse again under best_per_id")


HALF = {s: t / 2 for s, t in THRESHOLDS.items()}
VARIANTS = {
    "replace": Variant(),
    "thr_full": Variant(THRESHOLDS),
    "thr_half": Variant(HALF),
    "best_per_id": Variant(best_per_id=True),
    "icd_2x": Variant(duplicates=(4,)),
    "thrfull_icd2x": Variant(THRESHOLDS, duplicates=(4,)),
    "thrfull_drop": Variant(THRESHOLDS, drop=True),
}


def stage_rows(patients: DataFrame, complaint: str = "cc", mark_best: bool = False) -> DataFrame:
    """One raw row per (admission, model, stage); rows without any score are left out.

    ``mark_best`` adds ``is_best``: the model has the highest score of the stage, ties go to
    the first name. It is found among the few rows of an admission, before stages and texts
    are made: no stage row is shuffled or sorted for it, and rows that a join has brought
    together by admission already are not sorted again.
    """
    scored = with_any(patients, [f"v{s}_score" for s in STAGES])
    if mark_best:
        scored = with_best(scored.withColumn("_row", F.monotonically_increasing_id()))

    def stage(s: int) -> Column:
        best = [F.col(f"_best{s}").alias("is_best")] if mark_best else []
        return F.struct(
            F.lit(s).alias("Verifier"), F.col(f"v{s}_score").cast("double").alias("Score"),
            F.col(f"v{s}_prompt").alias("Input"), F.col(f"v{s}_json").alias("answer"),
            F.col(f"v{s}_text").alias("text"), *best,
        )

    return scored.select(
        "hadm_id", "subject_id", "split", F.col(complaint).alias("chief_complaint"), "model",
        "ICD_CODES", "disease", F.inline(F.array(*[stage(s) for s in STAGES])),
    )


def with_best(rows: DataFrame) -> DataFrame:
    """``_best<s>`` for every stage: the first row of the admission by falling score, model and ``_row``."""
    admission = Window.partitionBy("hadm_id")

    def is_best(s: int) -> Column:
        score = no_nan(F.col(f"v{s}_score").cast("double"))
        place = F.struct(score.isNull().alias("none"), (-score).alias("s"), F.col("model"), F.col("_row"))
        return F.min(place).over(admission)["_row"] == F.col("_row")

    return rows.withColumns({f"_best{s}": is_best(s) for s in STAGES}).drop("_row")


def _lookup(thresholds: dict[int, float] | None) -> Column:
    table = thresholds or NO_THRESHOLDS
    return F.create_map(*[F.lit(v) for s in STAGES for v in (s, float(table.get(s, 0.0)))])


def _variant_column(variants: dict[str, Variant], model: Column, stage: Column) -> Column:
    """The variants (and repeats) a raw row takes part in, as structs to explode."""
    uses = []
    for name, v in variants.items():
        copies = F.when(stage.isin(list(v.duplicates)), 2).otherwise(1) if v.duplicates else F.lit(1)
        if v.models is not None:
            copies = F.when(model.isin(list(v.models)), copies).otherwise(0)
        if v.best_per_id:
            copies = F.when(F.col("is_best"), copies).otherwise(0)
        use = F.struct(
            F.lit(name).alias("variant"), F.element_at(_lookup(v.thresholds), stage).alias("threshold"),
            F.lit(v.drop).alias("drop"),
        )
        uses.append(F.array_repeat(use, copies))
    return F.concat(*uses)


def rendered_arms(raw: DataFrame) -> DataFrame:
    """The texts a raw row can end up with, whatever the variant.

    ``kept`` is the answer with a score of 1 or more, ``fixed`` the answer
    moved towards the reference, ``gold_only`` the target without any answer,
    ``told`` the reasoning (which names the moved answer below a score of 1).
    The last two are null where no variant can use them.
    """
    v, score = F.col("Verifier"), no_nan(F.col("Score"))
    is_name, is_code = v.isin(2, 3), v == 4
    parsed = raw.withColumns(
        {
            "names": F.when(is_name, P.parse_answer(F.col("answer"), DIAGNOSIS_LIST)),
            "codes": F.when(is_code, P.parse_answer(F.col("answer"), CODE_LIST)),
            "findings": F.when(v == 1, P.parse_answer(F.col("answer"), FINDING_MAP)),
        }
    )
    names, codes, findings = F.col("names"), F.col("codes"), F.col("findings")
    thinking = reasoning(F.col("text"))
    told = (
        F.when(is_name & (score < 1.0), R.with_name_order(thinking, names))
        .when(is_code & (score < 1.0), R.with_code_order(thinking, codes))
        .otherwise(thinking)
    )
    full = score >= 1.0
    usable = names.isNotNull() | codes.isNotNull() | findings.isNotNull()
    return parsed.select(
        *raw.columns,
        usable.alias("usable"),
        F.when(usable & (score > 0), strip_newlines(told)).alias("told"),
        F.when(full & is_name, R.json_entries(names, "name"))
        .when(full & is_code, R.json_entries(codes, "icd_code")).alias("kept"),
        F.when(is_name, R.json_entries(R.target_first(names, F.col("disease")), "name"))
        .when(is_code, R.json_entries(R.align_codes(codes, F.col("ICD_CODES")), "icd_code"))
        .otherwise(R.json_findings(findings)).alias("fixed"),
        F.when(usable, None).when(is_code, R.gold_codes_target(F.col("ICD_CODES")))
        .when(is_name & F.col("disease").isNotNull(), R.gold_name_target(F.col("disease"))).alias("gold_only"),
    )


def route(rows: DataFrame) -> DataFrame:
    """Reasoning or fallback for every (raw row, variant); rows without a target are dropped.

    A row keeps its reasoning if its answer parses and its score is positive
    and reaches ``threshold``. All other rows fall back to a target without
    reasoning, or are dropped where ``drop`` is set.
    """
    score = no_nan(F.col("Score"))
    trace = F.coalesce(F.col("usable") & (score > 0) & (score >= F.col("threshold")), F.lit(False))
    routed = rows.withColumn("trace", trace).filter(F.col("trace") | ~F.col("drop"))
    out = routed.withColumns(
        {
            "Thinking": F.when(F.col("trace"), F.col("told")).otherwise(F.lit("")),
            "Output": F.when(~F.col("usable"), F.col("gold_only"))
            .when(F.col("trace"), F.coalesce("kept", "fixed"))
            .otherwise(F.col("fixed")),
        }
    )
    return out.filter("Output IS NOT NULL AND Input IS NOT NULL").select("variant", *INSTRUCTION_COLUMNS)


def build_variants(patients: DataFrame, variants: dict[str, Variant] | None = None, complaint: str = "cc") -> DataFrame:
    """All variants in one table with a ``variant`` column.

    Every raw row is parsed and rendered once; exploding the short list of
    variants it belongs to only chooses among the rendered texts. Best-per-id
    variants use the rows of the best generator per stage.
    """
    variants = variants or VARIANTS
    raw = stage_rows(patients, complaint, any(v.best_per_id for v in variants.values()))
    uses = _variant_column(variants, F.col("model"), F.col("Verifier"))
    return route(rendered_arms(raw).select("*", F.inline(uses)))


def build_instructions(patients: DataFrame, variant: Variant = Variant(), complaint: str = "cc") -> DataFrame:
    """One dataset."""
    return build_variants(patients, {"only": variant}, complaint).drop("variant")


# --- direct rows --------------------------------------------------------------


def numbered_vocabulary(labels: DataFrame) -> DataFrame:
    """``1. a`` .. text of each complaint's diseases (a dictionary has a few dozen)."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "disease")))
    names = F.transform(ordered, lambda e: e["disease"])
    return labels.groupBy("chief_complaint").agg(R.numbered(names, ". ").alias("potential_diagnoses"))


def direct_rows(combined: DataFrame, schemes: DataFrame, labels: DataFrame, templates: DataFrame,
                duplicates: tuple[int, ...] = (), stages: tuple[int, ...] = STAGES) -> DataFrame:
    """Rows with reference targets and no reasoning, one per admission and stage.

    ``schemes``: (chief_complaint, features); ``templates``: (stage,
    complaint, template), with ``generic`` as the complaint of the fallback.
    Rows whose vector and scheme differ in length have a null stage-1 output.
    """
    first = "gen_model" if "gen_model" in combined.columns else "subject_id"
    note = keep_first(combined, ["hadm_id"], [first])
    prepared = (
        note.withColumn("chief_complaint", F.col("`Chief Complaint`"))
        .join(schemes, "chief_complaint", "left")
        .join(numbered_vocabulary(labels), "chief_complaint", "left")
        .withColumn("labs_text", F.when(F.col("labs") != "None", F.col("labs")).otherwise(F.lit("")))
        .withColumn("labs_text", F.coalesce("labs_text", F.lit("")))
    )
    outputs = {
        1: R.findings_target(F.col("features"), F.col("disease_vector")),
        2: R.gold_name_target(F.col("disease"), True),
        3: R.gold_name_target(F.col("disease"), True),
        4: R.gold_codes_target(F.col("ICD_CODES"), True),
    }
    copies = [s for s in [*STAGES, *duplicates] if s in stages]
    stage = F.array(*[F.struct(F.lit(s).alias("Verifier"), outputs[s].alias("Output")) for s in copies])
    rows = prepared.withColumn("chief_complaint", F.replace("chief_complaint", F.lit(" "), F.lit("_")))
    rows = rows.select("*", F.inline(stage))
    rows = with_template(rows, templates, F.col("Verifier"), F.col("chief_complaint"))
    slots = {
        "admission_note": F.col("admission_note"),
        "laboratory_results": F.col("labs_text"),
        "potential_diagnoses": F.col("potential_diagnoses"),
        "symptom_format_example": R.findings_example(F.col("features")),
        "diagnose_format_example": F.lit(R.DIRECT_DIAGNOSIS_FORMAT),
        "icd_format_example": F.lit(R.CODE_FORMAT),
    }
    return rows.select(
        "hadm_id", "subject_id", "split", "chief_complaint", "Verifier",
        R.fill_parts(F.col("parts"), slots, strict=True).alias("Input"), "Output",
    )


def with_template(rows: DataFrame, templates: DataFrame, stage: Column, complaint: Column) -> DataFrame:
    """Adds ``template``: the stage's template for the complaint, else its generic one, else null; and ``parts`` of it.

    ``templates`` has one row per stage and complaint; it is joined twice by equal keys,
    whatever its size. A template is taken apart once, not in every row it is filled for.
    """
    cut = templates.withColumn("_text", F.when(F.col("template").isNotNull(), F.struct("template", R.template_parts(F.col("template")).alias("parts"))))
    own = cut.select(F.col("stage").alias("_stage"), F.col("complaint").alias("_complaint"), F.col("_text").alias("_own"))
    generic = cut.where("complaint = 'generic'").select(F.col("stage").alias("_stage"), F.col("_text").alias("_generic"))
    # The condition always holds; it keeps a constant stage from being folded out of the join.
    keyed = rows.withColumns({"_stage": F.when(F.pmod(F.hash(complaint), F.lit(1)) == 0, stage), "_complaint": complaint})
    found = keyed.join(own, ["_stage", "_complaint"], "left").join(generic, "_stage", "left")
    text = F.coalesce("_own", "_generic")
    return found.withColumns({"template": text["template"], "parts": text["parts"]}).drop("_stage", "_complaint", "_own", "_generic")


def build_prompts(patients: DataFrame, schemes: DataFrame, labels: DataFrame, templates: DataFrame,
                  stage: int, limit: int = R.MAX_PROMPT) -> DataFrame:
    """Prompt of a stage from the best answers of the stages before it."""
    answer = {n: P.parse_answer(F.col(f"v{n}_json"), t) for n, t in ((1, FINDING_MAP), (2, DIAGNOSIS_LIST), (3, DIAGNOSIS_LIST))}
    has = set(patients.columns)
    rows = patients.withColumn("chief_complaint", F.col("`Chief Complaint`"))
    rows = rows.join(schemes, "chief_complaint", "left")
    rows = rows.join(numbered_vocabulary(labels), "chief_complaint", "left")
    rows = with_template(rows, templates, F.lit(stage), F.col("chief_complaint"))
    findings = R.findings_text(answer[1], F.col("v1_json")) if "v1_json" in has else F.lit(R.NO_FINDINGS)
    second = answer[2] if "v2_json" in has else F.lit(None).cast(DIAGNOSIS_LIST)
    third = answer[3] if "v3_json" in has else second
    ranked = (
        R.ranked_names_text(third, F.col("disease"), F.lit(R.NO_DIAGNOSES)) if stage == 4
        else R.ranked_names_text(second, F.col("disease"), F.col("potential_diagnoses"))
    )
    slots = {
        "admission_note": F.col("admission_note"),
        "laboratory_results": F.coalesce("labs", F.lit(R.NO_LABS)),
        "potential_diagnoses": ranked,
        "clinical_manifestations": findings,
        "symptom_format_example": R.findings_example(F.col("features")),
        "diagnose_format_example": F.lit(R.DIAGNOSIS_FORMAT),
        "icd_format_example": F.lit(R.CODE_FORMAT),
    }
    return rows.select("hadm_id", R.fill_parts(F.col("parts"), slots, limit, strict=True).alias("prompt"))


# --- training text --------------------------------------------------------------


def training_text(instructions: DataFrame, system_prompt: str) -> DataFrame:
    """One chat text per row; datasets without a thinking column give bare answers."""
    thinking = F.col("Thinking") if "Thinking" in instructions.columns else F.lit(None).cast("string")
    text = R.chat_text(F.lit(system_prompt), F.col("Input"), thinking, F.col("Output"))
    return instructions.select("hadm_id", "Verifier", text.alias("text"), "split")


def training_splits(texts: DataFrame, eval_samples: int = -1) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Training texts, and the first ``eval_samples`` rows (all if not positive) per evaluation split."""
    train = texts.filter("split = 'train'").drop("split")
    held_out = {}
    for split in EVAL_SPLITS:
        rows = texts.filter(F.col("split") == split).drop("split")
        if eval_samples > 0:
            rows = rows.orderBy("hadm_id", "Verifier", "text").limit(eval_samples)
        if not rows.isEmpty():
            held_out[split] = rows
    return train, held_out
