"""Scoring candidate answers, keeping the best, retry accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorefold.functions import parsing as P
from scorefold.functions.binding import let
from scorefold.functions.codes import short_codes
from scorefold.functions.scoring import harmonic, no_nan, norm_dot, ratio

# Acceptance thresholds per stage, the number of rounds and the
# digits of a row score.
THRESHOLDS = {1: 0.6, 2: 0.5, 3: 0.8, 4: 0.55}
BUDGET = 4
SCORE_DIGITS = 3


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``.

    The row limit is applied before the shuffle too, so a frequent key sends
    at most one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def best_choice(candidates: DataFrame, keys: list[str], eval_mode: bool = False) -> DataFrame:
    """Best choice of a round: highest score, or the first valid one in evaluation mode."""
    candidates = candidates.withColumn("score", no_nan(F.col("score")))
    valid_first = F.when(F.col("score").isNull(), 1).otherwise(0)
    order = (
        [valid_first, F.col("choice_idx")] if eval_mode
        else [F.desc_nulls_last("score"), F.col("choice_idx")]
    )
    return keep_first(candidates, keys, order)


def best_round(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Best round: the first with the highest score; the last one while all lack a score."""
    rounds = rounds.withColumn("score", no_nan(F.col("score")))
    place = F.when(F.col("score").isNull(), -F.col("round")).otherwise(F.col("round"))
    return keep_first(rounds, keys, [F.desc_nulls_last("score"), place])


def best_generator(rows: DataFrame, keys: list[str], score: str = "Score", generator: str = "model") -> DataFrame:
    """Highest score per key over generators; ties go to the first name."""
    rows = rows.withColumn(score, no_nan(F.col(score)))
    return keep_first(rows, keys, [F.desc_nulls_last(score), F.col(generator)])


def _passes(entry: Column, threshold: Column, floor: Column | None, strict: bool) -> Column:
    score = entry["score"]
    enough = (score > threshold) if strict else (score >= threshold)
    return enough if floor is None else enough & (score >= F.coalesce(floor, score))


def _outcome(rounds: Column, passes: Callable[[Column], Column], fields: list[str], compat: bool) -> Column:
    """Best counted round of a stage with ``rounds_used`` and ``accepted``; null without rounds.

    ``rounds`` are the saved rounds in order. Counted are those up to the first that
    passes. The best is the first with the highest score, the last one while all lack a
    score.
    """

    def fold(v: Column) -> Column:
        own = v["rounds"]
        lost = F.get(own, F.lit(0))["score"].isNull() if compat else F.lit(False)
        leave = F.when(lost, F.get(own, F.lit(0))["round"]).otherwise(v["passed"])
        counted = F.filter(own, lambda e: leave.isNull() | (e["round"] <= leave))

        def pick(kept: Column) -> Column:
            places = F.transform(kept, lambda e, i: F.struct(
                e["score"].alias("s"), F.when(e["score"].isNull(), i).otherwise(-i).alias("tie"), i.alias("i")))
            best = F.get(kept, F.array_max(places)["i"])
            return F.when(F.size(kept) > 0, F.struct(
                *[best[c].alias(c) for c in fields], F.array_max(kept["round"]).alias("rounds_used"),
                (v["passed"].isNotNull() & ~lost).alias("accepted")))

        return let(counted, pick)

    return let(rounds, lambda own: let(
        F.struct(own.alias("rounds"), F.get(F.filter(own, passes), F.lit(0))["round"].alias("passed")), fold))


def _gathered(rounds: DataFrame, keys: list[str], first: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per key with its rounds in order, as ``rounds``; a key has at most one row per stage and round."""
    fields = [*first, *[c for c in rounds.columns if c not in (*keys, *first)]]
    return rounds.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rounds")), fields


def accept(rounds: DataFrame, keys: list[str], threshold: Column, floor: Column | None = None,
           budget: int = BUDGET, strict: bool = True, compat: bool = False) -> DataFrame:
    """Retry accounting over the best choice of every round.

    Rounds run up to ``budget``; an item leaves with the first round whose
    score passes the threshold (strictly by default) and the floor. ``compat``
    also lets an item leave when its first round has no score at all. Returns
    the best counted round with ``accepted`` and ``rounds_used``.
    """
    kept = rounds.filter(F.col("round") <= budget).withColumn("score", no_nan(F.col("score")))
    marked = kept.withColumns({"_limit": threshold.cast("double"), "_floor": F.lit(None).cast("double") if floor is None else floor.cast("double")})
    gathered, fields = _gathered(marked, keys, ["round", "score"])
    outcome = _outcome(F.col("rounds"), lambda e: _passes(e, e["_limit"], e["_floor"], strict), fields, compat)
    return gathered.select(*keys, F.inline(F.array(outcome))).drop("_limit", "_floor").select(*rounds.columns, "rounds_used", "accepted")


def accept_stages(stages: DataFrame, keys: list[str], thresholds: dict[int, float] | None = None,
                  budget: int = BUDGET, eval_mode: bool = False, compat: bool = False) -> DataFrame:
    """All stages of a chain as one fold; stage 3 must also reach the stage-2 score of its item.

    ``stages`` holds one scored candidate per row; stages without a threshold take no
    part. The best choices of an item, at most one per stage and round, are gathered
    once and folded stage by stage. Evaluation mode skips stage 3 and counts the first
    round with a valid answer.
    """
    thresholds = thresholds or THRESHOLDS
    order = [s for s in sorted(thresholds) if not (eval_mode and s == 3)]
    kept = stages.filter((F.col("round") <= budget) & F.col("stage").isin(order))
    gathered, fields = _gathered(best_choice(kept, [*keys, "stage", "round"], eval_mode), keys, ["stage", "round", "score"])

    def outcome(stage: int, floor: Column | None = None) -> Column:
        own = F.filter("rounds", lambda e: e["stage"] == stage)
        limit = F.lit(-1.0 if eval_mode else float(thresholds[stage]))
        return _outcome(own, lambda e: _passes(e, limit, floor, not eval_mode), fields, compat and not eval_mode)

    if 2 in order and 3 in order:
        rest = [s for s in order if s not in (2, 3)]
        all_stages = let(outcome(2), lambda second: F.array(second, outcome(3, second["score"]), *[outcome(s) for s in rest]))
    else:
        all_stages = F.array(*[outcome(s) for s in order])
    found = gathered.select(*keys, F.inline(F.filter(all_stages, lambda o: o.isNotNull())))
    return found.select(*stages.columns, "rounds_used", "accepted")


def open_items(items: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """The work list of the next round: items not accepted yet."""
    return items.join(accepted.filter("accepted").select(*keys), keys, "left_anti")


def round_means(rounds: DataFrame, by: list[str]) -> DataFrame:
    """Mean score with missing as 0 and mean of the valid scores, per group."""
    score = no_nan(F.col("score"))
    return rounds.groupBy(*by).agg(
        F.round(F.avg(F.coalesce(score, F.lit(0.0))), 3).alias("mean_score"),
        F.round(F.avg(score), 3).alias("mean_valid_score"),
    )


# --- scoring one stage ------------------------------------------------------

CANDIDATE_KEYS = ["hadm_id", "chief_complaint", "model", "stage", "round", "choice_idx"]


def score_findings(candidates: DataFrame, schemes: DataFrame, gold: DataFrame) -> DataFrame:
    """Stage 1: normalised dot product with the vector of the gold disease.

    ``schemes``: (chief_complaint, features); ``gold``: (hadm_id, disease_vector).
    """
    rows = candidates.join(schemes, "chief_complaint", "left")
    vector = P.finding_vector(P.extract_findings(F.col("text"), F.col("features")), F.col("features"))
    parsed = rows.select(*CANDIDATE_KEYS, vector.alias("vector"))
    score = F.round(norm_dot(F.col("vector"), F.col("disease_vector")), SCORE_DIGITS)
    return parsed.join(gold.select("hadm_id", "disease_vector"), "hadm_id", "left").select(
        *CANDIDATE_KEYS, score.alias("score")
    )


def score_diagnoses(candidates: DataFrame, labels: DataFrame, gold: DataFrame) -> DataFrame:
    """Stages 2 and 3: reciprocal rank of the gold disease.

    ``labels``: (chief_complaint, name, label) from ``snap_names``; ``gold``:
    (hadm_id, disease). Only the best position of the gold label is kept.
    """
    parsed = candidates.select(*CANDIDATE_KEYS, P.extract_diagnoses(F.col("text")).alias("answer"))
    named = (
        parsed.select(*CANDIDATE_KEYS, F.posexplode_outer("answer.name").alias("pos", "name"))
        .join(gold.select("hadm_id", "disease"), "hadm_id", "left")
        .join(labels.select("chief_complaint", "name", "label"), ["chief_complaint", "name"], "left")
    )
    place = named.groupBy(*CANDIDATE_KEYS).agg(
        F.min(F.when(F.col("label") == F.col("disease"), F.col("pos") + 1)).alias("place"),
        F.count("name").alias("n"),
    )
    score = F.when(F.col("n") > 0, ratio(F.lit(1.0), F.col("place")))
    return place.select(*CANDIDATE_KEYS, score.alias("score"))


def score_codes(candidates: DataFrame, label_space: DataFrame, gold: DataFrame) -> DataFrame:
    """Stage 4: F1 of the short predicted codes inside the label space.

    ``label_space``: (code); ``gold``: (hadm_id, ICD_CODES). The label space is
    joined to the exploded codes, whatever its size. A candidate without gold has
    a null score; a repeated candidate stops the job.
    """
    parsed = candidates.select(
        *CANDIDATE_KEYS, short_codes(P.extract_codes(F.col("text"))["icd_code"]).alias("pred")
    )
    rows = parsed.join(gold.select("hadm_id", short_codes("ICD_CODES").alias("gold")), "hadm_id", "left")
    space = label_space.select("code").distinct().withColumn("known", F.lit(True))
    codes = rows.select(*CANDIDATE_KEYS, "gold", F.posexplode_outer("pred").alias("pos", "code")).join(space, "code", "left")
    known = F.coalesce(F.col("known"), F.lit(False))
    sums = codes.groupBy(*CANDIDATE_KEYS).agg(
        F.count("code").alias("n_codes"), F.count_if(known).alias("n_pred"),
        F.count_if(known & F.array_contains("gold", F.col("code"))).alias("n_hit"),
        F.max(F.size("gold")).alias("n_gold"), F.count_if(F.coalesce(F.col("pos") == 0, F.lit(True))).alias("rows"),
    )
    p, r = ratio(F.col("n_hit"), F.col("n_pred")), ratio(F.col("n_hit"), F.col("n_gold"))
    repeated = F.raise_error(F.lit("candidates are not identified by their keys")).cast("double")
    score = F.when(F.col("rows") > 1, repeated).when(
        (F.col("n_codes") > 0) & F.col("n_gold").isNotNull(), F.round(harmonic(p, r), SCORE_DIGITS)
    )
    return sums.select(*CANDIDATE_KEYS, score.alias("score"))


def score_candidates(candidates: DataFrame, schemes: DataFrame, labels: DataFrame,
                     label_space: DataFrame, gold: DataFrame) -> DataFrame:
    """All stages; a candidate without a valid answer has a null score.

    The result holds keys and scores only: answers are parsed where they are
    read, and :func:`with_text` fetches the long texts of the winners.
    """
    return (
        score_findings(candidates.filter("stage = 1"), schemes, gold)
        .unionByName(score_diagnoses(candidates.filter("stage IN (2, 3)"), labels, gold))
        .unionByName(score_codes(candidates.filter("stage = 4"), label_space, gold))
    )


def with_text(best: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds the response text to selected candidates."""
    return best.join(candidates.select(*CANDIDATE_KEYS, "text"), CANDIDATE_KEYS)
