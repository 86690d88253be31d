"""Set metrics over gold and predicted codes.

The common form is a *pairs* table, one row per (keys, code) with ``is_gold``
and ``is_pred``; it is summed to a *counts* table per (group, code). Both
steps are plain aggregates with map-side partial sums, so a code or a system
that holds a third of all rows does not overload one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorefold.functions import codes as C
from scorefold.functions.binding import let
from scorefold.functions.scoring import (
    average_precision, compare_lists, f1, first_gold_hit, precision, ratio, recall,
)
from scorefold.operators import tallies as T
from scorefold.session import cut_lineage

# Strata as (name, fewest training admissions), high to low.
STRATA = [("head", 100), ("body", 10), ("tail", 0)]


def pairs_from_lists(df: DataFrame, keys: list[str], gold: Column, pred: Column) -> DataFrame:
    """Pairs of every row's lists, without a shuffle."""
    return df.select(*keys, F.inline(compare_lists(gold, pred)))


def distinct_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated (keys, code) rows merged into one pair."""
    return df.groupBy(*keys, "code").agg(
        F.bool_or("is_gold").alias("is_gold"), F.bool_or("is_pred").alias("is_pred")
    )


def code_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """tp / fp / fn per group and code."""
    return pairs.groupBy(*by, "code").agg(
        F.count_if(F.col("is_gold") & F.col("is_pred")).alias("tp"),
        F.count_if(~F.col("is_gold") & F.col("is_pred")).alias("fp"),
        F.count_if(F.col("is_gold") & ~F.col("is_pred")).alias("fn"),
    )


def with_total(counts: DataFrame, group: str, total: str = "All") -> DataFrame:
    """Adds the counts over all groups under the name ``total``.

    Counts add up per code, so the small counts table is repeated, not the rows.
    """
    other = [c for c in counts.columns if c not in (group, "tp", "fp", "fn")]
    both = counts.withColumn(group, F.explode(F.array(F.col(group), F.lit(total))))
    return both.groupBy(group, *other).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def label_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)}
    )


def micro_macro(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro and macro precision / recall / F1 over labels seen in gold or pred."""
    sums = label_scores(counts).groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        F.count("*").alias("n_labels"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        *by, "tp", "fp", "fn", "n_labels",
        precision(tp, fp).alias("precision_micro"), recall(tp, fn).alias("recall_micro"),
        f1(tp, fp, fn).alias("f1_micro"), "precision_macro", "recall_macro", "f1_macro",
    )


def vocabulary_of(pairs: DataFrame) -> DataFrame:
    """Codes that occur in gold."""
    return pairs.filter("is_gold").select("code").distinct()


def macro_over(counts: DataFrame, by: list[str], vocabulary: DataFrame) -> DataFrame:
    """Macro scores (percent) over an explicit vocabulary; absent labels score 0."""
    known = vocabulary.select("code").distinct()
    size = known.agg(F.count("*")).scalar()
    marked = label_scores(counts).join(known.withColumn("known", F.lit(True)), "code", "left")

    def mean(c: str) -> Column:
        return 100 * ratio(F.coalesce(F.sum(F.when(F.col("known"), F.col(c))), F.lit(0.0)), size)

    sums = marked.groupBy(*by).agg(*[mean(c).alias(c) for c in ("recall", "precision", "f1")])
    return sums


def training_frequency(notes: DataFrame, train_ids: DataFrame, codes: str = "ICD_CODES",
                       key: str = "hadm_id") -> DataFrame:
    """Training admissions per short code; one row per admission is used."""
    kept = notes.join(train_ids.select(key).distinct(), key, "left_semi")
    cut = C.trimmed_categories(codes)
    pairs = kept.select(key, F.explode(F.array_distinct(cut)).alias("code")).distinct()
    return pairs.groupBy("code").agg(F.count("*").alias("n_train"))


def stratum(n_train: Column) -> Column:
    out = F.lit(STRATA[-1][0])
    for name, low in reversed(STRATA):
        out = F.when(n_train >= low, name).otherwise(out)
    return out


def stratum_composition(frequency: DataFrame) -> DataFrame:
    """Codes and share of all occurrences per stratum."""
    per = frequency.groupBy(stratum(F.col("n_train")).alias("stratum")).agg(
        F.count("*").alias("n_codes"), F.sum("n_train").alias("occurrences")
    )
    total = frequency.agg(F.sum("n_train")).scalar()
    return per.withColumn("share_pct", 100 * ratio(F.col("occurrences"), total))


def strata_scores(counts: DataFrame, frequency: DataFrame, by: list[str]) -> DataFrame:
    """Mean F1 and pooled recall (percent) of gold labels per training stratum.

    Every group gets one row per stratum, with zeros where it has no label.
    """
    joined = (
        label_scores(counts.filter((F.col("tp") + F.col("fn")) > 0))
        .join(frequency, "code", "left")
        .withColumn("stratum", stratum(F.coalesce("n_train", F.lit(0))))
    )
    cells = []
    for name, _ in STRATA:
        here = F.col("stratum") == name
        gold = F.sum(F.when(here, F.col("tp") + F.col("fn")))
        cells.append(
            F.struct(
                F.lit(name).alias("stratum"),
                (100 * F.coalesce(F.avg(F.when(here, F.col("f1"))), F.lit(0.0))).alias("f1"),
                (100 * ratio(F.sum(F.when(here, F.col("tp"))), gold)).alias("recall"),
                F.count_if(here).alias("n_labels"),
            )
        )
    wide = joined.groupBy(*by).agg(F.array(*cells).alias("cells"))
    return wide.select(*by, F.inline("cells"))


def _pooled(common: Column, gold: Column, pred: Column, suffix: str) -> list[Column]:
    tp, g, p = F.sum(common), F.sum(gold), F.sum(pred)
    r, q = ratio(tp, g), ratio(tp, p)
    return [
        r.alias(f"recall{suffix}"), q.alias(f"precision{suffix}"),
        ratio(2 * q * r, q + r).alias("micro_f1" if not suffix else f"f1{suffix}"),
    ]


def error_rates(df: DataFrame, by: list[str], gold: str = "ICD_CODES", pred: str = "v4_preds") -> DataFrame:
    """Pooled and per-family P/R/F1 and case rates, in one pass per group."""
    empty = F.array().cast("array<string>")
    rows = df.select(
        *by,
        F.coalesce(C.trimmed_categories(gold), empty).alias("gold_list"),
        F.coalesce(C.trimmed_categories(pred), empty).alias("pred_list"),
    ).select(
        "*",
        F.array_distinct("gold_list").alias("g"),
        F.array_distinct("pred_list").alias("p"),
        F.get("gold_list", F.lit(0)).alias("primary"),
    )
    g, p = F.col("g"), F.col("p")
    fp = F.array_except(p, g)

    def rate(flag: Column, name: str) -> Column:
        return F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias(name)

    primary_rank = F.array_position(p, F.col("primary"))
    metrics = [F.count("*").alias("n")]
    metrics += _pooled(F.size(F.array_intersect(g, p)), F.size(g), F.size(p), "")
    for name, member in C.FAMILIES.items():
        fg, fpred = F.filter(g, member), F.filter(p, member)
        metrics += _pooled(F.size(F.array_intersect(fg, fpred)), F.size(fg), F.size(fpred), f"_{name}")
        metrics.append(rate(F.size(F.array_except(fg, p)) > 0, f"missed_{name}"))
    metrics += [
        rate(primary_rank == 0, "missed_primary"),
        rate(F.size(F.array_except(g, p)) > 0, "missed_any"),
        rate(F.exists(fp, C.is_symptom), "symptom_fp"),
        rate(F.size(p) > F.size(g), "extra_codes"),
        rate(F.size("pred_list") != F.size(p), "duplicate_subcodes"),
        rate(F.size(fp) > 0, "hallucinated_fp"),
    ]
    metrics += [rate(primary_rank.between(1, k), f"recall_primary_at_{k}") for k in (1, 2, 3)]
    out = rows.groupBy(*by).agg(*metrics)
    return out.withColumn("recall_primary", 1 - F.col("missed_primary"))


def _specificity_sums(gold: Column, pred: Column) -> list[Column]:
    covered = let(
        C.short_codes(pred),
        lambda categories: F.filter(gold, lambda c: F.array_contains(categories, C.short_code(c))),
    )
    return [
        F.sum(F.size(F.array_intersect(gold, pred))).alias("cat_hit_exact"),
        F.sum(F.size(covered)).alias("covered"),
    ]


def _with_specificity(sums: DataFrame) -> DataFrame:
    exact, n = F.col("cat_hit_exact"), F.col("covered")
    return sums.withColumns(
        {"specificity_given_cat_hit": ratio(exact, n), "cat_hit_inexact": n - exact}
    ).drop("covered")


def specificity(df: DataFrame, by: list[str], gold: Column, pred: Column) -> DataFrame:
    """Share of gold codes predicted exactly among those whose category was predicted."""
    return _with_specificity(df.groupBy(*by).agg(*_specificity_sums(gold, pred)))


def _invalid_rate(raw: Column) -> Column:
    share = ratio(F.sum(C.invalid_entry_count(raw)), F.sum(C.raw_entry_count(raw)))
    return share.alias("invalid_token_rate")


def invalid_token_rate(df: DataFrame, by: list[str], raw: Column) -> DataFrame:
    """Share of raw entries that hold no valid code."""
    return df.groupBy(*by).agg(_invalid_rate(raw))


def full_code_scores(df: DataFrame, by: list[str], gold: str = "ICD_CODES", raw: str = "raw_codes") -> DataFrame:
    """Micro and macro scores at both levels, specificity and invalid share, per group, in one pass."""
    rows = df.select(*by, C.gold_full_codes(gold).alias("g"), C.full_codes(raw).alias("p"), F.col(raw).alias("r")).select(
        "*", C.short_codes("g").alias("gs"), C.short_codes("p").alias("ps")
    )
    covered = F.filter("g", lambda c: F.array_contains(F.col("ps"), C.short_code(c)))
    numbers = {
        "exact": F.size(F.array_intersect("g", "p")), "covered": F.size(covered),
        "invalid": C.invalid_entry_count(F.col("r")), "entries": C.raw_entry_count(F.col("r")),
    }
    parts = T.tallies(rows, by, numbers, {"category": (F.col("gs"), F.col("ps")), "full": (F.col("g"), F.col("p"))})
    exact, n = T.total("exact").cast("bigint"), T.total("covered").cast("bigint")
    levels = {f"{name}_{lvl}": c for lvl in ("category", "full") for name, c in T.label_metrics(lvl).items() if name not in T.FLAGS}
    return parts.groupBy(*by).agg(
        T.count_rows().alias("n"), exact.alias("cat_hit_exact"), ratio(T.total("invalid"), T.total("entries")).alias("invalid_token_rate"),
        ratio(exact, n).alias("specificity_given_cat_hit"), (n - exact).alias("cat_hit_inexact"), *[c.alias(name) for name, c in levels.items()],
    )


def rank_scores(df: DataFrame, by: list[str], gold: Column, pred: Column, top_n: int = 20) -> DataFrame:
    """MAP over the first ``top_n``, first-label accuracy (percent) and list length."""
    return df.groupBy(*by).agg(
        (100 * F.coalesce(F.avg(average_precision(pred, gold, top_n)), F.lit(0.0))).alias("map_at_n"),
        (100 * F.avg(first_gold_hit(pred, gold))).alias("md_acc"),
        F.avg(F.coalesce(F.size(pred), F.lit(0))).alias("codes_per_adm"),
    )


def score_systems(df: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred",
                  top_n: int = 20, vocabulary: DataFrame | None = None) -> DataFrame:
    """One scorecard row per group: macro over a shared vocabulary, micro F1, MAP, accuracy.

    Without a vocabulary the gold codes of the table are used.
    """
    g, p = F.col(gold), F.col(pred)
    numbers = {"map": average_precision(p, g, top_n), "first": first_gold_hit(p, g), "size": F.size(p)}
    numbers |= {f"{n}_seen": numbers[n].isNotNull().cast("int") for n in ("map", "first")}
    # One row per system and code, and one per system; written once because three steps read it.
    parts = cut_lineage(T.tallies(df, by, numbers, {"codes": (g, p)}), "tallies")
    if vocabulary is None:
        vocabulary = parts.filter((F.col("kind") == "codes") & ((F.col("tp") + F.col("fn")) > 0)).select("code")
    known = vocabulary.select("code").distinct()
    size = known.agg(F.count("*")).scalar()
    marked = parts.join(known.withColumn("known", F.lit(True)), "code", "left")
    in_space = (F.col("kind") == "codes") & F.col("known")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def macro(c: Column) -> Column:
        return 100 * ratio(F.coalesce(F.sum(F.when(in_space, c)), F.lit(0.0)), size)

    def seen(name: str) -> Column:
        return F.try_divide(T.total(name), T.total(f"{name}_seen"))

    codes = T.label_metrics("codes")
    some = F.count_if(F.col("kind") == "codes") > 0
    return marked.groupBy(*by).agg(
        (100 * F.coalesce(seen("map"), F.lit(0.0))).alias("map_at_n"), (100 * seen("first")).alias("md_acc"),
        T.mean("size").alias("codes_per_adm"),
        *[F.when(some, macro(c)).alias(n) for n, c in (("recall", recall(tp, fn)), ("precision", precision(tp, fp)), ("f1", f1(tp, fp, fn)))],
        (100 * F.round(codes["f1_micro"], 4)).alias("micro_f1"),
    )


def align_to_reference(systems: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Every system's rows for the reference ids, with the gold list of the reference."""
    return systems.drop("gold").join(reference.select(key, "gold"), key)


def code_lists(rows: DataFrame, keys: list[str], code: str, gold_order: Column, pred_order: Column,
               is_gold: Column, is_pred: Column, near: list[str] | None = None) -> DataFrame:
    """Ordered gold and predicted lists per key from one row per (key, code).

    ``near`` names keys of which all lists stay in one partition, so that a later join or
    window by them needs no shuffle of its own.

    Repeated codes are reduced to their best place first, so a list never has
    more entries than there are codes.
    """
    best = rows.groupBy(*keys, code).agg(
        F.min(F.when(is_gold, gold_order)).alias("g"), F.min(F.when(is_pred, pred_order)).alias("p")
    )

    def ordered(place: str) -> Column:
        own = F.filter("entries", lambda e: e[place].isNotNull())
        return F.transform(F.sort_array(F.transform(own, lambda e: F.struct(e[place].alias("o"), e["c"].alias("c")))), lambda e: e["c"])

    placed = best.repartition(*near) if near else best
    lists = placed.groupBy(*keys).agg(F.collect_list(F.struct("g", "p", F.col(code).alias("c"))).alias("entries"))
    return lists.select(*keys, ordered("g").alias("gold"), ordered("p").alias("pred"))
