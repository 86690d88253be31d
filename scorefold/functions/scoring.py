"""Row scores: set, rank and vector agreement."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scorefold.functions.binding import let


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` and 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def no_nan(score: Column) -> Column:
    """NaN sorts above every number in Spark, so a missing score is null here."""
    return F.when(~F.isnan(score), score)


def harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return harmonic(precision(tp, fp), recall(tp, fn))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def nonzero_count(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0))


def norm_dot(pred: Column, label: Column, empty: float = 0.5) -> Column:
    """``(p.l + k) / 2k`` with k non-zero label entries.

    Unequal lengths score 0, a label without entries scores ``empty``, a null
    prediction has no score.
    """

    def score(v: Column) -> Column:
        p, truth = v["p"], v["l"]
        k = nonzero_count(truth).cast("double")
        return (
            F.when(p.isNull() | truth.isNull(), F.lit(None).cast("double"))
            .when(F.size(p) != F.size(truth), F.lit(0.0))
            .when(k == 0, F.lit(float(empty)))
            .otherwise((dot(p, truth) + k) / (2 * k))
        )

    return let(F.struct(pred.alias("p"), label.alias("l")), score)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector is all zero."""
    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda v: ratio(
            dot(v["a"], v["b"]), F.sqrt(dot(v["a"], v["a"])) * F.sqrt(dot(v["b"], v["b"]))
        ),
    )


def zero_filled(pred: Column, label: Column) -> Column:
    """A missing prediction becomes zeros of the label's length."""
    return F.coalesce(pred, F.transform(label, lambda _: F.lit(0)))


def reciprocal_rank(pred: Column, truth: Column) -> Column:
    return ratio(F.lit(1.0), F.array_position(pred, truth))


def hit_at(pred: Column, truth: Column, k: int) -> Column:
    """1 when ``truth`` is among the first k predictions, else 0."""
    rank = F.coalesce(F.array_position(pred, truth), F.lit(0))
    return rank.between(1, k).cast("int")


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of the common items over the two list lengths; null answers stay null."""
    common = F.size(F.array_intersect(pred, gold))
    p, r = ratio(common, F.size(pred)), ratio(common, F.size(gold))
    return F.when(pred.isNotNull(), harmonic(p, r))


def average_precision(pred: Column, gold: Column, top_n: int | None = None) -> Column:
    """Average precision over the first ``top_n`` ranks divided by the gold size.

    Null where gold is empty, so that ``avg`` skips the row.
    """

    def score(relevant: Column) -> Column:
        ranked = F.slice(pred, 1, top_n) if top_n else pred
        ranks = F.filter(
            F.transform(ranked, lambda c, i: F.when(F.array_contains(relevant, c), i + 1)),
            lambda r: r.isNotNull(),
        )
        gains = F.transform(ranks, lambda r, j: (j + 1).cast("double") / r.cast("double"))
        size = F.size(relevant)
        return F.when(size > 0, F.coalesce(_sum(gains), F.lit(0.0)) / size)

    return let(F.array_distinct(gold), score)


def first_gold_hit(pred: Column, gold: Column) -> Column:
    """1 when the first gold item was predicted at any rank, else 0."""
    hit = F.array_contains(pred, F.get(gold, F.lit(0)))
    return F.coalesce(hit, F.lit(False)).cast("int")


def position_of(items: Column, item: Column) -> Column:
    """0-based position, -1 where absent or null."""
    return F.coalesce(F.array_position(items, item) - 1, F.lit(-1)).cast("int")


def match_category(a: Column, b: Column) -> Column:
    """0 exact, 1 near, 2 fuzzy, 3 other, -1 where a rank is missing."""
    return (
        F.when(F.least(a, b) < 0, -1)
        .when(F.greatest(a, b) <= 2, F.greatest(a, b))
        .otherwise(3)
        .cast("int")
    )


def rank_bucket(rank: Column, k: int = 5) -> Column:
    return (
        F.when(rank == -1, F.lit("-1"))
        .when(rank.between(0, k - 1), rank.cast("int").cast("string"))
        .otherwise(F.lit(f"{k}+"))
    )


def bucket_order(bucket: Column) -> Column:
    """Sort key that puts -1 first and ``k+`` last."""
    return F.regexp_replace(bucket, r"\+", "999").cast("int")


def percent(value: Column, digits: int = 2) -> Column:
    return F.round(value * 100, digits)


def mean_of(columns: list[Column]) -> Column:
    """Mean of the non-null values of a row; null when all are null."""
    kept = F.array_compact(F.array(*[c.cast("double") for c in columns]))
    return F.when(F.size(kept) > 0, _sum(kept) / F.size(kept))


def _marked(items: Column, gold: bool, pred: bool) -> Column:
    return F.transform(
        items,
        lambda c: F.struct(
            c.alias("code"), F.lit(gold).alias("is_gold"), F.lit(pred).alias("is_pred")
        ),
    )


def compare_lists(gold: Column, pred: Column) -> Column:
    """Distinct codes of either list with their two flags."""
    empty = F.array().cast("array<string>")
    both = F.struct(F.coalesce(gold, empty).alias("g"), F.coalesce(pred, empty).alias("p"))
    return let(
        both,
        lambda v: F.concat(
            _marked(F.array_intersect(v["g"], v["p"]), True, True),
            _marked(F.array_except(v["g"], v["p"]), True, False),
            _marked(F.array_except(v["p"], v["g"]), False, True),
        ),
    )
