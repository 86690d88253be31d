"""Text quality with a sparse ensemble of rules.

Small boosted trees are grown on statistics of the labelled texts. Every path from a root
is a rule: a conjunction of bounds on statistics. A logistic model with an L1 penalty gives
most rules weight zero. What is left is compiled into one Spark column expression, so
scoring is a projection over statistics that Spark computes itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorefold.llm.common import filled, held_out, table
from scorefold.llm.labelled import training_rows
from scorefold.llm.registry import query

TREES = 60
DEPTH = 3
BINS = 32
RATE = 0.2
LEAST_ROWS = 8
PENALTY = 4e-4
Condition = tuple[str, str, float]


def _per(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all are finite, those of an empty text too."""
    n, tokens = F.length(text), F.split(F.trim(text), r"\s+")
    count, lines = F.size(tokens), F.split(text, "\n")
    drop = lambda signs: n - F.length(F.translate(text, signs, ""))
    lengths = F.transform(tokens, F.length)
    return {
        "log_chars": F.log1p(n.cast("double")),
        "upper": _per(F.regexp_count(text, F.lit(r"\p{Lu}")), n),
        "bangs": _per(drop("!"), count),
        "symbols": _per(drop("$%&#*"), count),
        "bars": _per(drop("|"), count),
        "digits": _per(drop("0123456789"), n),
        "stops": _per(drop("."), count),
        "commas": _per(drop(","), count),
        "distinct": _per(F.size(F.array_distinct(tokens)), count),
        "word_size": _per(n, count),
        "longest": F.coalesce(F.array_max(lengths), F.lit(0)).cast("double"),
        "short": _per(F.size(F.filter(lengths, lambda x: x <= 2)), count),
        "log_lines": F.log1p(F.size(lines).cast("double")),
        "same_lines": 1 - _per(F.size(F.array_distinct(lines)), F.size(lines)),
        "wide": _per(F.octet_length(text) - n, n),
    }


# The statistics, in the order of the feature matrix.
NAMES = [
    "log_chars", "upper", "bangs", "symbols", "bars", "digits", "stops", "commas", "distinct", "word_size", "longest",
    "short", "log_lines", "same_lines", "wide",
]


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    stats = statistics(F.col("__text"))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], filled(text).alias("__text"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[stats[k].cast("double").alias(f"__{k}") for k in NAMES])


@dataclass
class RuleModel:
    """Rules with their weights, and the constant."""

    rules: list[tuple[tuple[Condition, ...], float]]
    constant: float

    def score(self, column=lambda name: F.col(f"__{name}")) -> Column:
        """The score as a column expression over the statistics."""

        def holds(rule: tuple[Condition, ...]) -> Column:
            return reduce(lambda a, b: a & b, [column(n) <= x if op == "<=" else column(n) > x for n, op, x in rule])

        terms = [F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.constant))))


def tree_rules(X: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """Paths of boosted trees, as distinct conjunctions of bounds."""
    cuts = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) for x in X.T]
    binned = np.stack([np.searchsorted(c, x) for c, x in zip(cuts, X.T)], axis=1)
    margin, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}

    def grow(rows: np.ndarray, path: tuple[Condition, ...], g: np.ndarray, h: np.ndarray) -> None:
        best = (1e-6, -1, -1)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for f in range(X.shape[1]):
                b = binned[rows, f]
                n = np.cumsum(np.bincount(b, minlength=BINS))
                sg, sh = (np.cumsum(np.bincount(b, v[rows], BINS)) for v in (g, h))
                fits = (n >= LEAST_ROWS) & (len(rows) - n >= LEAST_ROWS)
                gain = np.where(fits, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        _, f, cut = best
        if f < 0:
            margin[rows] += RATE * total_g / (total_h + 1)
            return
        low = binned[rows, f] <= cut
        for side, op in ((low, "<="), (~low, ">")):
            step = (*path, (NAMES[f], op, float(cuts[f][cut])))
            found.setdefault(tuple(sorted(step)), None)
            grow(rows[side], step, g, h)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), (), y - p, p * (1 - p))
    return list(found)


def lasso(R: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and constant of an L1-penalised logistic fit by accelerated proximal steps."""
    scale = np.maximum(R.std(axis=0), 1e-3)
    Z = ((R - R.mean(axis=0)) / scale).astype(np.float32)
    step = 4 * len(y) / max(np.linalg.norm(Z.T @ Z, 2), 1e-9)
    w = ahead = np.zeros(Z.shape[1], np.float32)
    base = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    t = 1.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(Z @ ahead + base))) - y
        new = ahead - step * (Z.T @ miss.astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        base -= 4 * miss.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w / scale, float(base - (w / scale) @ R.mean(axis=0))


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", folds: int = 5) -> RuleModel:
    """Learn from a bounded number of labelled rows whose key is not held out."""
    rows = training_rows(df, labels, label, text, key, folds)
    seen = with_statistics(rows, "text", ["y"]).toPandas()
    if seen.y.nunique() < 2:
        rate = float(np.clip(seen.y.mean() if len(seen) else 0.5, 0.01, 0.99))
        return RuleModel([], float(np.log(rate / (1 - rate))))
    X, y = seen[[f"__{k}" for k in NAMES]].to_numpy(float), seen.y.to_numpy(float)
    rules = tree_rules(X, y)
    at = {k: i for i, k in enumerate(NAMES)}
    R = np.stack([np.all([X[:, at[n]] <= x if op == "<=" else X[:, at[n]] > x for n, op, x in rule], axis=0) for rule in rules], axis=1)
    weights, constant = lasso(R.astype(float), y)
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4], constant)


def score(df: DataFrame, model: RuleModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text if not named) and score, from 0 to 1.

    Null counts as the empty text; an empty text has a score too. Rows that repeat
    stay rows of their own.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    return with_statistics(df, text, keep).select(*[F.col(f"`{c}`") for c in keep], model.score().alias("score"))


@query("op3_quality")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
