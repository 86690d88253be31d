"""The full scorecard of many runs in one pass over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorefold.functions import parsing as P
from scorefold.functions.codes import short_codes
from scorefold.functions.scoring import hit_at, reciprocal_rank
from scorefold.operators import rank_metrics as RM, tallies as T

RATES = {"v1_json_valid": "v1_json", "v2_json_valid": "v2_json", "v4_json_valid": "v4_json"}


def parsed_results(results: DataFrame, shorten_predictions: bool = False) -> DataFrame:
    """Stored results with real arrays; gold codes are shortened, predictions on request."""
    codes = P.parse_list(F.col("v4_preds"))
    return results.withColumns(
        {
            "vector_pred": P.parse_vector(F.col("v1_preds")),
            "name_pred": P.parse_list(F.col("v2_preds")),
            "code_pred": short_codes(codes) if shorten_predictions else codes,
            "code_gold": short_codes("ICD_CODES"),
        }
    )


VECTORS = ("cos_sim", "dot_product")
LENGTHS = ("code_len", "code_label_len")


def scorecard_tallies(rows: DataFrame, by: list[str]) -> DataFrame:
    """All that a scorecard needs, as additive tallies; vector sums stand per label length."""
    name_pred, disease = F.col("name_pred"), F.col("disease")
    filled = RM.zero_filled(F.col("vector_pred"), F.col("disease_vector"))
    scored = rows.withColumns({
        "cos_sim": RM.cosine(filled, F.col("disease_vector")), "dot_product": RM.norm_dot(filled, F.col("disease_vector"), empty=0.0),
    })
    numbers = {
        "mrr": reciprocal_rank(name_pred, disease),
        **{f"recall_at_{k}": hit_at(name_pred, disease, k) for k in RM.RECALL_KS},
        **{name: P.is_valid_cell(F.col(c)).cast("int") for name, c in RATES.items() if c in rows.columns},
        "code_len": F.size("code_pred"), "code_label_len": F.size("code_gold"),
        **{n: F.col(n) for n in VECTORS}, **{f"{n}_seen": F.col(n).isNotNull().cast("int") for n in VECTORS},
    }
    first = F.coalesce(F.get(name_pred, F.lit(0)), F.lit(""))
    lists = {"codes": (F.col("code_gold"), F.col("code_pred")), "first": (F.filter(F.array(disease), lambda x: x.isNotNull()), F.array(first))}
    return T.tallies(scored, by, numbers, lists, F.size("disease_vector"))


def scorecard_of(parts: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """The scorecard (percent) from merged tallies, in one aggregate."""
    codes, first = T.label_metrics("codes"), T.label_metrics("first")
    names = [c for c in parts.columns if c not in (*by, *T.KEYS, "n", *T.FLAGS, *VECTORS, *[f"{n}_seen" for n in VECTORS])]
    metrics = {n: T.mean(n) for n in names}
    metrics |= {n: T.bucket_mean(n, f"{n}_seen", RM.GROUP_DIGITS) for n in VECTORS}
    metrics |= {f"{m}_{a}": codes[f"{m}_{a}"] for a in ("micro", "macro") for m in ("precision", "recall", "f1")}
    metrics |= {f"f1_{a}_at_1": first[f"f1_{a}"] for a in ("micro", "macro")}

    def shown(c: str) -> Column:
        if c in LENGTHS:
            return F.round(F.col(c), 2).alias(c)
        return F.round(F.round(F.col(c), 4) * 100, digits).alias(c)

    out = parts.groupBy(*by).agg(T.count_rows().alias("n_samples"), *[c.alias(n) for n, c in metrics.items()])
    return out.select(*by, *[shown(c) for c in metrics], "n_samples")


def scorecard(rows: DataFrame, by: list[str], digits: int = 2) -> DataFrame:
    """Code, diagnosis, vector and validity metrics (percent) with the sample count.

    The rows are read once, whatever the number of metrics. A row without disease has
    no gold entry for the first diagnosis; vector means are rounded per label length.
    """
    return scorecard_of(scorecard_tallies(rows, by), by, digits)


def per_complaint(rows: DataFrame, by: list[str], complaint: str = "chief_complaint", total: str = "All") -> DataFrame:
    """Counts, vector agreement, recall@1/3 and code F1 per complaint and over all of them.

    The macro label set belongs to each group. Tallies are added up for the total;
    the rows are read once and not repeated.
    """
    group = [*by, complaint]
    filled = RM.zero_filled(F.col("vector_pred"), F.col("disease_vector"))
    numbers = {"dot": RM.norm_dot(filled, F.col("disease_vector"), empty=0.0),
               **{f"hit_{k}": RM.hit_at(F.col("name_pred"), F.col("disease"), k) for k in (1, 3)}}
    parts = T.tallies(rows, group, numbers, {"codes": (F.col("code_gold"), F.col("code_pred"))})
    codes = T.label_metrics("codes")
    shown = {"dot_product": T.mean("dot"), "recall_at_1": T.mean("hit_1"), "recall_at_3": T.mean("hit_3"),
             "f1_micro": codes["f1_micro"], "f1_macro": codes["f1_macro"]}
    return T.with_total(parts, group, complaint, total).groupBy(*group).agg(
        T.count_rows().alias("n"), *[F.round(100 * c, 1).alias(n) for n, c in shown.items()]
    )
