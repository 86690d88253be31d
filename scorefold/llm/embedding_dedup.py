"""Near-duplicate vectors: spherical k-means cells, blocked cosines within cells.

Only vectors of one label are compared. Equal vectors are collapsed first. Each distinct
vector has a home cell, that of its nearest centre. It also visits every cell whose border
is no farther than two linked vectors can be apart; so each link is met in the home cell of
either end and no link is lost. The number of cells is the largest power of two at which a
sample of vectors stands in at most VISITS cells on average.

Cells are cut into blocks and each pair of blocks is one matrix product, so no cell is one
task. A product emits a count and one link to the smallest member per vector, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scorefold.llm.common import table
from scorefold.llm.components import components
from scorefold.llm.registry import query
from scorefold.session import cut_lineage

LEAST_COSINE = 0.98
SAMPLE = 20_000  # vectors that the centres are fitted on
MAX_CELLS = 1024
VISITS = 3.0
BLOCK = 4096
ROUNDS = 8


def unit(raw: pa.Array | list[bytes], dim: int) -> np.ndarray:
    """Rows of double precision with length one."""
    X = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    return X / np.linalg.norm(X, axis=1, keepdims=True)


def fit_centres(X: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spread rows."""
    centres = X[np.linspace(0, len(X) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        home = (X @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, X)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres


def cells_of(X: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each row, and which cells it stands in."""
    near = X @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[home]
    gap = near[np.arange(len(X)), home][:, None] - near
    return home, gap <= reach * apart + 1e-9


def choose_centres(X: np.ndarray, reach: float) -> np.ndarray:
    best = fit_centres(X, 1)
    cells = 2
    while cells <= min(MAX_CELLS, len(X) // 4):
        centres = fit_centres(X, cells)
        if cells_of(X, centres, reach)[1].sum(axis=1).mean() > VISITS:
            break
        best, cells = centres, cells * 2
    return best


def valid(vector: str) -> Column:
    """A vector with finite components that is not zero."""
    items = F.col(vector)
    finite = F.forall(items, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(items.isNotNull() & finite & F.exists(items, lambda x: x != 0), F.lit(False))


def _placed(rows: DataFrame, dim: int, centres: np.ndarray, reach: float) -> DataFrame:
    """A row for each cell a vector stands in: label, cell, home, id, w, v."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            X = unit(doubles(batch.column("vector"), dim), dim)
            home, stands = cells_of(X, shared.value, reach)
            row, cell = np.nonzero(stands)
            raw = [x.tobytes() for x in X]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(take), pa.array(cell, pa.int32()), pa.array(home[row] == cell),
                 batch.column("id").take(take), batch.column("w").take(take), pa.array([raw[r] for r in row], pa.binary())],
                ["label", "cell", "home", "id", "w", "v"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"label {kind}, cell int, home boolean, id long, w long, v binary")


def doubles(column: pa.Array, dim: int) -> list[bytes]:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    # Scaled by the largest component, so that squares neither overflow nor vanish.
    X = flat.reshape(-1, dim)
    return [x.tobytes() for x in X / np.abs(X).max(axis=1, keepdims=True)] if len(X) else []


def _compare(dim: int, least: float):
    def run(rows: pa.Table) -> pa.Table:
        X = unit(rows["v"].to_pylist(), dim)
        ids, w = rows["id"].to_numpy(), rows["w"].to_numpy()
        of_home, of_all = (np.flatnonzero(rows[c].to_numpy(zero_copy_only=False)) for c in ("h", "a"))
        links, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        low = rank.copy()
        other = X[of_all]
        for first in range(0, len(of_home), 512):
            part = of_home[first : first + 512]
            hits = X[part] @ other.T >= least
            hits &= part[:, None] != of_all[None, :]
            links[part] = hits @ w[of_all]
            for row in np.flatnonzero(hits.any(axis=1)):
                group = np.append(of_all[hits[row]], part[row])
                names = low[group]
                best = names.min()
                if (names != best).any():
                    low[np.isin(low, np.unique(names))] = best
        return pa.table({"id": ids, "links": links, "low": ids[order[low]]})

    return run


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """One row per vector: key, n_links, component_id (smallest key reachable), kept.

    Vectors that are null, zero or hold null or non-finite components, and those
    without a label or key, link with nothing and are their own component; a row
    without a key is not kept. Vectors of different lengths do not link. Rows that
    repeat count as vectors of their own. An empty table gives an empty table.
    """
    fine = valid(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(label).alias("label"), F.col(vector).alias("vector"), fine.alias("fine"))
    out = [rows.where("not fine").select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))]
    distinct = cut_lineage(
        rows.where("fine").groupBy("label", "vector").agg(F.min("k").alias("id"), F.count("*").alias("w")), "vectors"
    )
    for dim in sorted(r[0] for r in distinct.select(F.size("vector")).distinct().collect()):
        reps = distinct.where(F.size("vector") == dim)
        found, member = _links(reps, dim, least)
        whole = reps.join(found, "id", "left").join(member, F.col("id") == F.col("node"), "left").select(
            "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        whole = cut_lineage(whole, "settled")
        out.append(
            rows.where("fine").where(F.size("vector") == dim).join(whole, ["label", "vector"])
            .select(F.col("k").alias(key), "n_links", "component_id")
        )
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def _links(reps: DataFrame, dim: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) and (node, component) of distinct vectors of one length."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    sample = reps.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toArrow()
    centres = choose_centres(unit(doubles(sample["vector"].combine_chunks(), dim), dim), reach)
    placed = cut_lineage(_placed(reps, dim, centres, reach), "placed")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    at = F.sequence(F.lit(0), F.col("n") - 1)
    pair = lambda i, j, h, a: F.struct(i.alias("i"), j.alias("j"), h.alias("h"), a.alias("a"))
    as_all = F.transform(at, lambda k: pair(k, F.col("own"), F.col("home") & (k == F.col("own")), F.lit(True)))
    as_home = F.transform(F.filter(at, lambda k: k != F.col("own")), lambda k: pair(F.col("own"), k, F.lit(True), F.lit(False)))
    dealt = (
        placed.join(sizes, ["label", "cell"]).withColumn("own", own)
        .withColumn("p", F.explode(F.when(F.col("home"), F.concat(as_all, as_home)).otherwise(as_all)))
        .select("label", "cell", "p.i", "p.j", "p.h", "p.a", "id", "w", "v")
    )
    compared = dealt.groupBy("label", "cell", "i", "j").applyInArrow(_compare(dim, least), "id long, links long, low long")
    compared = cut_lineage(compared.where("links > 0 or id <> low"), "compared")
    found = compared.groupBy("id").agg(F.sum("links").alias("links"))
    return found, components(compared.select(F.col("id").alias("a"), F.col("low").alias("b")))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
u AS (SELECT vec_id, label, len(e) AS n, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v WHERE fine),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
found AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM v LEFT JOIN found ON found.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


@query("op6_embedding_dedup", SQL)
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return link(table(spark, sf_dir, "embeddings"))
