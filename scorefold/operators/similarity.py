"""Similarity ranking of rows against a label vocabulary.

Items and labels are gathered in blocks of about BLOCK vectors per group, by the hash of
their keys. Each block of items meets each block of labels of its group in one matrix
product; no size of the vocabulary or of a group changes the plan. The sorted part lists
of an item are merged at the end. Python sees keys and vectors only; other columns are
joined back by the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK = 512  # vectors in a block, about
SPREAD = 32  # blocks of items that meet one copy of a label block

GROUP, ITEM, LABEL, COPY = "_group", "_item_block", "_label_block", "_copy"


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors; a missing vector is zero, as is a missing number."""
    out = np.zeros((len(vectors), width))
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    rows = np.repeat(np.arange(len(vectors)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = np.asarray(vectors.flatten().fill_null(0.0))
    return _unit(out)


def _blocks(rows: DataFrame, sizes: DataFrame, block: str, tie: Column, payload: list[str]) -> DataFrame:
    """Rows gathered as (group, block, list of payloads in their order); ``sizes`` holds the number of blocks of each group.

    Blocks of equal rows are equal, and so are their products, to the last bit.
    """
    placed = rows.join(sizes, GROUP).withColumn(block, F.pmod(tie, F.col(f"{block}s")).cast("int"))
    return placed.groupBy(GROUP, block).agg(F.sort_array(F.collect_list(F.struct(*payload))).alias(f"{block}_rows"))


def _sizes(rows: DataFrame, block: str) -> DataFrame:
    return rows.groupBy(GROUP).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{block}s"))


def _met(items: DataFrame, labels: DataFrame, keys: list[str], group: str | None, extra: list[str]) -> DataFrame:
    """Every block of items next to every block of labels of its group.

    A frequent group is spread: its label blocks are copied once for each SPREAD blocks
    of items, so that no key of the join holds more than about SPREAD of them.
    """
    # Without groups all rows are of group 0. The condition always holds; it keeps a constant
    # group from being folded away, so that the joins stay equi joins.
    name = F.lit(0) if group is None else F.col(group)
    by, other_by = (F.when(F.pmod(F.hash(*c), F.lit(1)) == 0, name) for c in (keys, ["pos", "label"]))
    double = "array<double>"
    own = items.select(by.alias(GROUP), F.struct(*keys).alias("key"), F.col("embedding").cast(double).alias("vector"), *extra).where(F.col(GROUP).isNotNull())
    other = labels.select(other_by.alias(GROUP), "pos", "label", F.col("embedding").cast(double).alias("vector")).where(F.col(GROUP).isNotNull())
    item_sizes, label_sizes = _sizes(own, ITEM), _sizes(other, LABEL)
    item_blocks = _blocks(own, item_sizes, ITEM, F.xxhash64("key"), ["key", "vector", *extra])
    label_blocks = _blocks(other, label_sizes, LABEL, F.xxhash64("pos", "label"), ["pos", "label", "vector"])
    copies = item_sizes.select(GROUP, F.ceil(F.col(f"{ITEM}s") / SPREAD).cast("int").alias("copies"))
    copied = label_blocks.join(copies, GROUP).withColumn(COPY, F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    meeting = (
        item_blocks.join(label_sizes, GROUP).join(copies, GROUP)
        .withColumn(COPY, F.pmod(F.col(ITEM), F.col("copies")))
        .withColumn(LABEL, F.explode(F.sequence(F.lit(0), F.col(f"{LABEL}s") - 1)))
        .drop("copies", f"{LABEL}s")
    )
    return meeting.join(copied, [GROUP, LABEL, COPY]).select(f"{ITEM}_rows", f"{LABEL}_rows")


def _products(met: DataFrame, out: T.StructType, part: Callable[[pa.StructArray, pa.StructArray, np.ndarray], Iterator[list[pa.Array]]]) -> DataFrame:
    """One matrix product for each pair of blocks; ``part`` turns the similarities into columns."""
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                items, labels = batch.column(0)[row].values, batch.column(1)[row].values
                vectors = [x.field("vector") for x in (items, labels)]
                width = max((int(np.asarray(v.value_lengths().fill_null(0)).max(initial=0)) for v in vectors), default=0)
                a, b = (_matrix(v, width) for v in vectors)
                for columns in part(items, labels, a @ b.T):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return met.mapInArrow(run, out)


def _key_schema(items: DataFrame, keys: list[str]) -> T.StructField:
    return T.StructField("key", T.StructType([items.schema[k] for k in keys]))


def _order(labels: pa.StructArray) -> np.ndarray:
    """Labels by place, then name: the order among equal similarities."""
    return np.lexsort((np.array(labels.field("label").to_pylist(), object).astype(str), np.asarray(labels.field("pos"))))


def _sorted_parts(items: pa.StructArray, labels: pa.StructArray, sims: np.ndarray) -> Iterator[list[pa.Array]]:
    tie = _order(labels)
    order = tie[np.argsort(-sims[:, tie], axis=1, kind="stable")]
    at = pa.array(order.ravel())
    entries = pa.StructArray.from_arrays(
        [pa.array(-np.take_along_axis(sims, order, axis=1).ravel()), labels.field("pos").take(at).cast(pa.int64()), labels.field("label").take(at)],
        ["s", "pos", "label"],
    )
    offsets = np.arange(len(items) + 1, dtype=np.int32) * sims.shape[1]
    yield [items.field("key"), pa.ListArray.from_arrays(pa.array(offsets), entries)]


def _best_parts(items: pa.StructArray, labels: pa.StructArray, sims: np.ndarray) -> Iterator[list[pa.Array]]:
    tie = _order(labels)
    at = tie[np.argmax(sims[:, tie], axis=1)]
    yield [
        items.field("key"), pa.array(-sims[np.arange(len(items)), at]), labels.field("pos").take(pa.array(at)).cast(pa.int64()),
        labels.field("label").take(pa.array(at)),
    ]


def _unique(items: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Results by key next to their items; stops where a key stands for several items."""
    return items.join(found.select("key.*", *[c for c in found.columns if c != "key"]), keys, "left")


def _refuse(n: Column, value: Column, kind: str) -> Column:
    return F.when(n <= 1, value).otherwise(F.raise_error(F.lit("items are not identified by their keys")).cast(kind))


def rank_labels(items: DataFrame, labels: DataFrame, keys: list[str], group: str | None = None) -> DataFrame:
    """All labels of the row's group by falling cosine, with scores and the best one.

    ``items`` holds ``keys``, the group and an ``embedding``; ``labels`` holds the group,
    ``pos`` (a whole number), ``label`` and an ``embedding``. Ties go to the smaller ``pos``.
    ``keys`` identify an item and are not null. An item or label without embedding scores
    0; an item whose group is null or has no labels has no list.
    """
    schema = T.StructType([
        _key_schema(items, keys),
        T.StructField("part", T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("pos", T.LongType()), T.StructField("label", T.StringType())]))),
    ])
    parts = _products(_met(items, labels, keys, group, []), schema, _sorted_parts)
    # Sorting a few sorted runs is a merge. A label stands in one part of an item, so repeats mean repeated keys.
    whole = parts.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("r"))
    n = F.size(F.filter("r", lambda e: (e["pos"] == F.get("r", F.lit(0))["pos"]) & e["label"].eqNullSafe(F.get("r", F.lit(0))["label"])))
    ranked = whole.select(
        "key", _refuse(n, F.col("r.label"), "array<string>").alias("diseases"), F.transform("r", lambda e: -e["s"]).alias("diseases_cossim_scores")
    )
    return _unique(items.drop("embedding"), ranked, keys).withColumn("disease", F.get("diseases", F.lit(0)))


def best_label(items: DataFrame, labels: DataFrame, keys: list[str], group: str | None = None) -> DataFrame:
    """``disease`` and ``best_score`` only: the first of ``rank_labels``, without its lists."""
    schema = T.StructType([_key_schema(items, keys), T.StructField("s", T.DoubleType()), T.StructField("pos", T.LongType()), T.StructField("label", T.StringType())])
    parts = _products(_met(items, labels, keys, group, []), schema, _best_parts)
    best = parts.groupBy("key").agg(F.min(F.struct("s", "pos", "label")).alias("b"))
    return _unique(items.drop("embedding"), best.select("key", F.col("b.label").alias("disease"), (-F.col("b.s")).alias("best_score")), keys)


def label_position(items: DataFrame, labels: DataFrame, keys: list[str], wanted: str, group: str | None = None) -> DataFrame:
    """``position``: the place of the label named by column ``wanted`` in ``rank_labels``, from 1, without its lists.

    Null where the group has no such label. A first round of products gives the
    similarity of the wanted label, a second one counts the labels before it.
    """
    key = _key_schema(items, keys)
    place = T.StructType([key, T.StructField("s", T.DoubleType()), T.StructField("pos", T.LongType())])

    def of_wanted(own: pa.StructArray, other: pa.StructArray, sims: np.ndarray) -> Iterator[list[pa.Array]]:
        names = own.field("wanted").to_pylist()
        at = {}
        for k in _order(other).tolist():
            at.setdefault(other.field("label")[k].as_py(), k)
        rows = [k for k, name in enumerate(names) if name is not None and name in at]
        cols = [at[names[k]] for k in rows]
        yield [own.field("key").take(pa.array(rows, pa.int64())), pa.array(sims[rows, cols]), other.field("pos").take(pa.array(cols, pa.int64())).cast(pa.int64())]

    named = items.withColumn("wanted", F.col(wanted))
    met = _met(named, labels, keys, group, ["wanted"])
    # Of several labels of the wanted name the first in the ranking counts.
    first = _products(met, place, of_wanted).groupBy("key").agg(F.min(F.struct((-F.col("s")).alias("s"), "pos")).alias("at"))
    known = first.select("key.*", (-F.col("at.s")).alias("wanted_s"), F.col("at.pos").alias("wanted_pos"))
    joined = items.join(known, keys, "left")

    def before(own: pa.StructArray, other: pa.StructArray, sims: np.ndarray) -> Iterator[list[pa.Array]]:
        s, pos = np.asarray(own.field("wanted_s"))[:, None], np.asarray(own.field("wanted_pos"))[:, None]
        places = np.asarray(other.field("pos"))[None, :]
        yield [own.field("key"), pa.array(((sims > s) | ((sims == s) & (places < pos))).sum(axis=1))]

    counted = _products(
        _met(joined, labels, keys, group, ["wanted_s", "wanted_pos"]), T.StructType([key, T.StructField("n", T.LongType())]), before
    ).groupBy("key").agg((F.sum("n") + 1).alias("position"))
    # Items without a wanted label took part, so that both rounds have the same blocks.
    counted = counted.join(first.select("key"), "key", "left_semi")
    return _unique(items.drop("embedding"), counted, keys)


def rank_scored(scores: DataFrame, keys: list[str], score: str = "score", tie: str = "pos") -> DataFrame:
    """1-based rank of already scored (key, label) rows."""
    window = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(window))


def snap_names(names: DataFrame, labels: DataFrame, name_embeddings: DataFrame, group: str = "chief_complaint") -> DataFrame:
    """Vocabulary label of every distinct (group, name): the name itself, else the nearest.

    ``name_embeddings`` holds (name, embedding) for names outside the vocabulary.
    """
    distinct = names.select(group, "name").distinct()
    known = labels.select(group, F.col("label").alias("name")).distinct()
    exact = distinct.join(known, [group, "name"], "left_semi").withColumn("label", F.col("name"))
    free = distinct.join(known, [group, "name"], "left_anti").join(name_embeddings, "name", "left")
    found = free.select(group, "name", "embedding", F.col("embedding").isNotNull().alias("known"))
    nearest = best_label(found, labels, [group, "name"], group)
    return exact.unionByName(nearest.select(group, "name", F.when(F.col("known"), F.col("disease")).alias("label")))
