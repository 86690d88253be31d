"""Ranked lexical search with Block-Max MaxScore.

``build`` cuts the documents into shards and writes one inverted index for each: sorted
terms, posting lists in blocks of BLOCK postings, and for each block its last document,
its highest term frequency and its shortest document, which bound the block's part of a
score once the numbers of the corpus are known.

``search`` sends queries in bounded blocks to all shards. For one query and shard the
lists are ordered by their largest block bound. Lists whose bounds together cannot reach
the tenth score so far are non-essential: only documents of the other lists are
candidates. Candidates are then checked against the block bounds of the non-essential
lists, and only blocks that still hold a candidate are decompressed. Documents are
taken in windows, so that later windows profit from the scores of earlier ones. The best
documents of each shard are merged by a ranking window.

All scores are exact integers; bounds are never below a score, and a document is
rejected only if its bound is below the tenth score, never on a tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from scorefold.llm.common import bounded, buffers, filled, ranges, table
from scorefold.llm.katz_lm import pack, unpack
from scorefold.llm.registry import query
from scorefold.llm.terms import ALPHANUMERIC, terms, unified
from scorefold.session import cut_lineage, shared_dir

BLOCK = 128  # postings
SHARD_POSTINGS = 2_000_000  # a shard is closed when it holds so many
TOP = 10
SCALE = 1_000_000_000
WINDOW = 2_048  # documents scored together
QUERY_BYTES = 2 << 20  # of query texts sent to the shards at once

INDEX = "shard bigint, n_docs bigint, n_terms bigint, names binary, name_sizes binary, df binary, keys binary, lengths binary, blocks binary, postings binary"
INDEX_NAMES = [f.split()[0] for f in INDEX.split(", ")]
NO_KEY = -(2**63)  # stands for a null key


# ---------------------------------------------------------------- index

def block_sizes(df: np.ndarray) -> np.ndarray:
    """Postings of each block of lists of the given sizes; only the last block of a list is not full."""
    each = -(-df // BLOCK)
    sizes = np.full(int(each.sum()), BLOCK, np.int64)
    ends = np.cumsum(each) - 1
    sizes[ends[each > 0]] = (df - (each - 1) * BLOCK)[each > 0]
    return sizes


def widths(largest: np.ndarray) -> np.ndarray:
    """Bytes for numbers up to the given ones: 1, 2 or 4."""
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def put(out: np.ndarray, at: np.ndarray, width: np.ndarray, values: np.ndarray) -> None:
    for k in range(4):
        wide = width > k
        out[at[wide] + k] = (values[wide] >> 8 * k) & 255


def taken(raw: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    values = raw[at].astype(np.int64)
    for k in range(1, 4):
        wide = np.flatnonzero(width > k)
        if not len(wide):
            break
        values[wide] |= raw[at[wide] + k].astype(np.int64) << 8 * k
    return values


class Shard:
    """Postings of one shard while it grows."""

    def __init__(self, number: int):
        self.number, self.size, self.docs = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        found, first = terms(batch.column("text"), ALPHANUMERIC)
        lengths = np.diff(first)
        coded = found.dictionary_encode()
        n = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(batch.num_rows), lengths)
        each, times = np.unique(row * n + np.asarray(coded.indices), return_counts=True)
        row, code = np.divmod(each, n)
        self.parts.append((coded.dictionary, code.astype(np.int32), (row + self.docs).astype(np.int32), times.astype(np.int32)))
        self.keys.append(batch.column("k").to_numpy())
        self.lengths.append(lengths)
        self.docs += batch.num_rows
        self.size += len(code) + batch.num_rows

    def row(self) -> pa.RecordBatch:
        names, place = unified([p[0] for p in self.parts])
        starts = np.cumsum([0] + [len(p[0]) for p in self.parts])
        code = np.concatenate([place[s + p[1]] for s, p in zip(starts, self.parts)])
        doc, tf = (np.concatenate([p[k] for p in self.parts]).astype(np.int64) for k in (2, 3))
        order = np.argsort(code, kind="stable")  # the documents of a term ascend already
        code, doc, tf = code[order], doc[order], tf[order]
        lengths = np.concatenate(self.lengths)
        df = np.bincount(code, minlength=len(names))
        sizes = block_sizes(df)
        heads = np.cumsum(sizes) - sizes
        steps = np.diff(doc, prepend=0)
        steps[heads] = 0  # a block's first document stands in its directory
        if len(heads):
            most = [np.maximum.reduceat(x, heads) for x in (steps, tf)]
            blocks = np.stack([doc[heads], doc[heads + sizes - 1], most[1], np.minimum.reduceat(lengths[doc], heads), widths(most[0])])
        else:
            blocks = np.zeros((5, 0), np.int64)
        raw, of = layout(sizes, blocks), np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(doc)) - heads[of]
        postings = np.zeros(int(raw[-1]), np.uint8)
        step_w, tf_w = blocks[4], widths(blocks[2])
        put(postings, raw[of] + inside * step_w[of], step_w[of], steps)
        put(postings, raw[of] + (sizes * step_w)[of] + inside * tf_w[of], tf_w[of], tf)
        data, offsets = buffers(names)
        values = [
            self.number, int((lengths > 0).sum()), int(lengths.sum()), pack(data), pack(np.diff(offsets).astype(np.uint32)),
            pack(df.astype(np.uint32)), pack(np.concatenate(self.keys).astype(np.int64)), pack(lengths.astype(np.uint32)),
            pack(blocks.astype(np.uint32).ravel()), postings.tobytes(),
        ]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], INDEX_NAMES)


def layout(sizes: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Where the bytes of each block begin, and where the last ends."""
    return np.concatenate([[0], np.cumsum(sizes * (blocks[4] + widths(blocks[2])))]).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    now = Shard(part << 32)
    for batch in bounded(batches, "text", 4 << 20):
        now.add(batch)
        if now.size >= SHARD_POSTINGS:
            yield now.row()
            made += 1
            now = Shard(part << 32 | made)
    if now.docs:
        yield now.row()


def build(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of all rows, as a written table with one row for each shard.

    Null texts have no terms. Keys are integers; a null key is kept and is smaller
    than all others. Rows that repeat are documents of their own.
    """
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), filled(text).alias("text"))
    return cut_lineage(rows.mapInArrow(_shards, INDEX), "search-index")


# ---------------------------------------------------------------- search

class Queries:
    """A block of queries: distinct terms, and the terms of each query."""

    def __init__(self, ids: list, texts: list[str | None]):
        found, first = terms(pa.array(texts, pa.string()), ALPHANUMERIC)
        coded = found.dictionary_encode()
        code = np.asarray(coded.indices)
        self.ids, self.names = ids, coded.dictionary
        self.terms = [np.unique(code[a:b]) for a, b in zip(first, first[1:])]


def _document_counts(names: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                df, lists, which = present(batch, row, names)
                total[which] += df[lists]
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(total[which])], ["term", "df"])

    return run


def present(batch: pa.RecordBatch, row: int, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size of all lists of a shard, the lists whose terms are among the names, and their places there."""
    data, sizes, df = (unpack(batch.column(c)[row].as_py(), t) for c, t in (("names", np.uint8), ("name_sizes", np.uint32), ("df", np.uint32)))
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    own = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    found = pc.fill_null(pc.index_in(own, names.cast(pa.large_binary())), -1).to_numpy()
    lists = np.flatnonzero(found >= 0)
    return df.astype(np.int64), lists, found[lists].astype(np.int64)


class Lists:
    """The posting lists of one shard that some query needs."""

    def __init__(self, batch: pa.RecordBatch, row: int, names: pa.Array, weights: np.ndarray, n: int, tokens: int):
        df, lists, which = present(batch, row, names)
        keys, lengths, blocks = (unpack(batch.column(c)[row].as_py(), t) for c, t in (("keys", np.int64), ("lengths", np.uint32), ("blocks", np.uint32)))
        self.raw = np.frombuffer(batch.column("postings")[row].as_py(), np.uint8)
        self.keys = keys
        self.m = 10 + 90 * lengths.astype(np.int64) * n // tokens
        blocks = blocks.astype(np.int64).reshape(5, -1)
        self.sizes = block_sizes(df)
        self.at = layout(self.sizes, blocks)
        self.first, self.last, tf, least, self.step_w = blocks
        self.tf_w = widths(tf)
        each = -(-df // BLOCK)
        begin = np.cumsum(each) - each
        self.of = {int(t): (int(begin[k]), int(begin[k] + each[k])) for t, k in zip(which, lists)}
        m = 10 + 90 * least * n // tokens
        self.part = SCALE * tf // (1000 * tf + 8 * m)  # no posting of the block has more, before the weight
        self.weights = weights

    def decoded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents and term frequencies of some blocks, and the place of the block of each posting in ``which``."""
        sizes = self.sizes[which]
        of = np.repeat(np.arange(len(which)), sizes)
        heads = np.cumsum(sizes) - sizes
        inside = np.arange(len(of)) - heads[of]
        step_w, tf_w, at = self.step_w[which][of], self.tf_w[which][of], self.at[which][of]
        steps = taken(self.raw, at + inside * step_w, step_w)
        tf = taken(self.raw, at + sizes[of] * step_w + inside * tf_w, tf_w)
        docs = np.cumsum(steps)
        return docs - (docs[heads] - self.first[which])[of], tf, of

    def scores(self, docs: np.ndarray, tf: np.ndarray, weight: np.ndarray | int) -> np.ndarray:
        return weight * (SCALE * tf // (1000 * tf + 8 * self.m[docs]))


class Best:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        self.top = top
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        order = np.lexsort((keys, -scores))[: self.top]
        self.scores, self.keys = scores[order], keys[order]


def search_shard(lists: Lists, query_terms: np.ndarray, best: Best) -> None:
    """Add the best documents of a shard for one query."""
    used = [t for t in query_terms.tolist() if t in lists.of and lists.weights[t] > 0]
    if not used:
        return
    spans = [lists.of[t] for t in used]
    weight = lists.weights[np.array(used)]
    bounds = np.array([lists.part[a:b].max() for a, b in spans]) * weight
    order = np.argsort(bounds, kind="stable")
    spans, weight = [spans[k] for k in order], weight[order]
    reach = np.cumsum(bounds[order])  # the most that a document gains from list k and all before it
    counts = np.array([b - a for a, b in spans])
    blocks = ranges(np.array([a for a, _ in spans]), counts)
    of = np.repeat(np.arange(len(spans)), counts)
    first, last = lists.first[blocks], lists.last[blocks]
    for low in range(0, len(lists.keys), WINDOW):
        high = low + WINDOW
        essential = int(np.searchsorted(reach, best.least))  # lists before it cannot reach the tenth score
        if essential == len(spans):
            return
        here = np.flatnonzero((of >= essential) & (first < high) & (last >= low))
        if not len(here):
            continue
        docs, tf, at = lists.decoded(blocks[here])
        near = np.flatnonzero((docs >= low) & (docs < high))
        docs, tf, at = docs[near], tf[near], at[near]
        # Sums of integers below 2^53, so the doubles are exact.
        sums = np.bincount(docs - low, weights=lists.scores(docs, tf, weight[of[here[at]]]), minlength=1).astype(np.int64)
        found = np.flatnonzero(sums)
        scores, found = sums[found], found + low
        for k in range(essential - 1, -1, -1):
            good = scores + reach[k] >= best.least
            scores, found = scores[good], found[good]
            if not len(found):
                break
            a, b = spans[k]
            block = a + np.searchsorted(lists.last[a:b], found)
            block[block == b] = b - 1
            inside = (lists.first[block] <= found) & (found <= lists.last[block])
            most = np.where(inside, lists.part[block] * weight[k], 0)
            good = scores + most + (reach[k - 1] if k else 0) >= best.least
            scores, found, block, inside = scores[good], found[good], block[good], inside[good]
            if not inside.any():
                continue
            docs, tf, _ = lists.decoded(np.unique(block[inside]))
            place = np.searchsorted(found, docs)
            place[place == len(found)] = 0
            hit = found[place] == docs
            scores[place[hit]] += lists.scores(docs[hit], tf[hit], weight[k])
        good = scores >= best.least
        if good.any():
            best.add(scores[good], lists.keys[found[good]])


def _search(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n, tokens = shared.value
        best = [Best(top) for _ in queries.terms]
        for batch in batches:
            for row in range(batch.num_rows):
                lists = Lists(batch, row, queries.names, weights, n, tokens)
                for own, found in zip(queries.terms, best):
                    search_shard(lists, own, found)
        q = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        columns = [pa.array(q.astype(np.int32))] + [pa.array(np.concatenate([getattr(b, c) for b in best])) for c in ("keys", "scores")]
        yield pa.RecordBatch.from_arrays(columns, ["q", "k", "score"])

    return run


def query_blocks(queries: DataFrame, text: str, key: str) -> Iterator[Queries]:
    """The queries in blocks of about QUERY_BYTES; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    for r in queries.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        ids.append(r["k"])
        texts.append(r["t"])
        size += len(r["t"] or "") + 100
        if size >= QUERY_BYTES:
            yield Queries(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, texts)


def search(index: DataFrame, queries: DataFrame, text: str = "text", key: str = "item_id", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each query with a score above 0.

    Equal scores are ordered by ascending key. Null and empty queries have no rows;
    queries that repeat are ranked each on their own. No index, no queries: an empty table.
    """
    spark = index.sparkSession
    path = shared_dir(spark, "search-results")
    kind = queries.schema[key].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(path)
    n, tokens = index.agg(F.sum("n_docs"), F.sum("n_terms")).collect()[0]
    for block in query_blocks(queries, text, key) if tokens else ():
        counted = index.select("names", "name_sizes", "df").mapInArrow(_document_counts(block.names), "term bigint, df bigint")
        df = np.zeros(len(block.names), np.int64)
        for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # the distinct terms of one block of queries
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        shared = spark.sparkContext.broadcast((block, weights, n, tokens))
        found = index.drop("shard", "n_docs", "n_terms").mapInArrow(_search(shared, top), "q int, k bigint, score bigint")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "k")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(q, i) for q, i in enumerate(block.ids)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", kind)]))
        ranked.join(F.broadcast(names), "q").select(  # one block of queries
            "item_id", "rank", F.nullif("k", F.lit(NO_KEY)).alias("doc_id"), "score"
        ).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms, row_number() OVER () AS r FROM documents),
s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
q AS (SELECT i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term FROM (SELECT *, row_number() OVER () AS i FROM benchmark)),
t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
m AS (SELECT r, 10 + (90 * len(terms) * s.n) // s.l AS m FROM d, s),
sc AS (SELECT i, item_id, r, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""


@query("op12_ranked_search", SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
