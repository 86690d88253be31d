"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles; a shingle weighs its count in the text
times its inverse document frequency. Samples of the weighted set are drawn so that two
texts draw the same one with the probability of their weighted Jaccard similarity. Bands of
ROWS samples bring candidates together, and each candidate is verified on its whole text.

Document frequencies are counted over all documents in 2^DF_BITS hashed counters. The
share PRIOR of all documents is added to each count, and the frequency moves a weight
between 1 and 1 + RANGE. So passages which many documents share weigh less, but the copies
of one text do not tear each other apart, even if they are a third of all documents.

In a bucket every text is compared with one leader, another one in each band, so a bucket
of any size costs one pair a row. Texts that do not match it form a smaller bucket with a
leader of its own while that halves the pairs left. At last the texts outside the largest
component of a bucket are compared with all texts of the bucket, in blocks by matrix
products that emit one link a text, never pairs. Equal texts are one class before all this.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.llm.bloom import member_filter
from scorefold.llm.common import bounded, filled, mixed, ranges, release, table, words
from scorefold.llm.components import components
from scorefold.llm.registry import query
from scorefold.session import cut_lineage

WIDTH = 5  # words of a shingle
LEAST = 0.8
BANDS, ROWS = 9, 3
DF_BITS = 22
DF_BLOCK_BITS = 14
PRIOR = 0.001
RANGE = 0.5
BLOCK = 1024  # texts of a bucket in one matrix
COLUMNS = 4096
SLICE = 1 << 20

_RNG = np.random.default_rng(5)
_MIX = _RNG.integers(0, 2**64, WIDTH, dtype=np.uint64) | np.uint64(1)
_SALTS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_GAMMA = _RNG.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_RNG.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_UNIFORM = _RNG.random(1 << 16).astype(np.float32)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, the number of each text, and two hashes of all its words.

    Words are runs without white space, A-Z lower-cased. A shorter text is one
    shingle of all its words; so is a text without words.
    """
    spans = words(texts)
    h = spans.hashes(fold_case=True)
    sizes = np.diff(spans.first)
    n = np.maximum(sizes - width + 1, 1)
    place = ranges(np.zeros(len(sizes), np.int64), sizes)
    weighted = mixed(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(weighted ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    seq = np.stack([x[spans.first[1:]] - x[spans.first[:-1]] for x in (sums, other)])
    start = ranges(spans.first[:-1], n)
    doc = np.repeat(np.arange(len(sizes)), n)
    last = np.repeat(spans.first[1:], n)
    made = np.zeros(len(start), np.uint64)
    padded = np.append(h, np.uint64(0))
    for k in range(width):
        at = start + k
        made += np.where(at < last, padded[np.minimum(at, len(h))], np.uint64(0)) * _MIX[k]
    made = mixed(made)
    order = np.lexsort((made, doc))
    made, doc = made[order], doc[order]
    head = np.ones(len(made), bool)
    head[1:] = (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(made)))
    found = doc[at]
    return made[at], count, np.bincount(found, minlength=len(sizes)), seq[0].view(np.int64), seq[1].view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]):
    release()
    for batch in bounded(batches, "text", SLICE):
        yield batch, shingles(batch.column("text"))
    release()


def _text_rows(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("k"), filled(text).alias("text"))


def frequencies(df: DataFrame, text: str = "text", key: str = "doc_id") -> np.ndarray:
    """Weight by inverse document frequency of each hashed counter, over all documents: an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(1 << DF_BITS, np.uint32), 0
        for batch, (made, *_) in _slices(batches):
            np.add.at(total, (made >> np.uint64(64 - DF_BITS)).astype(np.int64), np.uint32(1))
            docs += batch.num_rows
        if docs:
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, 1 << DF_BLOCK_BITS)]
            parts.append(zlib.compress(np.uint32([docs]).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.float64) for x in rows.counts)
        return pd.DataFrame({"block": rows.block[:1], "counts": [total.astype(np.float32).tobytes()]})

    parts = _text_rows(df, text, key).mapInArrow(run, "block long, counts binary")
    rows = sorted(parts.groupBy("block").applyInPandas(add, "block long, counts binary").collect())
    if not rows:
        return np.ones(1 << DF_BITS, np.float32)
    docs = float(np.frombuffer(rows[-1]["counts"], np.float32)[0])
    df_of = np.concatenate([np.frombuffer(r["counts"], np.float32) for r in rows[:-1]])
    idf = np.log1p(docs / (df_of + PRIOR * docs)) / np.log1p(1 / PRIOR)
    return (1 + RANGE * idf).astype(np.float32)


def weights_of(made: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return count * idf[(made >> np.uint64(made.dtype.itemsize * 8 - DF_BITS)).astype(np.int64)]


def samples(made: np.ndarray, weight: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """One consistent weighted sample of each text (rows) for each salt (columns), as a 64-bit number."""
    log_w = np.log(weight).astype(np.float32)
    starts = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(per_text)), per_text)
    out = np.empty((len(per_text), len(_SALTS)), np.uint64)
    low = np.uint64(0xFFFF)
    for j, salt in enumerate(_SALTS):
        x = made * salt
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9FB21C651E98DF25)
        r = _GAMMA[(x >> np.uint64(48)).astype(np.int32)]
        log_c = _LOG_GAMMA[((x >> np.uint64(32)) & low).astype(np.int32)]
        beta = _UNIFORM[((x >> np.uint64(16)) & low).astype(np.int32)]
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta + 1)
        best = np.minimum.reduceat(log_a, starts)
        hit = np.flatnonzero(log_a == best[text])
        owner, first = np.unique(text[hit], return_index=True)
        at = hit[first]
        out[owner, j] = mixed(made[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def signatures(df: DataFrame, idf, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each text: k, two hashes of its words, and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (made, count, per_text, s1, s2) in _slices(batches):
            drawn = samples(made, weights_of(made, count, idf.value), per_text).reshape(-1, BANDS, ROWS)
            keys = np.zeros(drawn.shape[:2], np.uint64)
            for r in range(ROWS):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + drawn[:, :, r])
            flat = pa.array(keys.view(np.int64).ravel())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(s1), pa.array(s2), bands], ["k", "s1", "s2", "bands"])

    return _text_rows(df, text, key).mapInArrow(run, "k long, s1 long, s2 long, bands array<long>")


def vectors(rows: DataFrame) -> DataFrame:
    """Of each text (k, text): the distinct shingles as sorted 32-bit numbers, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (made, count, per_text, *_) in _slices(batches):
            short, text = (made >> np.uint64(32)).astype(np.uint32), np.repeat(np.arange(len(per_text)), per_text)
            head = np.append(True, (short[1:] != short[:-1]) | (text[1:] != text[:-1]))
            at = np.flatnonzero(head)  # shingles that share a 32-bit number are one
            many = np.add.reduceat(count, at).astype(np.uint32)
            short = short[at]
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=len(per_text)))]).tolist()
            parts = list(zip(ends, ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([short[a:b].tobytes() for a, b in parts], pa.binary()),
                 pa.array([zlib.compress(many[a:b].tobytes(), 1) for a, b in parts], pa.binary())], ["k", "items", "counts"],
            )

    return rows.mapInArrow(run, "k long, items binary, counts binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][at], b[1][bt]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 1.0


def verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity over whole texts is at least ``least``."""
    left = pairs.join(texts.toDF("a", "ai", "ac"), "a")
    both = left.join(texts.toDF("b", "bi", "bc"), "b").select("a", "b", "ai", "ac", "bi", "bc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(items: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
            made = np.frombuffer(items, np.uint32)
            return made, np.frombuffer(zlib.decompress(counts), np.uint32) * idf.value[made >> np.uint32(32 - DF_BITS)]

        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                ai, ac, bi, bc = (batch.column(c).to_pylist() for c in ("ai", "ac", "bi", "bc"))
                same = [weighted_jaccard(load(*x), load(*y)) >= least for x, y in zip(zip(ai, ac), zip(bi, bc))]
                take = pa.array(np.flatnonzero(same))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _matrix_links(idf, least: float):
    """Links (a, b) between texts of the block ``i`` of leftovers and all texts of the block ``j``, one at most for each text."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        ids = rows["id"].to_numpy()[order]
        is_left, is_whole = (np.asarray(rows[c].to_pylist(), bool)[order] for c in ("is_left", "is_whole"))
        items = [np.frombuffer(x, np.uint32) for x in rows["items"].take(pa.array(order)).to_pylist()]
        counts = [np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in rows["counts"].take(pa.array(order)).to_pylist()]
        n = len(ids)
        # The k-th occurrence of a shingle is an element of its own, so multisets become sets.
        flat, many = np.concatenate(items), np.concatenate(counts)
        text = np.repeat(np.repeat(np.arange(n), [len(x) for x in items]), many)
        element = np.repeat(flat.astype(np.uint64) << np.uint64(32), many) | ranges(np.zeros(len(many), np.int64), many).astype(np.uint64)
        weight = np.repeat(idf.value[flat >> np.uint32(32 - DF_BITS)], many)
        total = np.bincount(text, weights=weight, minlength=n)
        _, column, seen = np.unique(element, return_inverse=True, return_counts=True)
        both = seen[column] > 1
        number = np.cumsum(seen > 1) - 1
        text, column, root = text[both], number[column[both]], np.sqrt(weight[both])
        order = np.argsort(column, kind="stable")
        text, column, root = text[order], column[order], root[order]
        left, whole = np.flatnonzero(is_left), np.flatnonzero(is_whole)
        shared = np.zeros((len(left), len(whole)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            X = np.zeros((n, COLUMNS), np.float32)
            X[text[a:b], column[a:b] - first] = root[a:b]
            shared += X[left] @ X[whole].T
        low = np.arange(n)
        for at, row in enumerate(left):
            hits = whole[shared[at] >= (least - 1e-6) / (1 + least) * (total[whole] + total[row])]
            names = low[np.append(hits, row)]
            if (names != names.min()).any():
                low[np.isin(low, np.unique(names))] = names.min()
        linked = low != np.arange(n)
        return pa.table({"a": ids[linked], "b": ids[low[linked]]})

    return run


def _all_pairs(whole: DataFrame, member: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """Links between different components in each bucket (band, bucket, id), whatever its size.

    The leftovers of a bucket are its texts outside its most frequent component. Each of them
    is compared with every text of the bucket, so no pair of two components stays untested.
    Pairs of blocks are compared apart.
    """
    named = whole.join(member.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = cut_lineage(named.select("band", "bucket", "id", "component"), "bucket members")
    of = named.groupBy("band", "bucket", "component").agg(F.count("*").alias("n"))
    sizes = of.groupBy("band", "bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"),
    ).where("n > most")
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    sizes = sizes.select("band", "bucket", "main", blocks(F.col("n") - F.col("most")).alias("ln"), blocks(F.col("n")).alias("wn"))
    rows = named.join(sizes, ["band", "bucket"]).withColumn("li", F.pmod(F.xxhash64("id"), F.col("ln")).cast("int"))
    rows = rows.withColumn("wi", F.pmod(F.xxhash64("id"), F.col("wn")).cast("int")).withColumn("is_left", F.col("component") != F.col("main"))
    place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    as_whole = F.transform(F.sequence(F.lit(0), F.col("ln") - 1), lambda k: place(k, F.col("wi")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("wn") - 1), lambda k: place(F.col("li"), k))
    dealt = rows.withColumn("p", F.explode(F.when(F.col("is_left"), F.array_union(as_left, as_whole)).otherwise(as_whole))).select(
        "band", "bucket", "p.i", "p.j", "id",
        (F.col("is_left") & (F.col("p.i") == F.col("li"))).alias("is_left"), (F.col("p.j") == F.col("wi")).alias("is_whole"),
    )
    dealt = dealt.join(texts.toDF("id", "items", "counts"), "id")
    return dealt.groupBy("band", "bucket", "i", "j").applyInArrow(_matrix_links(idf, least), "a long, b long")


def _apart(stars: DataFrame, member: DataFrame) -> DataFrame:
    """Rows of the stars whose two ends are in different components."""
    left = stars.join(member.toDF("id", "ic"), "id", "left").join(member.toDF("leader", "lc"), "leader", "left")
    return left.where(F.coalesce("ic", "id") != F.coalesce("lc", "leader")).drop("ic", "lc")


def _stars(rows: DataFrame) -> DataFrame:
    """(band, bucket, id, leader) of buckets with two rows at least; each band has another leader."""
    leaders = rows.groupBy("band", "bucket").agg(F.min_by("id", F.xxhash64("id", "band")).alias("leader"), F.count("*").alias("n"))
    leaders = cut_lineage(leaders.where("n > 1").drop("n"), "leaders")
    return cut_lineage(rows.join(leaders, ["band", "bucket"]).where("id <> leader"), "stars")


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row per input row: key, component_id, kept.

    Texts are linked when the weighted Jaccard similarity of their shingles is at
    least ``least``, or when they have the same words; component_id is the smallest
    key reachable by links and kept tells whether the row has that key. Null text
    is the empty text; all texts without words are one class. A row without a key
    is in no class and is kept. Rows that share a key are one document. Other
    columns are not read; an empty table gives an empty table.
    """
    spark = df.sparkSession
    known = df.where(F.col(key).isNotNull())
    idf = spark.sparkContext.broadcast(frequencies(known, text, key))
    signed = cut_lineage(signatures(known, idf, text, key), "signatures")
    reps = cut_lineage(
        signed.groupBy("s1", "s2").agg(F.min(F.struct("k", "bands")).alias("top"))
        .select("s1", "s2", F.col("top.k").alias("id"), F.col("top.bands").alias("bands")), "texts",
    )
    reps_count = reps.count()
    stars = _stars(reps.select("id", F.posexplode("bands").alias("band", "bucket")))
    whole = stars.select("band", "bucket", "id").union(stars.select("band", "bucket", "leader")).distinct()
    ids = cut_lineage(stars.select("id").union(stars.select("leader")).distinct(), "candidates")
    maybe = member_filter(ids.select(F.xxhash64("id")), ids.count())
    texts = cut_lineage(vectors(_text_rows(known, text, key).where(maybe(F.xxhash64("k")))), "vectors")

    # The leader that shares most bands first; then only what is still apart.
    shared = stars.groupBy("id", "leader").agg(F.count("*").alias("n"))
    first = shared.groupBy("id").agg(F.max_by("leader", F.struct("n", F.xxhash64("leader"))).alias("leader"))
    links = cut_lineage(verified(first.toDF("a", "b"), texts, idf, least), "links")
    member = cut_lineage(components(links), "members")
    before = None
    while True:
        apart = _apart(stars, member)
        more = cut_lineage(verified(apart.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), texts, idf, least), "links")
        links = links.unionByName(more)
        member = cut_lineage(components(links), "members")
        left = cut_lineage(_apart(stars, member).select("band", "bucket", "id"), "left")
        sizes = left.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
        pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1))).collect()[0][0] or 0
        if not pairs or before is not None and 2 * pairs > before or pairs <= reps_count:
            break
        before, stars = pairs, _stars(left)
    # Leaders and matched texts have left the rounds; leftovers meet them here.
    more = cut_lineage(_all_pairs(whole, member, texts, idf, least), "links")
    if more.limit(1).count():
        member = cut_lineage(components(links.unionByName(more)), "members")

    named = reps.join(member, reps["id"] == member["node"], "left").select("s1", "s2", "id", F.coalesce("component", "id").alias("component"))
    # A key that stands in two texts joins their classes.
    named = cut_lineage(named, "named")
    out = signed.select("k", "s1", "s2").join(named, ["s1", "s2"]).select(
        F.col("k").alias(key), F.col("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept")
    )
    alone = df.where(F.col(key).isNull()).select(F.col(key).cast("long").alias(key), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep(df: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """The rows that stay, all columns. Only rows that a filter of the dropped keys does not clear are shuffled."""
    dropped = cut_lineage(classes(df, text, key, least).where("not kept").select(F.col(key).alias("__gone")).distinct(), "dropped")
    maybe = member_filter(dropped.select(F.xxhash64("__gone")), dropped.count())
    hit = F.coalesce(maybe(F.xxhash64(F.col(key).cast("long"))), F.lit(False))
    checked = df.where(hit).join(dropped, F.col(key) == F.col("__gone"), "left_anti")
    return df.where(~hit).unionByName(checked)


@query("op5_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents."""
    return classes(table(spark, sf_dir, "documents"))
