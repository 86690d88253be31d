"""Divergence of sources: how the words of each source differ from those of other sources of its language.

Single-pass in-memory indexing. Each task collects postings (term, source, occurrences,
documents) until MEMORY of them are held, then sorts them by term and writes them out
as one run, cut into chunks by hash shard. A shard's chunks are read in the order of
their first terms; a heap holds the open ones, and all that lies before the next chunk is
merged and done. So a shard streams, whatever its size, and a term of any frequency has
one posting for each run and source.

The merged frequencies of kept terms are then streamed once more. A pair of sources takes
the value it would have if no term occurred in either, corrected for the terms that occur
in one of them (by the number of terms of each count) and for the terms that occur in both
(term by term). Work is thus in proportion to the postings and to the pairs of sources that
share a term, never to all terms for all pairs.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scorefold.llm.common import bounded, filled, ranges, table
from scorefold.llm.registry import query
from scorefold.llm.terms import LETTERS, hashes, strings, terms, unified
from scorefold.session import cut_lineage

MEMORY = 1_000_000  # postings held before a run is written
CHUNK = 2_048  # postings in a chunk of a run
LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
PAIRS = 500_000  # pairs of postings looked at together


# ---------------------------------------------------------------- runs

RUN = "shard int, lang string, head binary, term array<binary>, source array<string>, n array<bigint>, docs array<bigint>"
RUN_NAMES = ["shard", "lang", "head", "term", "source", "n", "docs"]


class Run:
    """Postings of one run while it grows; groups are the (lang, source) seen in it."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        found, first = terms(batch.column("text"), LETTERS)
        if not len(found):
            return
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        group = np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.int64)
        coded = found.dictionary_encode()
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        each, times = np.unique(row * len(coded.dictionary) + np.asarray(coded.indices), return_counts=True)
        row, code = np.divmod(each, len(coded.dictionary))
        code, at, n, docs = summed(code, group[row], times, np.ones(len(code), np.int64))
        self.parts.append((coded.dictionary, code, at, n, docs))
        self.size += len(code)

    def chunks(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The run as rows, sorted by shard, lang and term."""
        if not self.parts:
            return
        names, place = unified([p[0] for p in self.parts])
        starts = np.cumsum([0] + [len(p[0]) for p in self.parts])
        code = np.concatenate([place[s + p[1]] for s, p in zip(starts, self.parts)])
        code, group, n, docs = summed(code, *[np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4)])
        langs, sources = (np.array([g[k] for g in self.groups], object) for k in (0, 1))
        lang_names, lang = np.unique(langs, return_inverse=True)
        shard = (hashes(names) % np.uint64(shards)).astype(np.int64)[code]
        order = np.lexsort((group, code, lang[group], shard))
        code, group, n, docs, shard = code[order], group[order], n[order], docs[order], shard[order]
        part = shard * len(lang_names) + lang[group]
        heads = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        cuts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(heads, heads[1:])])
        offsets = pa.array(np.append(cuts, len(part)).astype(np.int32))
        lists = (names.take(pa.array(code)), pa.array(sources, pa.string()).take(pa.array(group)), pa.array(n), pa.array(docs))
        yield from sliced(
            [pa.array(shard[cuts].astype(np.int32)), pa.array(lang_names[lang[group[cuts]]], pa.string()), names.take(pa.array(code[cuts]))]
            + [pa.ListArray.from_arrays(offsets, x) for x in lists],
            RUN_NAMES,
        )


def sliced(columns: list[pa.Array], names: list[str], rows: int = 256) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for k in range(0, whole.num_rows, rows):
        yield whole.slice(k, rows)


def summed(code: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of n and docs for each distinct (code, group), sorted."""
    key = code << 32 | group
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(heads):
        return key, key, key, key
    return key[heads] >> 32, key[heads] & 0xFFFFFFFF, np.add.reduceat(n[order], heads), np.add.reduceat(docs[order], heads)


def _runs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Run()
        for batch in bounded(batches, "text", 4 << 20):
            held.add(batch)
            if held.size >= MEMORY:
                yield from held.chunks(shards)
                held = Run()
        yield from held.chunks(shards)

    return run


# ---------------------------------------------------------------- merge of the runs of a shard

FREQUENCY = "kind int, lang string, source string, n bigint, term array<binary>, sources array<string>, ns array<bigint>"
FREQUENCY_TYPES = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.int64())]
TERMS, TOTAL, KEPT = 0, 1, 2  # kinds of rows: postings, occurrences of a source, kept terms of a lang


class Merge:
    """Heap of open chunks of one lang. Only whole terms before the bound leave it."""

    def __init__(self, lang: str, totals: dict, least: int):
        self.lang, self.totals, self.least = lang, totals, least
        self.heap: list = []
        self.number, self.held = count(), 0

    def push(self, segment: list[pa.Array]) -> None:
        heapq.heappush(self.heap, (segment[0][0].as_py(), next(self.number), segment))
        self.held += len(segment[0])

    def drain(self, bound: bytes | None) -> Iterator[tuple]:
        """Rows of frequencies for all terms before the bound (all, if there is none)."""
        done = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            segment = heapq.heappop(self.heap)[2]
            size = len(segment[0])
            cut = size if bound is None else bisect_left(range(size), bound, key=lambda k: segment[0][k].as_py())
            done.append([x.slice(0, cut) for x in segment])
            self.held -= size
            if cut < size:
                self.push([x.slice(cut) for x in segment])
        if not done:
            return
        names, code = unified([d[0] for d in done])
        coded = pa.concat_arrays([d[1] for d in done]).dictionary_encode()
        n, docs = (np.concatenate([np.asarray(d[k]) for d in done]) for k in (2, 3))
        code, group, n, docs = summed(code, np.asarray(coded.indices).astype(np.int64), n, docs)
        heads = np.flatnonzero(np.diff(code, prepend=-1))
        good = np.add.reduceat(docs, heads) >= self.least
        keep = np.repeat(good, np.diff(np.append(heads, len(code))))
        code, group, n = code[keep], group[keep], n[keep]
        if not len(code):
            return
        self.totals[KEPT, self.lang, None] = self.totals.get((KEPT, self.lang, None), 0) + int(good.sum())
        by_source = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(by_source, group, n)
        for s in np.unique(group).tolist():
            key = (TOTAL, self.lang, coded.dictionary[s].as_py())
            self.totals[key] = self.totals.get(key, 0) + int(by_source[s])
        # A row ends with a term; a term has at most as many postings as the lang has sources.
        heads = np.flatnonzero(np.diff(code, prepend=-1))
        cuts = heads[np.flatnonzero(np.diff(heads // 32768, prepend=-1))].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(code)]):
            where = pa.array(group[a:b])
            yield TERMS, self.lang, None, None, names.take(pa.array(code[a:b])), coded.dictionary.take(where), pa.array(n[a:b])


def frequency_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(FREQUENCY_TYPES[:4])]
    for k, t in enumerate(FREQUENCY_TYPES[4:], 4):
        parts = [r[k] if r[k] is not None else pa.array([], t.value_type) for r in rows]
        columns.append(pa.ListArray.from_arrays(np.cumsum([0] + [len(p) for p in parts]).astype(np.int32), pa.concat_arrays(parts)))
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FREQUENCY.split(", ")])


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        now: Merge | None = None
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            heads = batch.column("head")
            for row, lang in enumerate(langs):
                if now is None or now.lang != lang:
                    if now:
                        yield from (frequency_batch([r]) for r in now.drain(None))
                    now = Merge(lang, totals, least)
                elif now.held >= MEMORY // 4:
                    yield from (frequency_batch([r]) for r in now.drain(heads[row].as_py()))
                now.push([batch.column(c)[row].values for c in ("term", "source", "n", "docs")])
        if now:
            yield from (frequency_batch([r]) for r in now.drain(None))
        rows = [(*key, n, None, None, None) for key, n in totals.items()]
        for k in range(0, len(rows), 10_000):
            yield frequency_batch(rows[k : k + 10_000])

    return run


def frequencies(df: DataFrame, text: str, lang: str, source: str, least: int = LEAST_DOCS) -> DataFrame:
    """Merged counts of the terms that stand in at least ``least`` documents of their lang, as a written table.

    Rows of kind TERMS hold postings, sorted by term; the others add up to the occurrences
    of each source and the number of kept terms of each lang.
    """
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(filled(lang).alias("lang"), filled(source).alias("source"), filled(text).alias("text"))
    runs = rows.mapInArrow(_runs(shards), RUN).repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", "head")
    return cut_lineage(runs.drop("shard").mapInArrow(_merge(least), FREQUENCY), "frequencies")


# ---------------------------------------------------------------- divergences

def share(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / whole), exact for all counts below whole < 2^53: long division by thousands."""
    out, rest = np.zeros(np.broadcast(counts, whole).shape, np.int64), counts + 1
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[heads], np.add.reduceat(values[order], heads) if len(heads) else values


class Sums:
    """Sums by key that are brought together whenever too many are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts.append(added(keys, values))
        self.size += len(self.parts[-1][0])
        if self.size > 4 * PAIRS:
            whole = self.whole()
            self.parts, self.size = [whole], len(whole[0])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return added(*(np.concatenate([p[k] for p in self.parts]) for k in (0, 1)))


class Lang:
    """What one task gathers for one lang from rows of frequencies."""

    def __init__(self, lang: str, names: list[str], totals: list[int], kept: int):
        self.lang, self.names, self.kept = lang, pa.array(names, pa.string()), kept
        self.whole = np.array(totals, np.int64) + kept
        self.all = int(sum(totals)) + kept
        self.none = share(np.zeros(len(names), np.int64), self.whole) if kept else np.ones(len(names), np.int64)
        self.pairs, self.counts = Sums(), Sums()
        self.top: list[pd.DataFrame] = []

    def add(self, names: pa.Array, sources: pa.Array, n: np.ndarray) -> None:
        g = np.asarray(pc.index_in(sources, self.names)).astype(np.int64)
        p = share(n, self.whole[g])
        coded = names.dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64)
        heads = np.flatnonzero(np.diff(code, prepend=-1))
        sizes = np.diff(np.append(heads, len(code)))
        self.counts.add(g << 40 | n, np.ones(len(n), np.int64))
        self._both(g, p, heads, sizes)
        q = share(np.repeat(np.add.reduceat(n, heads), sizes), np.int64(self.all))
        more = np.flatnonzero(p > q)
        f = excess(p[more], q[more])
        found = pd.DataFrame({"g": g[more], "f": f, "code": code[more]}).sort_values(["g", "f", "code"], ascending=[True, False, True])
        found = found[found.groupby("g").cumcount() < TOP]
        self.top.append(found.assign(term=coded.dictionary.take(pa.array(found.code.to_numpy())).to_pylist()).drop(columns="code"))
        if sum(map(len, self.top)) > PAIRS:
            self.top = [self.best()]

    def _both(self, g: np.ndarray, p: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> None:
        """Corrections for terms that occur in both sources of a pair, in blocks of postings of the first."""
        from_, width = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        block = np.cumsum(width) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:]):
            left, right = np.repeat(np.arange(a, b), width[a:b]), ranges(from_[a:b], width[a:b])
            other = left != right
            left, right = left[other], right[other]
            gl, gr, pl, pr = g[left], g[right], p[left], p[right]
            zl, zr = self.none[gl], self.none[gr]
            self.pairs.add(gl * len(self.names) + gr, excess(pl, pr) - excess(pl, zr) - excess(zl, pr) + excess(zl, zr))

    def best(self) -> pd.DataFrame:
        found = pd.concat(self.top).sort_values(["g", "f", "term"], ascending=[True, False, True])
        return found[found.groupby("g").cumcount() < TOP]

    def batches(self) -> Iterator[pa.RecordBatch]:
        keys, times = self.counts.whole()
        size = len(self.names)
        for a in range(0, len(keys), step := max(1, PAIRS // size)):
            g, n, m = keys[a : a + step] >> 40, keys[a : a + step] & ((1 << 40) - 1), times[a : a + step, None]
            p, other, z = share(n, self.whole[g])[:, None], self.none[None, :], self.none[g][:, None]
            here = np.broadcast_to(g[:, None], (len(g), size)), np.broadcast_to(np.arange(size), (len(g), size))
            apart = here[0] != here[1]
            for (x, y), f in ((here, excess(p, other) - excess(z, other)), (here[::-1], excess(other, p) - excess(other, z))):
                self.pairs.add((x * size + y)[apart], (f * m)[apart])
        keys, values = self.pairs.whole()
        yield from self._rows("pair", keys // size, self.names.take(pa.array(keys % size)), values)
        top = self.best()
        yield from self._rows("term", top.g.to_numpy(), strings(pa.array(top.term.tolist(), pa.binary())), top.f.to_numpy())

    def zeros(self) -> Iterator[pa.RecordBatch]:
        """Each pair of sources, with its value if no term occurred in either."""
        size = len(self.names)
        for g in range(size):
            others = np.flatnonzero(np.arange(size) != g)
            value = excess(self.none[g], self.none[others]) * self.kept
            yield from self._rows("pair", np.full(size - 1, g), self.names.take(pa.array(others)), value)

    def _rows(self, part: str, g: np.ndarray, items: pa.Array, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(g), 50_000):
            b = min(len(g), a + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang] * (b - a), pa.string()), self.names.take(pa.array(g[a:b])), pa.array([part] * (b - a)), items[a:b], pa.array(values[a:b])],
                VALUE_NAMES,
            )


VALUE = "lang string, source string, part string, item string, value bigint"
VALUE_NAMES = [f.split()[0] for f in VALUE.split(", ")]


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs: dict[str, Lang] = {}
    for batch in batches:
        for row, lang in enumerate(batch.column("lang").to_pylist()):
            if lang not in langs:
                # Gathered sums of other langs leave, so a task holds one lang.
                for old in langs.values():
                    yield from old.batches()
                langs = {lang: Lang(lang, *(batch.column(c)[row].as_py() for c in ("all_sources", "totals", "kept")))}
            langs[lang].add(*(batch.column(c)[row].values for c in ("term", "sources")), np.asarray(batch.column("ns")[row].values))
    for old in langs.values():
        yield from old.batches()


def _zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield from Lang(r["lang"], r["all_sources"], r["totals"], r["kept"]).zeros()


def divergences(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its lang, and its own terms.

    Null text, lang and source count as empty texts. Every (lang, source) of the table
    takes part, also without terms; a lang without kept terms has values of 0. Rows that
    repeat count as often. Equal values are ordered by the bytes of the item. Other columns
    are not read; an empty table gives an empty table.

    The sources of a lang stand together in one row: the result has their square.
    """
    found = frequencies(df, text, lang, source, least)
    groups = df.select(filled(lang).alias("lang"), filled(source).alias("source")).distinct()
    totals = found.where(F.col("kind") == TOTAL).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = found.where(F.col("kind") == KEPT).groupBy("lang").agg(F.sum("n").alias("kept"))
    listed = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("all")
    )
    stats = cut_lineage(
        listed.join(kept, "lang", "left").select(
            "lang", F.col("all.source").alias("all_sources"), F.col("all.n").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept")
        ),
        "lang-stats",
    )
    streamed = found.where(F.col("kind") == TERMS).select("lang", "term", "sources", "ns").join(stats, "lang")
    parts = stats.mapInArrow(_zeros, VALUE).unionByName(streamed.mapInArrow(_corrections, VALUE))
    # A term of a lang stands in one shard, so its value is whole; pairs add up.
    parts = cut_lineage(parts, "divergences")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value")
    )
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.col("item"))
    own = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(own)


SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms,
    row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0) AS n
  FROM g LEFT JOIN c USING (lang, source) LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (gn.n + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)::HUGEINT) // (v.n + v.v)::HUGEINT AS q
  FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op11_source_divergence", SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of documents."""
    return divergences(table(spark, sf_dir, "documents"))
