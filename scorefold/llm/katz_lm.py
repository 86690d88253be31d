"""Scores of texts under an n-gram model with Katz backoff, trigrams by default.

Counts up to TOP are discounted by Good-Turing, higher ones by REST, so every history keeps
some mass for words not seen after it. That mass is spread over those words in proportion to
the model of the next lower order, down to unigrams, which are discounted alike and give
their own rest to unknown words as one. Backoff weights are normalised exactly, in doubles:
1 over all words for every history. The first word of a text has the start as its history,
later ones up to order - 1 words.

No table is broadcast and no n-gram shuffled as a row. Texts are cut into blocks, written
once as streams of small numbers. A block asks for the counts of its distinct n-grams of
each order, in sorted and packed slices by range of the hash; the task that owns a range adds
up what all blocks hold and answers each slice. So an n-gram of any frequency moves once a
block. In the same way histories are summed: of each distinct n-gram one block is told that
it owns it and adds the n-gram to its history, where a text not learnt from has that history.
A token is evaluated from the highest order down: its own n-gram, or the weight of the
history and the next lower order. Only tokens of unseen n-grams ask for a weight.

Words are known by 64 bits. Longer n-grams take CLASH_BITS more than the number of tokens
needs, at most 64: of two n-grams one in 2^CLASH_BITS meets another by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.llm.common import bounded, filled, held_out, mixed, release, table, words
from scorefold.llm.registry import query
from scorefold.session import cut_lineage

ORDER = 3  # words of the longest n-grams
TOP = 5  # counts up to this are discounted by Good-Turing
REST = 0.999
BLOCK_BYTES = 8 << 20
RANGE_TOKENS = 1_000_000  # tokens for each range of hashes
CLASH_BITS = 28
FOLDS = 10
END = np.uint64(0x5E2D58D8B3BCDEED)
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---------------------------------------------------------------- packed arrays

def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(width, len(data) // width).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, ranges: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes of so many bits, for the ranges that hold some."""
    edges = [((k << bits) // ranges) for k in range(1, ranges)]
    cuts = [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


# ---------------------------------------------------------------- blocks

BLOCK = "block long, n_tokens long, keys array<long>, held binary, sizes binary, words binary, counts binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    keys, held, sizes, hashes, size = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        stream = np.concatenate(hashes)
        names, place, counts = np.unique(stream, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.uint32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(names), dtype=np.uint32)
        row = [
            [(part << 32) | made], [len(stream)], [keys], [np.concatenate(held).tobytes()], [pack(np.concatenate(sizes))],
            [pack_sorted(names)], [pack(counts.astype(np.uint32))], [pack(rank[place])],
        ]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], [f.split()[0] for f in BLOCK.split(", ")])

    for batch in bounded(batches, "text", 1 << 20):
        spans = words(batch.column("text"))
        keys += batch.column("k").to_pylist()
        held.append(batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8))
        sizes.append((np.diff(spans.first) + 1).astype(np.uint32))
        hashes.append(np.insert(spans.hashes(fold_case=True), spans.first[1:], END))
        size += len(spans.data) + 8 * batch.num_rows
        if size >= BLOCK_BYTES:
            yield flush()
            made += 1
            keys, held, sizes, hashes, size = [], [], [], [], 0
    if keys:
        yield flush()


class Grams:
    """The distinct n-grams of one order: sorted keys, and by token position the own key and that of the history."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, of: np.ndarray, before: np.ndarray, first: np.ndarray, bits: int):
        self.keys, self.at, self.of, self.before, self.first, self.bits = keys, at, of, before, first, bits

    def learnt(self, learnt: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at a position that is learnt from."""
        return np.bincount(self.of[self.at[learnt[self.at]]], minlength=len(self.keys))


class Block:
    """One block in memory: distinct words by hash, the token stream as places in them, and the n-grams of each order."""

    def __init__(self, row: dict, order: int, bits: int):
        names = unpack_sorted(row["words"])
        rank = np.argsort(-unpack(row["counts"], np.uint32).astype(np.int64), kind="stable")
        self.tokens = rank[unpack(row["tokens"], np.uint32)]
        self.sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learnt = np.repeat(~np.frombuffer(row["held"], np.uint8).astype(bool), self.sizes)
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        everywhere = np.arange(len(self.tokens))
        none = np.zeros(0, np.int64)
        self.grams = [Grams(names, everywhere, self.tokens, none, none, 64)]
        word, full = names[self.tokens], names[self.tokens]
        for n in range(2, order + 1):
            history, before = np.empty_like(full), np.empty_like(self.tokens)
            history[1:], before[1:] = full[:-1], self.grams[-1].of[:-1]
            if n == 2:  # a text begins after an end
                history[self.starts], before[self.starts] = END, np.searchsorted(names, END)
            full = mixed(mixed(history * ONE) + word * TWO)
            at = everywhere if n == 2 else np.flatnonzero(place >= n - 2)
            keys, first, inverse = np.unique(full[at] >> np.uint64(64 - bits), return_index=True, return_inverse=True)
            of = np.full(len(full), -1, np.int64)
            of[at] = inverse
            self.grams.append(Grams(keys, at, of, before, at[first], bits))

    def used_by_held(self, n: int) -> np.ndarray:
        """Which n-grams of order n are the history of a token that is not learnt from."""
        used = np.zeros(len(self.grams[n - 1].keys), bool)
        if n < len(self.grams):
            longer = self.grams[n]
            used[longer.before[longer.at[~self.learnt[longer.at]]]] = True
        return used


def _rows(table_or_batch) -> Iterator[dict]:
    yield from table_or_batch.to_pylist()


def _requests(ranges: int, order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = Block(row, order, bits)
                for n, grams in enumerate(block.grams, 1):
                    counts = (grams.learnt(block.learnt) * 2 + block.used_by_held(n)).astype(np.uint32)
                    out = [
                        (n, k, row["block"], pack_sorted(grams.keys[a:b]), pack(counts[a:b])) for k, a, b in slices(grams.keys, ranges, grams.bits)
                    ]
                    if out:
                        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
                        yield pa.RecordBatch.from_arrays(columns, ["kind", "range", "block", "names", "counts"])
                del block
                release()

    return run


ANSWER = "kind int, range int, block long, totals binary, stats array<long>"
ANSWER_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))


def _answers(rows: pa.Table) -> pa.Table:
    """Four times the total count of each n-gram a block asked for, plus two if it is a history of held-out texts, plus one where the block owns it."""
    names = [unpack_sorted(x) for x in rows["names"].to_pylist()]
    counts = np.concatenate([unpack(x, np.uint32) for x in rows["counts"].to_pylist()])
    distinct, first, place = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    total = np.bincount(place, weights=counts >> 1, minlength=len(distinct)).astype(np.uint64)
    used = np.zeros(len(distinct), np.uint64)
    used[place[counts & 1 > 0]] = 2
    answer = (total * np.uint64(4) + used)[place]
    answer[first] += np.uint64(1)
    ends = np.cumsum([len(n) for n in names]).tolist()
    kind, rng = rows["kind"][0].as_py(), rows["range"][0].as_py()
    out = [(kind, rng, b, pack(answer[e - len(n) : e]), None) for b, n, e in zip(rows["block"].to_pylist(), names, ends)]
    stats = [int((total > 0).sum()), int(total.sum()), *[int((total == r).sum()) for r in range(1, TOP + 2)]]
    out.append((kind, rng, -1, None, stats))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), ANSWER_TYPES)], names=[f.split()[0] for f in ANSWER.split(", ")])


def discounts(n: list[int]) -> np.ndarray:
    """Discount by count, from the numbers of types that occur 1, 2, .. TOP + 1 times; the last is for all higher counts.

    Where a small corpus gives no discount between 0 and 1, fewer counts are
    discounted by Good-Turing; without any, single counts are halved.
    """
    d = np.full(TOP + 2, REST)
    for top in range(TOP, 0, -1):
        if all(n[: top + 1]):
            shift = (top + 1) * n[top] / n[0]
            r = np.arange(1, top + 1)
            stars = (r + 1) * np.array(n[1 : top + 1]) / np.array(n[:top])
            found = (stars / r - shift) / (1 - shift) if shift < 1 else np.zeros(top)
            if ((found > 0) & (found < 1)).all():
                d[1 : top + 1] = found
                return d
    d[1] = 0.5
    return d


class Model:
    """Numbers of the whole corpus: types and tokens learnt, and the discounts."""

    def __init__(self, stats: list[list[int]]):
        self.types, self.tokens = stats[0][:2]
        self.d = [discounts(x[2:]) for x in stats]
        n = stats[0][2:]
        low = sum(r * n[r - 1] for r in range(1, TOP + 1))
        kept = sum(self.d[0][r] * r * n[r - 1] for r in range(1, TOP + 1)) + REST * (self.tokens - low)
        self.unknown = 1 - kept / self.tokens if self.tokens else 1.0

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        seen = self.d[0][np.minimum(counts, TOP + 1)] * counts / max(self.tokens, 1)
        return np.where(counts > 0, seen, self.unknown)

    def seen(self, n: int, counts: np.ndarray, histories: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams of order n that were learnt."""
        return self.d[n - 1][np.minimum(counts, TOP + 1)] * counts / np.maximum(histories, 1)


PARTIAL = (
    "kind int, range int, block long, keys array<long>, held binary, sizes binary, known binary, base binary, score binary, "
    "names binary, seen binary, rest binary, ask_names binary, ask_docs binary, ask_counts binary"
)
PARTIAL_NAMES = [f.split()[0] for f in PARTIAL.split(", ")]


def _partials(model: Model, ranges: int, order: int, bits: int):
    """Scores of the texts of a block but for backoff weights; per order and range what the block adds to histories and asks of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 11]
        out = []
        for row in _rows(left):
            block = Block(row, order, bits)
            grams, tokens, texts = block.grams, block.tokens, len(block.sizes)
            doc = np.repeat(np.arange(texts), block.sizes)
            told = sorted(_rows(right.select(["kind", "range", "totals"])), key=lambda r: (r["kind"], r["range"]))
            answers = [np.concatenate([unpack(r["totals"], np.uint64) for r in told if r["kind"] == n] or [np.zeros(0, np.uint64)]) for n in range(1, order + 1)]
            c = [(x >> np.uint64(2)).astype(np.int64) for x in answers]
            unigram = model.unigram(c[0])

            def direct(n: int, at: np.ndarray) -> np.ndarray:
                """Probabilities of order n at positions whose n-gram was learnt."""
                if n == 1:
                    return unigram[tokens[at]]
                return model.seen(n, c[n - 1][grams[n - 1].of[at]], c[n - 2][grams[n - 1].before[at]])

            p = np.empty(len(tokens))
            asks = {}
            open_ = np.ones(len(tokens), bool)
            for n in range(order, 1, -1):
                at = grams[n - 1].at[open_[grams[n - 1].at]]
                learnt = c[n - 1][grams[n - 1].of[at]] > 0
                p[at[learnt]] = direct(n, at[learnt])
                open_[at[learnt]] = False
                missed = at[~learnt]
                asks[n - 1] = missed[c[n - 2][grams[n - 1].before[missed]] > 0]
            p[open_] = unigram[tokens[open_]]
            base = np.log10((c[0] + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[tokens]
            docs = [np.add.reduceat(x, block.starts) for x in ((c[0][tokens] > 0).astype(np.int64), base, np.log10(p))]
            out.append((
                0, int(row["block"] % ranges), row["block"], row["keys"], row["held"], row["sizes"], *[pack(d) for d in docs], *[None] * 6,
            ))
            for n in range(2, order + 1):
                shorter, longer = grams[n - 2], grams[n - 1]
                mine = np.flatnonzero((answers[n - 1] & np.uint64(1) > 0) & (c[n - 1] > 0))
                mine = mine[answers[n - 2][longer.before[longer.first[mine]]] & np.uint64(2) > 0]
                ends, count = longer.first[mine], c[n - 1][mine]
                h = longer.before[ends]
                seen = np.bincount(h, weights=direct(n - 1, ends), minlength=len(shorter.keys))
                rest = np.bincount(h, weights=(1 - model.d[n - 1][np.minimum(count, TOP + 1)]) * count, minlength=len(shorter.keys))
                of = np.flatnonzero(rest)
                rest = rest[of] / np.maximum(c[n - 2][of], 1)
                ask = asks[n - 1]
                asked, times = np.unique(longer.before[ask] * texts + doc[ask], return_counts=True)
                ask_h, ask_doc = asked // texts, asked % texts
                given = {k: (a, b) for k, a, b in slices(shorter.keys[of], ranges, shorter.bits)}
                wanted = {k: (a, b) for k, a, b in slices(shorter.keys[ask_h], ranges, shorter.bits)}
                for k in sorted(given.keys() | wanted.keys()):
                    a, b = given.get(k, (0, 0))
                    x, y = wanted.get(k, (0, 0))
                    out.append((
                        n - 1, k, row["block"], *[None] * 6, pack_sorted(shorter.keys[of[a:b]]), pack(seen[of[a:b]]), pack(rest[a:b]),
                        pack_sorted(shorter.keys[ask_h[x:y]]), pack(ask_doc[x:y].astype(np.uint32)), pack(times[x:y].astype(np.uint32)),
                    ))
        columns = zip(*out) if out else [[] for _ in kinds]
        made = pa.table([pa.array(list(x), t) for x, t in zip(columns, kinds)], names=PARTIAL_NAMES)
        release()
        return made

    return run


def _backoff(rows: pa.Table) -> pa.Table:
    """Backoff weights of the histories of one order and range; answers each block with log weights by text. Rows of texts pass."""
    if rows["kind"][0].as_py() == 0:
        return rows
    parts = list(_rows(rows.select(["block", "names", "seen", "rest", "ask_names", "ask_docs", "ask_counts"])))
    names, place = np.unique(np.concatenate([unpack_sorted(r["names"]) for r in parts]), return_inverse=True)
    seen, rest = (
        np.bincount(place, weights=np.concatenate([unpack(r[k], np.float64) for r in parts]), minlength=len(names)) for k in ("seen", "rest")
    )
    weight = np.log10(rest / np.maximum(1 - seen, 1e-12))
    out = []
    for r in parts:
        asked = unpack_sorted(r["ask_names"])
        if len(asked):
            values = weight[np.searchsorted(names, asked)] * unpack(r["ask_counts"], np.uint32)
            docs, at = np.unique(unpack(r["ask_docs"], np.uint32), return_inverse=True)
            out.append({"kind": 1, "block": r["block"], "ask_docs": pack(docs), "score": pack(np.bincount(at, weights=values))})
    return pa.Table.from_pylist(out, schema=rows.schema)


def _finish(rows: pa.Table) -> pa.Table:
    all_rows = list(_rows(rows))
    out = []
    for r in (r for r in all_rows if r["kind"] == 0):
        known, base, score = unpack(r["known"], np.int64), unpack(r["base"], np.float64), unpack(r["score"], np.float64)
        for more in (m for m in all_rows if m["kind"]):
            np.add.at(score, unpack(more["ask_docs"], np.uint32), unpack(more["score"], np.float64))
        out.append(pa.table({
            "k": pa.array(r["keys"], pa.int64()), "held": np.frombuffer(r["held"], np.uint8).astype(bool),
            "n_tokens": unpack(r["sizes"], np.uint32).astype(np.int64), "n_known": known, "base_score": base, "score": score,
        }))
    return pa.concat_tables(out)


RESULT = "k long, held boolean, n_tokens long, n_known long, base_score double, score double"


def score(df: DataFrame, text: str = "text", key: str = "doc_id", folds: int = FOLDS, order: int = ORDER) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model of ``order`` words learns from the rows that are not held out. Null and empty texts are
    one end token. Rows that repeat stay rows of their own and are learnt as often.
    A null key counts as the empty text for the fold. If nothing is learnt, all
    words are unknown and have probability 1 together. Other columns are not read;
    an empty table gives an empty table.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), held_out(F.col(key), folds).alias("held"), filled(text).alias("text"))
    blocks = cut_lineage(rows.mapInArrow(_blocks, BLOCK), "blocks")
    tokens = blocks.agg(F.sum("n_tokens")).collect()[0][0] or 0
    ranges, bits = max(1, -(-tokens // RANGE_TOKENS)), min(64, tokens.bit_length() + CLASH_BITS)
    asked = blocks.drop("keys").mapInArrow(_requests(ranges, order, bits), "kind int, range int, block long, names binary, counts binary")
    answers = cut_lineage(asked.groupBy("kind", "range").applyInArrow(_answers, ANSWER), "answers")
    sums = answers.where("block < 0").groupBy("kind").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(TOP + 3)])
    stats = {r["kind"]: [int(r[f"s{i}"]) for i in range(TOP + 3)] for r in sums.collect()}
    model = Model([stats.get(n, [0] * (TOP + 3)) for n in range(1, order + 1)])
    told = answers.where("block >= 0").select("kind", "range", "block", "totals")
    partial = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_partials(model, ranges, order, bits), PARTIAL)
    weighed = partial.groupBy("kind", "range").applyInArrow(_backoff, PARTIAL)
    done = weighed.groupBy("block").applyInArrow(_finish, RESULT)
    return done.select(
        F.col("k").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query("op10_lm_score")
def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores of all documents."""
    return score(table(spark, sf_dir, "documents"))
