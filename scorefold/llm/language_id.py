"""Language of a text by unigram pieces, summed over all segmentations.

The vocabulary is a fixed public one: a list of byte strings that holds every single
byte, so each text can be segmented. Each language has its own probability of each piece.
The probability of a word is the sum over all ways to cut it into pieces, by the forward
algorithm; a text's is the product over its words (a piece never spans white space; a
word begins with one space). Piece probabilities are fitted by expectation and
maximisation over the words of labelled texts, with expected counts from the forward and
backward sums, one Spark job a round.

The score is the posterior of the predicted language under the shares of the languages in
the training table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.llm.common import Known, Spans, bounded, buffers, filled, fold_of, ranges, table, words
from scorefold.llm.registry import query
from scorefold.session import cut_lineage

PER_LANG = 2_000  # labelled texts of each language used for fitting, about
ROUNDS = 4
LONGEST = 12  # bytes of a piece, at most; longer ones of the vocabulary are not used
PRIOR = 0.05  # of the pooled probabilities in those of a language
FLOOR = 1e-9
FOLDS, HELD = 4, 2
KNOWN = 200_000  # words whose scores a task remembers
SPACE = np.uint8(32)


# ---------------------------------------------------------------- vocabulary

@functools.cache
def vocabulary(path: str) -> "Vocabulary":
    return Vocabulary(path)


class Vocabulary:
    """Pieces of at most LONGEST bytes, found by hash."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pieces = sorted({base64.b64decode(line.split()[0]) for line in file if line.strip()} | {bytes([b]) for b in range(256)})
        pieces = [p for p in pieces if len(p) <= LONGEST]
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        h = Spans(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends, ends).hashes()
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.size = len(pieces)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(h >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or ``size`` for none."""
        out = np.full(len(h), self.size, np.int32)
        near = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), self.size - 1)
        good = self.hashes[at] == h[near]
        out[near[good]] = self.order[at[good]]
        return out


def lattice(spans: Spans, which: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Pieces of words: [word, end, length - 1], ``size`` where there is none. Position 0 is before the leading space."""
    sizes = spans.ends[which] - spans.starts[which] + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.full(int(ends[-1]), SPACE)
    inner = np.ones(len(data), bool)
    inner[starts] = False
    raw = spans.data[ranges(spans.starts[which], sizes - 1)]
    data[inner] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    place = np.arange(len(data)) - np.repeat(starts, sizes)  # of each byte in its word
    word = np.repeat(np.arange(len(which)), sizes)
    out = np.full((len(which), int(sizes.max()), LONGEST), vocab.size, np.int32)
    for length in range(1, min(LONGEST, out.shape[1]) + 1):
        last = np.flatnonzero(place >= length - 1)
        h = Spans(data, last - (length - 1), last + 1, last).hashes()
        out[word[last], place[last], length - 1] = vocab.find(h)
    return out


def groups_of(sizes: np.ndarray, cells: int = 2_000_000) -> Iterator[np.ndarray]:
    """Words of like sizes together, as many as fit the bound of cells (one word at least)."""
    order = np.argsort(sizes, kind="stable")
    ordered, a = sizes[order], 0
    while a < len(order):
        most = int(ordered[a]) + 4
        b = min(a + max(1, cells // (LONGEST * most)), int(np.searchsorted(ordered, most, "right")))
        yield order[a:b]
        a = b


def forward(cells: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithms of the forward sums, [end + 1, word, language]; 0 at place 0, before the word.

    ``p`` has one row for each piece and a last one of zeros. All sums are kept in units
    of the newest, so that long words don't underflow.
    """
    n, longest, _ = cells.shape
    window = np.zeros((n, LONGEST, p.shape[1]))  # the last sums, the one of an end at place end % LONGEST
    window[:, -1] = 1.0
    logs, back = np.zeros((longest + 1, n, p.shape[1])), np.arange(1, LONGEST + 1)
    for end in range(longest):
        now = np.einsum("nlk,nlk->nk", window[:, (end - back) % LONGEST], p[cells[:, end]])
        now[now <= 0] = 1.0  # past the end of the word
        logs[end + 1] = logs[end] + np.log(now)
        window /= now[:, None]
        window[:, end % LONGEST] = 1.0
    return logs


def word_scores(spans: Spans, which: np.ndarray, vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log probability of each of some words in each language."""
    sizes = spans.ends[which] - spans.starts[which] + 1
    out = np.zeros((len(which), p.shape[1]))
    for group in groups_of(sizes):
        logs = forward(lattice(spans, which[group], vocab), p)
        out[group] = logs[sizes[group], np.arange(len(group))]
    return out


def expected(spans: Spans, counts: np.ndarray, vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language, for words with counts by language."""
    langs = p.shape[1]
    out = np.zeros(p.size)
    sizes = spans.ends - spans.starts + 1
    with np.errstate(divide="ignore"):
        logs_p = np.log(p)
    for group in groups_of(sizes):
        cells = lattice(spans, group, vocab)
        n, longest, _ = cells.shape
        before = forward(cells, p)
        whole = before[sizes[group], np.arange(n)]
        after = np.full((longest + 1, n, langs), -np.inf)  # logarithms of the backward sums
        after[sizes[group], np.arange(n)] = 0.0
        for end in range(longest - 1, -1, -1):
            for length in range(1, min(end + 1, LONGEST) + 1):
                piece = cells[:, end, length - 1]
                some = np.flatnonzero((piece < len(p) - 1) & (end < sizes[group]))
                if not len(some):
                    continue
                start = end + 1 - length
                use = logs_p[piece[some]] + after[end + 1, some]
                times = np.exp(before[start, some] + use - whole[some]) * counts[group[some]]
                np.add.at(out, (piece[some].astype(np.int64)[:, None] * langs + np.arange(langs)).ravel(), times.ravel())
                after[start, some] = np.logaddexp(after[start, some], use)
    return out.reshape(p.shape)


# ---------------------------------------------------------------- fitting

@dataclass
class Model:
    """Languages, logarithms of their shares, and piece probabilities with a last row of zeros."""

    langs: list[str]
    shares: np.ndarray
    p: np.ndarray
    path: str


def normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities of pieces: of each language, mixed with the pooled ones and a floor."""
    pooled = counts.sum(axis=1, keepdims=True)
    own = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1e-300)
    p = (1 - PRIOR) * own + PRIOR * pooled / max(pooled.sum(), 1e-300) + FLOOR
    p[-1] = 0
    return p / p.sum(axis=0, keepdims=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch with their language and count."""
    for batch in bounded(batches, "text", 4 << 20):
        spans = words(batch.column("text"))
        if not len(spans.starts):
            continue
        y = np.repeat(batch.column("y").to_numpy(), np.diff(spans.first))
        frame = pd.DataFrame({"h": spans.hashes(fold_case=True), "y": y, "at": np.arange(len(y))})
        found = frame.groupby(["h", "y"], sort=False)["at"].agg(["min", "size"]).reset_index()
        named = [w.lower() for w in spans.texts(found["min"].to_numpy())]  # bytes.lower() changes A-Z only
        yield pa.RecordBatch.from_arrays(
            [pa.array(named, pa.binary()), pa.array(found.y.to_numpy(), pa.int32()), pa.array(found["size"].to_numpy(), pa.int64())], ["word", "y", "n"]
        )


def _expectations(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, vocab = shared.value, vocabulary(path)
        out = np.zeros_like(p)
        for batch in batches:
            data, offsets = buffers(batch.column("word"))
            spans = Spans(data, offsets[:-1], offsets[1:], offsets)
            lists = batch.column("counts")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            pairs = lists.flatten()
            counts = np.zeros((batch.num_rows, p.shape[1]))
            counts[row, np.asarray(pairs.field("y"))] = np.asarray(pairs.field("n"))
            out += expected(spans, counts, vocab, p)
        piece, lang = np.nonzero(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(out[piece, lang])], ["piece", "y", "uses"]
        )

    return run


def fit(
    df: DataFrame, path: str, lang: str = "lang", text: str = "text", key: str = "doc_id", per_lang: int = PER_LANG,
    folds: int = FOLDS, held: int = HELD, rounds: int = ROUNDS,
) -> Model:
    """Learn from about ``per_lang`` whole texts of each language outside the held-out fold.

    The texts are those whose hash of key and text lies below a share of all hashes, so
    they are found in one pass without sorting. Rows without a language teach nothing.
    """
    learnt = df.where(F.col(lang).isNotNull() & (fold_of(F.col(key), folds) != held)).select(
        F.col(lang).alias("lang"), filled(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 31)).alias("h")
    )
    shares = {r["lang"]: r["n"] for r in learnt.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 0)), path)
    numbers = df.sparkSession.createDataFrame(
        [(name, k, int(min(1.0, per_lang / shares[name]) * (1 << 31))) for k, name in enumerate(langs)], "lang string, y int, below bigint"
    )
    rows = learnt.join(F.broadcast(numbers), "lang").where("h < below").select("text", "y")  # one row for each language
    counted = rows.mapInArrow(_counted, "word binary, y int, n bigint").groupBy("word", "y").agg(F.sum("n").alias("n"))
    listed = counted.groupBy("word").agg(F.collect_list(F.struct("y", "n")).alias("counts"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = cut_lineage(listed.repartition(parts), "lang-words")  # few bytes, much work: not to be coalesced
    vocab = vocabulary(path)
    p = np.full((vocab.size + 1, len(langs)), 1 / vocab.size)
    p[-1] = 0
    for _ in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast(p)  # pieces of the vocabulary times languages
        uses = listed.mapInArrow(_expectations(shared, path), "piece int, y int, uses double").groupBy("piece", "y").agg(F.sum("uses").alias("uses"))
        found = uses.toArrow()  # at most one row for each piece and language
        counts = np.zeros_like(p)
        counts[found["piece"].to_numpy(), found["y"].to_numpy()] = found["uses"].to_numpy()
        p = normalised(counts)
        shared.destroy()
    total = np.array([shares[name] for name in langs], float)
    return Model(langs, np.log(total / total.sum()), p, path)


# ---------------------------------------------------------------- scoring

def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocab, known = vocabulary(model.path), Known(len(model.langs), KNOWN)
        names = pa.array(model.langs, pa.string())
        for batch in bounded(batches, "__text", 4 << 20):
            spans = words(batch.column("__text"))
            sums = np.tile(model.shares, (batch.num_rows, 1))
            if len(spans.starts):
                codes, found = pd.factorize(spans.hashes(fold_case=True))
                values = np.zeros((len(found), len(model.langs)))
                old, seen = known.look_up(found)
                values[old] = seen
                new = np.flatnonzero(~old)
                if len(new):
                    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1) > 0)
                    values[new] = word_scores(spans, first[new], vocab, model.p)
                    known.add(found[new], values[new])
                full = np.flatnonzero(np.diff(spans.first))
                for k in range(len(model.langs)):
                    sums[full, k] += np.add.reduceat(values[codes, k], spans.first[:-1][full])
            best = sums.argmax(axis=1)
            score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], names.take(pa.array(best)), pa.array(score)], [*batch.schema.names[:-1], "__pred", "__score"]
            )

    return run


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text if not named), lang_pred and score.

    A null text, one without a letter, and any text if no language was learnt, is `und`
    with score 0. Equal posteriors go to the first language by name. Rows that repeat
    stay rows of their own. Columns of the names of the result are replaced by it.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score") and (keep or c != text)]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(*[F.col(f"`{c}`") for c in keep], letters.alias("__letters"), F.when(letters, F.col(text)).otherwise("").alias("__text"))
    if not model.langs:
        return rows.select(*[f"`{c}`" for c in keep], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = df.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_scored(shared), ddl + ", __pred string, __score double")
    return scored.select(
        *[f"`{c}`" for c in keep], F.when(F.col("__letters"), F.col("__pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("__letters"), F.col("__score")).otherwise(0.0).alias("score"),
    )


def vocabulary_path() -> str:
    """The vocabulary file used by the query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op13_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, vocabulary_path()), keep=["doc_id"])
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
