"""Toxic texts with a string-kernel support vector machine.

The kernel compares two words by the subsequences of three letters they share; each
occurrence counts DECAY to the power of its span, so letters pushed apart by gaps or
inserted characters still count, less. Nystroem landmarks turn it into a vector space in
which a linear machine with squared hinge loss is fitted. As the kernel is an inner
product of subsequence counts, the fitted machine is then compiled into one weight for
each subsequence, and a word is scored by adding up weights.

Labels are known for whole texts only. A word is a positive example when it stands in
toxic texts far more often than in others; copies of a text count once. A text's score is
a logistic function of its largest word margin and of the number of words past the margin.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.llm.common import Known, bounded, filled, held_out, release, table, words
from scorefold.llm.labelled import newton, training_rows
from scorefold.llm.registry import query
from scorefold.session import cut_lineage

DECAY = 0.6
SPAN = 6  # letters between the first and the last of a subsequence, at most
LETTERS = 48
MAX_WORDS = 20_000  # example words
MAX_POSITIVE = 2_000  # of them positive ones, the clearest first
LANDMARKS = 256
LONG = 24  # a longer word is cut into overlapping windows of this size
LEAST_Z = 5.0
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
INNER = re.compile(r"[\W\d_]+")
KNOWN = 200_000  # words whose margins a task remembers
SLICE = 1 << 20  # bytes of text scored together

_CODES = np.full(1 << 16, 0, np.int32)
_CODES[:] = 30 + np.arange(1 << 16) % 17
_CODES[ord("a") : ord("z") + 1] = np.arange(26)
_CODES[:97] = 47
_CODES[48:58] = 29
_CODES[94], _CODES[36] = 26, 27
OFFSETS = [(j, k) for k in range(2, SPAN + 1) for j in range(1, k)]


def letter_codes(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in the list, matrix of letter codes) for each length; words get a mark at both ends."""
    marked = [f"^{s}$" for s in strings]
    sizes = np.array([len(s) for s in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    codes = _CODES[points & 0xFFFF]
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        yield which, codes[starts[which][:, None] + np.arange(size)]


def _steps(size: int):
    for i in range(size):
        for j, k in OFFSETS:
            if i + k < size:
                yield i, i + j, i + k, DECAY ** (k + 1)


def _scale(size: int) -> float:
    return float(np.sqrt(sum(w * w for *_, w in _steps(size)))) or 1.0


def _occurrences(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(positions in the list, subsequence of each, its weight) for every pick of three letters."""
    for which, codes in letter_codes(strings):
        scale = _scale(codes.shape[1])
        for i, j, k, w in _steps(codes.shape[1]):
            yield which, (codes[:, i] * LETTERS + codes[:, j]) * LETTERS + codes[:, k], w / scale


def columns_of(strings: list[str]) -> np.ndarray:
    """A column number for each subsequence in the strings, 0 for all others."""
    columns = np.zeros(LETTERS**3, np.int32)
    for _, found, _ in _occurrences(strings):
        columns[found] = 1
    used = np.flatnonzero(columns)
    columns[used] = np.arange(1, len(used) + 1)
    return columns


def features(strings: list[str], columns: np.ndarray) -> np.ndarray:
    """Dense subsequence counts of a few words, scaled by length; column 0 stays empty."""
    out = np.zeros((len(strings), columns.max() + 1), np.float32)
    for which, found, w in _occurrences(strings):
        np.add.at(out, (which, columns[found]), w)
    out[:, 0] = 0
    return out


def products(strings: list[str], weights: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Inner product of each word's subsequence counts with weights by subsequence, or by column."""
    out = np.zeros((len(strings), *weights.shape[1:]), np.float32)
    for which, found, w in _occurrences(strings):
        out[which] += np.float32(w) * weights[found if columns is None else columns[found]]
    return out


def fit_words(positive: list[str], negative: list[str]) -> np.ndarray:
    """One weight for each subsequence and, last, the constant."""
    if not positive or not negative:
        return np.append(np.zeros(LETTERS**3), -1.0)
    heads = positive[: LANDMARKS // 2]
    columns = columns_of(heads)
    # Clean words that look most like toxic ones are landmarks and examples before any others.
    likeness = products(negative, features(heads, columns).T.copy(), columns).max(axis=1)
    negative = [negative[k] for k in np.argsort(-likeness, kind="stable")]
    spread = negative[: LANDMARKS // 4] + negative[:: max(1, len(negative) // (LANDMARKS // 4))][: LANDMARKS // 4]
    columns = columns_of(heads + spread)
    basis = features(heads + spread, columns).astype(float)
    values, vectors = np.linalg.eigh(basis @ basis.T)
    good = values > 1e-6 * values[-1]
    mapping = basis.T @ (vectors[:, good] / np.sqrt(values[good]))  # columns x dimensions
    sample = positive + negative[: MAX_WORDS // 2] + negative[MAX_WORDS // 2 :: 4]
    X = products(sample, mapping.astype(np.float32), columns)
    y = np.where(np.arange(len(sample)) < len(positive), 1.0, -1.0)
    weight = np.where(y > 0, 20.0 / len(positive), 20.0 / (len(sample) - len(positive)))
    w = newton(X, y, weight, 1e-3, "hinge")
    full = (mapping @ w[:-1])[columns]
    full[columns == 0] = 0
    return np.append(full, w[-1])


@dataclass
class Model:
    """Weights of subsequences, and of the three features of a text with their constant."""

    words: np.ndarray
    texts: np.ndarray


def windows(word: str) -> list[str]:
    """The strings scored for one word: without marks at its ends; also without anything but letters."""
    plain = EDGE.sub("", word)
    bare = INNER.sub("", plain)
    out = [plain] if bare == plain or not bare else [plain, bare]
    return [w[i : i + LONG] for w in out for i in (range(0, len(w) - LONG // 2, LONG // 2) if len(w) > LONG else (0,))]


def word_margins(found: list[str], weights: np.ndarray) -> np.ndarray:
    """The largest margin over the windows of each word."""
    parts = [windows(w) for w in found]
    sizes = np.array([len(p) for p in parts])
    flat = [s for p in parts for s in p]
    if not flat:
        return np.zeros(0)
    margins = products(flat, weights[:-1]) + weights[-1]
    return np.maximum.reduceat(margins, np.cumsum(sizes) - sizes)


def _spelled(spans, lone: np.ndarray) -> list[tuple[int, str]]:
    """(text number, word) for runs of three or more words of one letter."""
    raw = spans.data
    if len(lone) < 3:
        return []
    follows = lone[1:] & lone[:-1]
    heads = spans.first[1:-1]
    follows[heads[(heads > 0) & (heads < len(lone))] - 1] = False  # a run ends with its text
    edges = np.flatnonzero(np.diff(np.concatenate([[0], follows.astype(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2] + 1
    long = end - begin >= 3
    texts = np.searchsorted(spans.first, begin[long], "right") - 1
    return [
        (text, raw[spans.starts[a:b]].tobytes().decode("ascii").lower())
        for text, a, b in zip(texts.tolist(), begin[long].tolist(), end[long].tolist())
    ]


def text_features(df: DataFrame, weights: np.ndarray, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and, of each whole text: largest margin, words past the margin, their share."""
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    column = text if text in keep else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = Known(1, KNOWN)
        for batch in bounded(batches, column, SLICE):
            spans = words(batch.column(column))
            codes, names = pd.factorize(spans.hashes(fold_case=True))
            n = batch.num_rows
            top, past = np.full(n, -2.0), np.zeros(n)
            counts = np.diff(spans.first)
            if len(names):
                first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1) > 0)
                old, seen = known.look_up(names)
                values = np.zeros((len(names), 1))
                values[old] = seen
                new = np.flatnonzero(~old)
                if len(new):
                    margins = word_margins([t.decode("utf-8", "replace").lower() for t in spans.texts(first[new])], shared.value)
                    values[new, 0] = margins
                    known.add(names[new], values[new])
                margin = values[codes, 0]
                full = counts > 0
                top[full] = np.maximum.reduceat(margin, spans.first[:-1][full])
                past[full] = np.add.reduceat((margin > 0).astype(float), spans.first[:-1][full])
                lone = (spans.ends - spans.starts == 1) & (spans.data[spans.starts] < 128)
                spelled = _spelled(spans, lone)
                for (row, _), m in zip(spelled, word_margins([w for _, w in spelled], shared.value)):
                    top[row] = max(top[row], m)
                    past[row] += m > 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(top), pa.array(np.log1p(past)), pa.array(past / np.maximum(counts, 1))],
                [*batch.schema.names[: len(keep)], "__top", "__past", "__share"],
            )

    # A kept text is read where it stands, with null as empty; it is not sent twice.
    rows = df.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [filled(text).alias("__text")]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, ddl + ", __top double, __past double, __share double")


def _text_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct words of each text, with a number that near copies of the text mostly share."""
    for part in parts:
        out: list[tuple[int, int, str]] = []
        for y, text in zip(part.y, part.text):
            found = {EDGE.sub("", w) for w in set(text.lower().split())}
            copy = min((zlib.crc32(w.encode("utf-8", "replace")) for w in found if len(w) >= 5), default=0)
            out += [(y, copy, w) for w in found if 2 <= len(w) <= LONG]
        yield pd.DataFrame(out, columns=["y", "copy", "w"])


def example_words(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """Positive words, the clearest first, and a table of negative words; near copies of a text count once."""
    per = rows.mapInPandas(_text_words, "y int, copy long, w string").distinct()
    counts = cut_lineage(per.groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")), "words")
    rate = rows.agg(F.avg("y")).collect()[0][0]
    if not rate or rate == 1:
        return [], counts.where("false")
    spread = F.sqrt((F.col("p") + F.col("n")) * rate * (1 - rate))
    ranked = counts.withColumn("z", (F.col("p") - (F.col("p") + F.col("n")) * rate) / spread)
    clear = (F.col("z") >= LEAST_Z) & (F.col("p") >= 10 * F.col("n")) & (F.col("p") >= 3)
    positive = ranked.where(clear).orderBy(F.desc("z"), "w").limit(MAX_POSITIVE).collect()
    return [r["w"] for r in positive], ranked.where((F.col("n") > 0) & (F.col("z") < 1)).select("w")


def fit_on_words(positive: list[str], negative: DataFrame) -> np.ndarray:
    """Fit on a sample of negative words, then once more with those that the first machine finds most toxic."""
    sample = [r["w"] for r in negative.orderBy(F.xxhash64("w")).limit(MAX_WORDS).collect()]
    weights = fit_words(positive, sample)
    if not positive or not sample:
        return weights
    shared = negative.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def margin(w: pd.Series) -> pd.Series:
        return pd.Series(word_margins(w.tolist(), shared.value))

    hard = negative.repartition(32).orderBy(margin("w").desc(), "w").limit(MAX_WORDS // 2).collect()
    return fit_words(positive, list(dict.fromkeys([r["w"] for r in hard] + sample)))


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", folds: int = 5) -> Model:
    """Learn from at most MAX_TRAIN labelled rows whose key is not held out."""
    rows = training_rows(df, labels, label, text, key, folds)
    weights = fit_on_words(*example_words(rows))
    seen = text_features(rows, weights, "text", ["y"]).toPandas()
    if seen.y.nunique() < 2:
        return Model(weights, np.array([0.0, 0.0, 0.0, -3.0]))
    X, y = seen[["__top", "__past", "__share"]].to_numpy(float), np.where(seen.y == 1, 1.0, -1.0)
    return Model(weights, newton(X, y, np.ones(len(y)), 1e-2, "logistic"))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, to: str = "score") -> DataFrame:
    """The kept columns (all but the text if not named) and the score, from 0 to 1.

    Null counts as the empty text; an empty text has a score too. Rows that repeat
    stay rows of their own.
    """
    a, b, c, d = [float(x) for x in model.texts]
    rows = text_features(df, model.words, text, [c for c in df.columns if c != text] if keep is None else keep)
    logit = a * F.col("__top") + b * F.col("__past") + c * F.col("__share") + d
    return rows.withColumn(to, 1 / (1 + F.exp(-logit))).drop("__top", "__past", "__share")


def accepted(df: DataFrame, model: Model, text: str = "text", below: float = 0.5) -> DataFrame:
    """The rows whose text scores less than ``below``, all columns unchanged."""
    scored = score(df, model, text, df.columns, "__score")
    return scored.where(F.col("__score") < below).drop("__score")


@query("op7_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
