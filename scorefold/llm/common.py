"""Helpers that several operators share: tables, text columns, word hashes over Arrow buffers."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; the fast path is for texts without other letters."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def held_out(key: Column, folds: int) -> Column:
    return fold_of(key, folds) == 0


# ---------------------------------------------------------------- words of Arrow text

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_POWERS: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of the input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text array and the offset of each text in them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Spans:
    """Spans of bytes in order; those of text i are first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each span's bytes, A-Z lower-cased on demand."""
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold_case else _BYTES)[self.data] * up[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mixed(h + (self.ends - self.starts).astype(np.uint64))

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def _spans(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Spans:
    return Spans(data, starts, ends, np.searchsorted(starts, offsets))


def words(texts: pa.Array) -> Spans:
    """The maximal runs of bytes that are not white space."""
    data, offsets = buffers(texts)
    inside = ~_IS_WHITE[data]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = inside[lasts]
    return _spans(data, offsets, np.flatnonzero(start), np.flatnonzero(end) + 1)


_MAY_OPEN_WHITE = np.zeros(256, bool)
_MAY_OPEN_WHITE[list(WHITE) + [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MAY_CLOSE_WHITE = np.zeros(256, bool)
_MAY_CLOSE_WHITE[list(WHITE) + [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True


def spaced_words(texts: pa.Array) -> Spans:
    """Cut each text before single spaces between two visible characters; the pieces make up the whole text.

    Bytes that may belong to other white space never stand at a cut.
    """
    data, offsets = buffers(texts)
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        cut[1:-1] = (data[1:-1] == 32) & ~_MAY_CLOSE_WHITE[data[:-2]] & ~_MAY_OPEN_WHITE[data[2:]]
    full = offsets[:-1] < offsets[1:]
    heads, lasts = offsets[:-1][full], offsets[1:][full] - 1
    cut[lasts] = False
    cut[heads] = True
    starts = np.flatnonzero(cut)
    return _spans(data, offsets, starts, np.append(starts[1:], len(data)))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges starts[i] .. starts[i] + counts[i], one range after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


_C = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system: Python workers serve later stages too, beside the memory of the JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def bounded(batches, column: str, limit: int = 8 << 20):
    """Slice record batches so that each holds about ``limit`` bytes of text, whole rows only."""
    for batch in batches:
        sizes = np.diff(buffers(batch.column(column))[1]) if batch.num_rows else np.zeros(0)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Known:
    """Values of words by hash, of at most ``limit`` words: sorted arrays, a few bytes a word."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, self.width))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and the values of those that are."""
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        good = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        return good, self.values[at[good]]

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        if len(self.hashes) + len(h) > self.limit:
            self.clear()
        h, values = np.concatenate([self.hashes, h[:self.limit]]), np.concatenate([self.values, values[:self.limit]])
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order]
