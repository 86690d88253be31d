"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

A task gathers the distinct pieces of its texts, encodes each piece once and puts the
documents together from them. Encoding keeps an index from each pair's rank to all its
positions in the task. Active ranks are applied in ascending order: all positions of a
rank are merged at once, then the lists of the neighbouring pairs are updated.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.llm.common import Spans, bounded, buffers, ranges, spaced_words, table, words
from scorefold.llm.registry import query

GROUP_BYTES = 6 << 20  # texts that share one index of distinct pieces
ODD = re.compile(rb"[\x00-\x1f\xc2\xe1-\xe3]|.[ ]|<\|")  # may hold white space inside, or a special token
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Ids, merges and pieces of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_word = bool(suffix)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max([*ids.values(), *self.special.values()]) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.twin = np.array([a == b for a, b in merges])
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + suffix] for c in letters], np.int32)
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        if self.by_word:
            cut = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        else:
            cut = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern, self.joined_pattern = regex.compile(cut), regex.compile(r"\n|" + cut)
        back = {c: b for b, c in enumerate(letters)}
        plain = {i: bytes(back[c] for c in t.removesuffix(suffix) if c in back) for t, i in ids.items()}
        plain |= {i: s.encode() for s, i in self.special.items()}
        parts = [plain.get(i, b"") for i in range(self.size)]
        self.token_sizes = np.array([len(p) for p in parts], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(parts), np.uint8)

    def spans(self, texts: pa.Array) -> Spans:
        return words(texts) if self.by_word else spaced_words(texts)

    def pieces(self, chunk: bytes) -> list[str | int]:
        """What is merged apart in one chunk of text; special tokens as their ids."""
        out: list[str | int] = []
        for part in self.special_cut.split(chunk.decode()):
            out += [self.special[part]] if part in self.special else self.pattern.findall(self._normal(part))
        return out

    def _normal(self, text: str) -> str:
        if not self.by_word:
            return text
        # A capital sigma has one small form here, at the end of a word too.
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def all_pieces(self, chunks: list[bytes]) -> tuple[np.ndarray, list[str | int], np.ndarray]:
        """Codes of the pieces of all chunks, the distinct pieces, and the number of pieces of each chunk.

        Chunks without white space inside are cut in one text with line feeds between them.
        """
        odd = [k for k, c in enumerate(chunks) if ODD.search(c)]
        plain = np.ones(len(chunks), bool)
        plain[odd] = False
        joined = b"\n".join(c for c, p in zip(chunks, plain.tolist()) if p).decode() + "\n"
        found = self.joined_pattern.findall(self._normal(joined)) if plain.any() else []
        counts = np.zeros(len(chunks), np.int64)
        codes, names = pd.factorize(np.array(found, object))
        names = list(names)
        if plain.any():
            feed = names.index("\n")
            at = np.flatnonzero(codes == feed)
            counts[plain] = np.diff(at, prepend=-1) - 1
            codes = codes[codes != feed]
        if odd:
            numbers = {n: k for k, n in enumerate(names)}
            parts = [self.pieces(chunks[k]) for k in odd]
            counts[odd] = [len(p) for p in parts]
            more = np.array([numbers.setdefault(x, len(numbers)) for p in parts for x in p], np.int64)
            names = list(numbers)
            whole = np.empty(int(counts.sum()), np.int64)
            from_odd = np.repeat(~plain, counts)
            whole[from_odd], whole[~from_odd] = more, codes
            codes = whole
        return codes, names, counts

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where there is no merge; id -1 ends a piece."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (b >= 0), self.order[at], NONE).astype(np.int32)

    def merge(self, pieces: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and where the ids of each piece begin (one more for the end)."""
        sizes = np.array([1 if isinstance(p, int) else len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(b"\0" if isinstance(p, int) else p for p in pieces), np.uint8)
        n = len(data)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends = bounds[1:][sizes > 0] - 1
        sym = np.append(self.inner[data], np.int32(-1))
        sym[ends] = self.last[data[ends]]
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends] = n
        prv[bounds[:-1][sizes > 0]] = n
        for k in [k for k, p in enumerate(pieces) if isinstance(p, int)]:
            sym[bounds[k]] = pieces[k]
        rank = np.append(self.rank(sym[:-1], sym[nxt[:-1]]), np.int32(NONE))
        gone = np.zeros(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(pos: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            pos, ranks = pos[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            first = 0
            for r, end in zip(ranks[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(pos)]):
                if r in index:
                    index[r].append(pos[first:end])
                else:
                    index[r] = [pos[first:end]]
                    heapq.heappush(active, r)
                first = end

        found = np.flatnonzero(rank != NONE)
        if len(found):
            enlist(found, rank[found])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            pos = np.concatenate(lists) if len(lists) > 1 else lists[0]
            pos = pos[rank[pos] == r]  # a position listed twice is merged once: each write below repeats itself
            if not len(pos):
                continue
            if self.twin[r]:  # in a run of one symbol every second position is merged
                pos = np.unique(pos)
                here = np.arange(len(pos))
                linked = np.append(False, pos[1:] == nxt[pos[:-1]])
                pos = pos[(here - np.maximum.accumulate(np.where(linked, 0, here))) % 2 == 0]
            other = nxt[pos]
            after = nxt[other]
            sym[pos] = self.made[r]
            nxt[pos] = after
            prv[after] = pos
            rank[other] = NONE
            gone[other] = True
            left = prv[pos]
            near = np.concatenate([pos, left[left < n]])
            ranks = self.rank(sym[near], sym[nxt[near]])
            rank[near] = ranks
            some = ranks != NONE
            if some.any():
                enlist(*(x[some] for x in (near, ranks)))
        stay = ~gone
        return sym[:-1][stay], np.concatenate([[0], np.cumsum(stay)])[bounds]

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk and where they begin; equal pieces are merged once."""
        which, names, counts = self.all_pieces(chunks)
        ids, begin = self.merge([n if isinstance(n, int) else n.encode() for n in names])
        sizes = begin[which + 1] - begin[which] if len(which) else np.zeros(0, np.int64)
        flat = ids[ranges(begin[which], sizes)] if len(which) else np.zeros(0, np.int32)
        piece_starts = np.concatenate([[0], np.cumsum(sizes)])
        chunk_ends = np.concatenate([[0], np.cumsum(counts)])
        return flat, piece_starts[chunk_ends]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Distinct:
    """Numbers the distinct spans of several batches."""

    def __init__(self) -> None:
        self.numbers: dict[int, int] = {}
        self.texts: list[bytes] = []

    def codes(self, spans: Spans) -> np.ndarray:
        local, names = pd.factorize(spans.hashes())
        if not len(names):
            return np.zeros(0, np.int32)
        first = np.flatnonzero(np.diff(np.maximum.accumulate(local), prepend=-1) > 0)
        numbers, fresh = self.numbers, []
        out = np.empty(len(names), np.int32)
        for k, name in enumerate(names.tolist()):
            number = numbers.get(name)
            if number is None:
                number = numbers[name] = len(numbers)
                fresh.append(k)
            out[k] = number
        self.texts += spans.texts(first[fresh])
        return out[local]


def encoded(batches: Iterator[pa.RecordBatch], column: str, vocab: Vocabulary, limit: int = GROUP_BYTES):
    """For each slice of the batches: the slice, the ids of all its texts, and where each text's ids begin.

    Slices hold about 1 MB; those of about ``limit`` bytes share one encoding of
    their distinct chunks. A longer text is one slice.
    """

    def flush(held, distinct):
        ids, begin = vocab.encode(distinct.texts)
        for batch, codes, first in held:
            sizes = begin[codes + 1] - begin[codes]
            flat = ids[ranges(begin[codes], sizes)]
            yield batch, flat, np.concatenate([[0], np.cumsum(sizes)])[first]

    held, distinct, size = [], Distinct(), 0
    for batch in bounded(batches, column, 1 << 20):
        spans = vocab.spans(batch.column(column))
        held.append((batch, distinct.codes(spans), spans.first))
        size += len(spans.data)
        if size >= limit:
            yield from flush(held, distinct)
            held, distinct, size = [], Distinct(), 0
    if held:
        yield from flush(held, distinct)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids of every whole text: key, ids (binary, little-endian unsigned 32-bit), n_tokens.

    Null and empty texts give empty ids. One row per input row; other columns are
    not read. Strings of special tokens in a text become their ids, as the
    tokenizers library does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, begin in encoded(batches, "text", vocabulary(path)):
            raw = ids.astype("<u4").tobytes()
            begin = begin.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([raw[4 * a : 4 * b] for a, b in zip(begin, begin[1:])], pa.binary()),
                 pa.array(np.diff(begin), pa.int64())], ["k", "ids", "n_tokens"],
            )

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, ids binary, n_tokens long").withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns and the text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in bounded(batches, ids, 1 << 20):
            raw, offsets = buffers(batch.column(at))
            tokens = raw.view("<u4")
            sizes = vocab.token_sizes[tokens]
            data = vocab.token_bytes[ranges(vocab.token_starts[tokens], sizes)].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)])[offsets // 4].tolist()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{to}` string")


@query("op9_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text of documents, then decode its ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
