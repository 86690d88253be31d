"""Bloom filters built by Spark: 16 bits a row, at most 2^MAX_BITS bits (128 MiB) whatever the rows.

Tasks send only the positions they set, by block; blocks are merged apart. A filter that
is too small for its rows says "maybe" more often and is never wrong about "no".
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS_PER_ROW = 16
MAX_BITS = 30
BLOCK_BITS = 18


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.view(np.uint64)
    other = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return np.stack([h >> np.uint64(64 - bits), other >> np.uint64(64 - bits)]).astype(np.int64)


def _local_bits(bits: int):
    """Of each task: the positions hit once and more than once, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            pos, hits = np.unique(np.concatenate(held), return_counts=True)
            blocks = pos >> BLOCK_BITS
            names, first = np.unique(blocks, return_index=True)
            inside = (pos & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            once, twice = [], []
            for a, b in zip(first, [*first[1:], len(pos)]):
                many = hits[a:b] > 1
                once.append(inside[a:b][~many].tobytes())
                twice.append(inside[a:b][many].tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                ["block", "once", "twice"],
            )

        rows = 0
        for batch in batches:
            held.append(_positions(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel())
            rows += batch.num_rows
            if rows >= 4_000_000:
                yield flush()
                rows = 0
        if rows:
            yield flush()

    return run


def _merge_bits(repeated: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
        for once, twice in zip(rows.once, rows.twice):
            once, twice = np.frombuffer(once, np.uint32), np.frombuffer(twice, np.uint32)
            again[once] |= seen[once]
            seen[once] = True
            seen[twice] = again[twice] = True
        return pd.DataFrame({"block": rows.block[:1], "bits": [np.packbits(again if repeated else seen).tobytes()]})

    return run


def _filter(hashes: DataFrame, rows: int, repeated: bool):
    bits = min(MAX_BITS, max(BLOCK_BITS, math.ceil(math.log2(max(rows, 1) * BITS_PER_ROW))))
    parts = hashes.mapInArrow(_local_bits(bits), "block long, once binary, twice binary")
    blocks = parts.groupBy("block").applyInPandas(_merge_bits(repeated), "block long, bits binary").collect()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for row in blocks:
        at = row["block"] << (BLOCK_BITS - 3)
        bitmap[at : at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(row["bits"], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        found = np.ones(len(h), bool)
        for pos in _positions(h.to_numpy(np.int64), bits):
            found &= (shared.value[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return maybe


def repeated_filter(hashes: DataFrame, rows: int):
    """A function that tells which 64-bit hashes of the one-column table may occur more than once."""
    return _filter(hashes, rows, True)


def member_filter(hashes: DataFrame, rows: int):
    """A function that tells which 64-bit hashes may be in the one-column table."""
    return _filter(hashes, rows, False)
