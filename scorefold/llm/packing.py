"""Pack tokenised documents into windows of a fixed size by best-fit decreasing.

A document longer than a window is first cut into full windows; its rest is a piece
like any other. Pieces are dealt at random into groups of about GROUP_PIECES, each
packed by one task: longest piece first, each into the tightest open window that
still holds it. A segment tree over the remaining capacities finds that window in
log2(size) steps. Groups need nothing of each other, so the work grows with the
number of pieces alone; at most a window or so a group stays badly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorefold.llm.bpe import encoded, vocabulary
from scorefold.llm.common import release, table
from scorefold.llm.registry import query
from scorefold.session import cut_lineage

WINDOW = 4096
END_ID = 2
GROUP_PIECES = 50_000


class OpenWindows:
    """Open windows by remaining capacity; a segment tree tells which capacities have one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.held[capacity].append(window)
        node = capacity + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove a window of the least capacity that holds ``length``: (capacity, window)."""
        some, node = self.some, length + self.leaves
        if not some[node]:
            while node > 1 and (node & 1 or not some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        windows = self.held[capacity]
        window = windows.pop()
        if not windows:
            while node and not (node < self.leaves and (some[2 * node] or some[2 * node + 1])):
                some[node] = 0
                node >>= 1
        return capacity, window


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` must be in descending order."""
    tree, windows, offsets, made = OpenWindows(size), [], [], 0
    for length in lengths:
        found = tree.take(length) if length < size else None
        if found is None:
            capacity, window = size, made
            made += 1
        else:
            capacity, window = found
        windows.append(window)
        offsets.append(size - capacity)
        if capacity > length:
            tree.add(capacity - length, window)
    return windows, offsets


def pieces(df: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text: key, start, length, ids_crc32, doc_tokens and, on demand, ids.

    A null or empty text is one piece that holds the end id. Rows that repeat stay
    rows of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, ids, begin in encoded(batches, "text", vocabulary(path)):
            rows, starts, lengths, crcs, totals, raws = [], [], [], [], [], []
            raw, end = ids.astype("<u4").tobytes(), np.uint32(end_id).astype("<u4").tobytes()
            for row, (a, b) in enumerate(zip(begin.tolist(), begin.tolist()[1:])):
                doc = raw[4 * a : 4 * b] + end
                for start in range(0, b - a + 1, window):
                    part = doc[4 * start : 4 * (start + window)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(b - a + 1)
                    if with_ids:
                        raws.append(part)
            columns = [batch.column("k").take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            names = ["k", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(raws, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    ddl = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, ddl).withColumnRenamed("k", key)


def pack(df: DataFrame, key: str = "doc_id", window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All columns of the pieces, and the sequence_id and offset of each.

    Sequences are gapless from 0 and hold at most ``window`` tokens. An empty table
    gives an empty table.
    """
    groups = max(1, -(-df.count() // group_pieces))
    dealt = df.repartition(groups, F.xxhash64(key, "start", "ids_crc32")).withColumn("group", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        # A full order, so that a task that runs again gives the same windows.
        order = [("length", "descending"), *((c, "ascending") for c in (key, "start", "ids_crc32"))]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        windows, offsets = best_fit(rows["length"].to_pylist(), window)
        group = np.int64(rows["group"][0].as_py()) << 32
        rows = rows.drop_columns("group").append_column("sequence_id", pa.array(group + np.array(windows, np.int64)))
        yield from rows.append_column("offset", pa.array(offsets, pa.int64())).to_batches(max_chunksize=10_000)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return dealt.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents in windows; tokens are made once and kept as a narrow table."""
    return pack(cut_lineage(pieces(df, path, text=text, key=key), "pieces"), key)


def vocabulary_path() -> str:
    """The vocabulary file used by the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
