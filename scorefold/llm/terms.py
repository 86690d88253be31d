"""Terms of Arrow texts: maximal runs of a class of bytes, A-Z lower-cased, as an Arrow array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scorefold.llm.common import Spans, buffers

LETTERS, ALPHANUMERIC = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[128:] = LETTERS[65:91] = LETTERS[97:123] = True
ALPHANUMERIC[:] = LETTERS
ALPHANUMERIC[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms as one binary array; those of text i are first[i]:first[i + 1]. Null has none.

    ``inside`` tells for each byte whether it belongs to a term; bytes of characters
    beyond ASCII must be treated alike, so that no character is cut.
    """
    data, offsets = buffers(texts)
    keep = inside[data]
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = keep[heads]
    starts = np.flatnonzero(start)
    kept = np.cumsum(keep)
    cuts = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(_LOWER[data[keep]])])
    return found, np.searchsorted(starts, offsets)


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value."""
    data, offsets = buffers(values)
    return Spans(data, offsets[:-1], offsets[1:], offsets).hashes()


def strings(values: pa.Array) -> pa.Array:
    """A binary array of UTF-8 as strings."""
    return values.cast(pa.string())


def unified(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of several binary arrays in byte order, and the place of each value there."""
    coded = pa.concat_arrays(parts).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[np.asarray(coded.indices)]
