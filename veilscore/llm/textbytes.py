"""UTF-8 text columns as NumPy bytes inside Arrow batches.

``mapInArrow`` hands every task its rows as Arrow batches; a string column is
one byte buffer plus offsets, so whole texts are scanned with NumPy without a
Python string per row.  ``text_chunks`` cuts a batch into runs of whole
documents of about ``max_bytes`` bytes, so temporaries stay small however many
rows a batch has; a single longer document is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19

# ASCII white space: space, tab, line feed, vertical tab, form feed, return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# ASCII lower-casing of A-Z only; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass(frozen=True)
class Chunk:
    """Whole documents ``first .. first + len(offsets) - 2`` of a batch.

    ``data`` holds their bytes back to back, ``offsets[i]:offsets[i + 1]`` is
    document ``i``; a null text has no bytes.
    """
    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole documents of a string column (null texts count as empty)."""
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32,
                            n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        stop = min(n, max(row + 1, stop))
        yield Chunk(row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of the maximal runs of true bytes; no run crosses
    a document border."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(member)
    before[0] = False
    before[1:] = member[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(member)]
    before[inner] = False
    after = np.empty_like(member)
    after[-1] = False
    after[:-1] = member[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def per_document(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index ``first[i]:first[i + 1]`` into sorted ``positions`` for document i."""
    return np.searchsorted(positions, offsets, "left")


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Exact integer sums of ``values[first[i]:first[i + 1]]`` (empty: 0)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def common_beginnings(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many leading values row i and row i + 1 have in common; row i is
    ``values[first[i]:first[i + 1]]``."""
    size = np.diff(first)
    both = np.minimum(size[:-1], size[1:])
    start = np.cumsum(both) - both
    where = np.repeat(first[:-2] - start, both) + np.arange(both.sum())
    differs = np.flatnonzero(values[where] != values[where + np.repeat(size[:-1], both)])
    differs = np.append(differs, 1 << 60)
    return np.minimum(differs[np.searchsorted(differs, start)] - start, both)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every code point."""
    return (data & 0xC0) != 0x80


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One 64-bit polynomial hash per word (bytes, little powers first)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    longest = int(length.max())
    mult = np.uint64(0x5851F42D4C957F2D)
    out = np.full(len(starts), np.uint64(seed), np.uint64)
    if longest <= 64:                       # words: a step per byte position
        with np.errstate(over="ignore"):
            live = np.arange(len(starts))
            for k in range(longest):
                live = live[length[live] > k]
                out[live] = out[live] * mult + data[starts[live] + k].astype(np.uint64) + np.uint64(1)
    else:                                   # very long tokens: short ones as above
        short = length <= 64
        out[short] = word_hashes(data, starts[short], ends[short], seed)
        for i in np.flatnonzero(~short):
            out[i] = _long_hash(data[starts[i]:ends[i]], seed)
        return out
    return mix(out ^ (length.astype(np.uint64) << np.uint64(48)))


def _long_hash(word: np.ndarray, seed: int) -> np.uint64:
    import xxhash
    return np.uint64(xxhash.xxh64_intdigest(word.tobytes(), seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; any other column is left out, so names
    of extra columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
