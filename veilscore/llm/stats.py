"""Document statistics counted on bytes, whole texts, many documents at a time.

Words are runs of anything but ASCII white space.  All counts are exact integers,
so they do not depend on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import IS_SPACE, Chunk, id_and_text, mix, per_document, runs, sums, text_chunks, word_hashes

#: Byte classes: 0 other ASCII, 1 white space, 2 upper, 3 lower, 4 digit, 5 symbol,
#: 6 punctuation, 7 first byte of a non-ASCII code point, 8 further bytes.
CLASSES = 9
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?\"'()-"
_CLASS = np.zeros(256, np.int64)
_CLASS[IS_SPACE] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x61:0x7B] = 3
_CLASS[0x30:0x3A] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[list(PUNCTUATION)] = 6
_CLASS[0x80:0xC0] = 8
_CLASS[0xC0:] = 7

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_distinct", "n_upper", "n_letters", "n_digits", "n_punctuation", "n_wide")


def _same_before(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: whether an equal one exists, and whether one comes earlier."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    shared, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    shared[order[1:]] |= equal
    shared[order[:-1]] |= equal
    later[order[1:]] = equal
    return shared, later


def _keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document."""
    with np.errstate(over="ignore"):
        return mix(hashes ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def count_chunk(chunk: Chunk) -> np.ndarray:
    """One row of ``COUNTS`` per document."""
    data, offsets, n = chunk.data, chunk.offsets, chunk.n
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    classes = np.bincount(owner * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)

    starts, ends = runs(~IS_SPACE[data], offsets)
    first = per_document(starts, offsets)
    words = word_hashes(data, starts, ends)
    of_word = np.repeat(np.arange(n), np.diff(first))
    _, seen = _same_before(_keyed(words, of_word))

    repeated = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        last = len(words) - WINDOW + 1
        whole = of_word[:last] == of_word[WINDOW - 1:]
        with np.errstate(over="ignore"):
            gram = np.zeros(last, np.uint64)
            for j in range(WINDOW):
                gram = gram * np.uint64(0xD6E8FEB86659FD93) + words[j:j + last]
        at = np.flatnonzero(whole)
        shared, _ = _same_before(_keyed(mix(gram[at]), of_word[at]))
        np.add.at(repeated, at[shared], 1)
        np.add.at(repeated, at[shared] + WINDOW, -1)
    covered = np.cumsum(repeated[:-1]) > 0

    lines, dups = _lines(chunk)
    out = np.empty((n, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(first)
    out[:, 1] = size - classes[:, 1] - classes[:, 8]
    out[:, 2] = classes[:, 5]
    out[:, 3], out[:, 4] = lines, dups
    out[:, 5] = sums(covered, first)
    out[:, 6] = out[:, 0] - sums(seen, first)
    out[:, 7] = classes[:, 2]
    out[:, 8] = classes[:, 2] + classes[:, 3] + classes[:, 7]
    out[:, 9] = classes[:, 4]
    out[:, 10] = classes[:, 6]
    out[:, 11] = classes[:, 7]
    return out


def _lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one."""
    raw, at = chunk.data.tobytes(), chunk.offsets.tolist()
    lines, dups = np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64)
    for i in range(chunk.n):
        full = [x for x in raw[at[i]:at[i + 1]].split(b"\n") if x.strip()]
        lines[i], dups[i] = len(full), len(full) - len(set(full))
    return lines, dups


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, <COUNTS>)``, one row per input row; null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(COUNTS)), np.int64)
            for chunk in text_chunks(batch.column(1)):
                out[chunk.first:chunk.first + chunk.n] = count_chunk(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(out[:, k].copy()) for k in range(len(COUNTS))]],
                ["doc_id", *COUNTS])

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{c} long" for c in COUNTS]]))
