"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at Hamming distance at most 3 meet half-way: each one
emits every variant within half the radius (0 or 1 flipped bits) and equal
variants bring the pair together.  One-bit balls reach distance 2; the third bit
is covered by leaving out one of four 16-bit blocks at a time: of up to three
differing bits at least one lies in some block, and on the other 48 bits the two
balls meet.  So a fingerprint emits 4 x (1 + 48) variants of 48 bits instead of
the 2,081 of a full two-bit ball, and still no pair is lost.

Fingerprints are deduplicated before (copies cost nothing), variants are
shuffled once, and colliding pairs are verified on the 16 left-out bits.  A
variant has at most 49 x 65,536 members whatever the input, and linking inside a
variant looks up the few neighbours of each member instead of comparing all
pairs, so dense groups cost a bounded number of look-ups per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import stored
from .textbytes import id_and_text, text_chunks

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
_LOW = (1 << BLOCK_BITS) - 1
_STEP_ROWS = 1 << 18


# ------------------------------------------------------------- fingerprints
def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 (seed 42) of every shingle of the lower-cased words, repeats kept."""
    tokens = text.lower().split()            # bytes: ASCII case and white space only
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, HASH_SEED)]
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], HASH_SEED)
            for i, j in zip(starts[:len(tokens) - words + 1].tolist(), ends[words - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """Bit b is set when more than half of the hashes have it (none: 0)."""
    if not hashes:
        return 0
    n, ones = len(hashes), np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, n, 1 << 16):           # bounded temporaries for very long texts
        part = values[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp long)`` — one row per input row, whole texts.

    Null, empty and blank texts get fingerprint 0.  The 64 bits are stored in a
    signed long.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for chunk in text_chunks(batch.column(1)):
                raw = chunk.data.tobytes()
                at = chunk.offsets.tolist()
                for i in range(chunk.n):
                    out[chunk.first + i] = fingerprint(shingle_hashes(raw[at[i]:at[i + 1]], words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fp long")


# ------------------------------------------------------------------ linking
def _rotated(fp: np.ndarray, block: np.ndarray | int) -> np.ndarray:
    """``fp`` rotated right so that the given 16-bit block comes last."""
    shift = np.asarray(block, np.uint64) * np.uint64(BLOCK_BITS)
    back = (np.uint64(64) - shift) & np.uint64(63)
    return (fp >> shift) | (fp << back)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fingerprint and left-out block: the 48 kept bits as they are and with
    one bit flipped.  The last 16 bits of a key hold the block's number."""
    flips = np.array([0, *(1 << b for b in range(BLOCK_BITS, 64))], np.uint64)
    blocks = np.arange(BLOCKS)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 4096):
            fp = fps[i:i + 4096]
            kept = _rotated(fp[:, None], blocks) & ~np.uint64(_LOW) | blocks.astype(np.uint64)
            key = kept[:, :, None] ^ flips
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)),
                 pa.array(np.repeat(fp, BLOCKS * len(flips)).view(np.int64))], ["key", "fp"])


def _masks(weight: int) -> np.ndarray:
    """Every 16-bit word with ``weight`` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), weight)],
                    np.int64)


def link_sorted(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints within 3 bits that share a variant.

    ``key`` is sorted, its runs are complete.  In a run every member differs from
    the variant in at most one kept bit, so two members differ there in at most
    two bits; whether they link depends on their 16 left-out bits:

    * equal or one bit apart: always (distance at most 3);
    * two bits apart: if one of the two equals the variant;
    * three bits apart: if both do.

    Members with equal left-out bits all link, so one of them stands for the rest.
    """
    none = np.zeros(0, np.uint64)
    if len(key) < 2:
        return none, none
    same = key[1:] == key[:-1]
    crowd = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key, fp = key[crowd], fp[crowd]
    if not len(key):
        return none, none
    run = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    turned = _rotated(fp, key & np.uint64(_LOW))
    left = (turned & np.uint64(_LOW)).astype(np.int64)
    centre = turned >> np.uint64(BLOCK_BITS) == key >> np.uint64(BLOCK_BITS)
    place = (run.astype(np.int64) << BLOCK_BITS) | left
    order = np.lexsort((~centre, place))                 # a member equal to the variant first
    place, fp, centre = place[order], fp[order], centre[order]
    head = np.concatenate(([True], place[1:] != place[:-1]))
    first = np.flatnonzero(head)
    stands = first[np.cumsum(head) - 1]                  # representative of each member
    a, b = [fp[~head]], [fp[stands[~head]]]
    spot, who, equal = place[first], fp[first], centre[first]

    def neighbours(rows: np.ndarray, masks: np.ndarray, both: bool) -> None:
        for mask in masks.tolist():
            want = spot[rows] ^ mask
            at = np.searchsorted(spot, want)
            hit = (at < len(spot)) & (spot[np.minimum(at, len(spot) - 1)] == want)
            hit[hit] &= (want[hit] >> BLOCK_BITS) == (spot[rows[hit]] >> BLOCK_BITS)
            if both:
                hit[hit] &= equal[at[hit]]
            a.append(who[rows[hit]])
            b.append(who[at[hit]])

    several = np.bincount(spot >> BLOCK_BITS, minlength=int(run[-1]) + 1)[spot >> BLOCK_BITS] > 1
    everyone = np.flatnonzero(several)
    centres = np.flatnonzero(several & equal)
    if len(everyone):
        neighbours(everyone, _masks(1), False)
    if len(centres):
        neighbours(centres, _masks(2), False)
        neighbours(centres, _masks(3), True)
    return np.concatenate(a), np.concatenate(b)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition sorted by key; a run may span batches."""
    held_key, held_fp, rows = [], [], 0

    def flush(last: bool):
        nonlocal held_key, held_fp, rows
        key, fp = np.concatenate(held_key), np.concatenate(held_fp)
        stop = len(key) if last else int(np.searchsorted(key, key[-1], "left"))
        a, b = link_sorted(key[:stop].view(np.uint64), fp[:stop].view(np.uint64))
        held_key, held_fp, rows = [key[stop:]], [fp[stop:]], len(key) - stop
        pairs = np.unique(np.stack((a, b), axis=1).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    limit = _STEP_ROWS
    for batch in batches:
        if batch.num_rows:
            held_key.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_fp.append(batch.column(1).to_numpy(zero_copy_only=False))
            rows += batch.num_rows
        if rows >= limit:
            yield flush(False)
            limit = max(_STEP_ROWS, 2 * rows)      # a run longer than a step: wait for its end
    if rows:
        yield flush(True)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all pairs at
    most 3 bits apart (a spanning set: equal components, not every pair)."""
    return (prints.select("fp").mapInArrow(_variants, "key long, fp long")
            .repartition("key").sortWithinPartitions("key")
            .mapInArrow(_link, "a long, b long").distinct())


def _groups(prints: DataFrame) -> DataFrame:
    """``(fp, root)`` for every fingerprint: the components of the links."""
    nodes = stored(prints.select("fp").distinct(), "simhash-nodes")
    roots = connected_components(fingerprint_links(nodes))
    return stored(nodes.join(roots, nodes.fp == roots.node, "left")
                  .select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest
    doc_id reachable over links of at most 3 differing bits (itself included).
    Null, empty and blank texts have fingerprint 0 and link like any other; rows
    with a null id get their group's smallest id, or null if it has none; repeated
    rows are kept; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-least")
    owned = stored(least.join(_groups(prints), "fp"), "simhash-owned")
    smallest = stored(owned.groupBy("root").agg(F.min("least").alias("component_id")),
                      "simhash-groups")
    named = stored(owned.join(smallest, "root").select("fp", "component_id"), "simhash-names")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` with one row left of every near-duplicate group.

    The row with the smallest id stays (a null id only where the group has no
    other); of several rows with that id the one with the smallest hash of id and
    text, of rows equal in both any one.

    Rows are known by two hashes of id and text, 128 bits together.  Neither is ever
    null, so the join with the groups' first rows and the removal of repeated ones
    share one exchange of the whole rows.
    """
    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col)]
    digests = [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.struct(*digests).alias("digest")).alias("row"),
                        F.col(text_col).alias("text"))
    prints = stored(fingerprints(keyed, "row", "text", words)
                    .select(F.col("doc_id.doc_id").alias("doc_id"), "doc_id.digest", "fp"), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    least = stored(prints.groupBy("fp").agg(first.alias("first")), "simhash-least")
    marks = ["__digest", "__digest2"]
    while set(marks) & set(docs.columns):
        marks = [m + "_" for m in marks]
    heads = stored(least.join(_groups(prints), "fp").groupBy("root").agg(F.min("first").alias("first"))
                   .select(*[F.col("first.digest")[f"col{k + 1}"].alias(m) for k, m in enumerate(marks)]),
                   "simhash-heads")
    rows = docs.withColumns(dict(zip(marks, digests)))
    return rows.join(heads, marks, "left_semi").dropDuplicates(marks).select(*[f"`{c}`" for c in docs.columns])
