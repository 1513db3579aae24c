"""S2 — header CSV scan with whole-file type inference and NA tokens.

Everything is read as strings, the NA tokens below become null, and each column
is then typed by one aggregate pass: all non-null cells parse as int64 → bigint;
else all parse as double → double; else string.  (``inferSchema`` alone would
make a numeric column holding ``NA`` a string column, i.e. categorical.)

Quoted cells may hold line breaks, so where a record starts depends on every quote
before it.  One large file is still read by many tasks: lines are read in blocks, one
pass counts the quotes of each block (odd or even), a running sum of these per file
tells whether a block starts inside a quoted cell, and a second pass puts the lines of
each block together into records.  Only the records cut by a block's end are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import written
from ..session import default_parallelism

# The default missing-value tokens of the pandas CSV reader.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: Most blocks of a table (a broadcast row of about 40 bytes each; 128 MB blocks: 256 TB).
BLOCK_LIMIT = 2_000_000
_MIN_BLOCKS = "spark.sql.files.minPartitionNum"


def _na_to_null(col: str):
    c = F.col(f"`{col}`")
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Stretches of one block in a batch of (line, file, block, ...)."""
    file, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
        yield (int(file[lo]), int(block[lo])), lo, hi


def _quotes_before(lines: pa.Array, so_far: int) -> tuple[np.ndarray, int]:
    """Quotes before each line (``so_far`` before the first), and after the last."""
    own = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    upto = so_far + np.cumsum(own)
    return upto - own, int(upto[-1])


def _block_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, file, block) -> per block its quotes and whether a line starts after an odd
    number of them, that is, whether a record starts here if a cell is open before."""
    seen: dict[tuple[int, int], list] = {}
    for batch in batches:
        if batch.num_rows:
            for at, lo, hi in _runs(batch):
                state = seen.setdefault(at, [0, False])
                before, state[0] = _quotes_before(batch.column(0).slice(lo, hi - lo), state[0])
                state[1] = state[1] or bool((before % 2 == 1).any())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()),
         pa.array([s[0] for s in seen.values()], pa.int64()), pa.array([s[1] for s in seen.values()], pa.bool_())],
        ["file", "block", "quotes", "flips"])


_RECORD = pa.schema([("record", pa.string()), ("file", pa.int64()), ("block", pa.int64()), ("origin", pa.int64())])


def _rows(records: pa.Array, at: tuple[int, int], origin: int | None) -> pa.RecordBatch:
    n = len(records)
    return pa.RecordBatch.from_arrays(
        [records.cast(pa.string()), pa.array(np.full(n, at[0])), pa.array(np.full(n, at[1])),
         pa.nulls(n, pa.int64()) if origin is None else pa.array(np.full(n, origin))], schema=_RECORD)


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Lines put together from each start up to the next (the last: to the end)."""
    ends = pa.array(np.append(starts, len(lines)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(ends, lines), "\n")


class _Block:
    """The state of one block: quotes so far and the lines of the record not yet ended."""

    def __init__(self, at: tuple[int, int], opened: bool, origin: int | None):
        self.at, self.quotes, self.lines = at, int(opened), []
        self.origin = origin if opened else None       # block where a record begun earlier starts
        self.header = at[1] == 0                        # its first record is the header

    def _end_record(self, origin: int | None) -> Iterator[pa.RecordBatch]:
        record = _joined(pa.concat_arrays(self.lines), np.zeros(1, np.int64)) if self.lines else None
        self.lines = []
        if record is not None:
            header, self.header = self.header, False
            if origin is not None or not header:
                yield _rows(record, self.at, -1 if header else origin)

    def take(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        before, self.quotes = _quotes_before(lines, self.quotes)
        starts = np.flatnonzero(before % 2 == 0)
        if not len(starts):
            self.lines.append(lines)
            return
        if starts[0]:
            self.lines.append(lines.slice(0, starts[0]))
        yield from self._end_record(self.origin)
        self.origin = None
        whole = lines.slice(starts[0], starts[-1] - starts[0])
        if len(whole):
            records = _joined(whole, starts[:-1] - starts[0])
            records, self.header = records.slice(1 if self.header else 0), False
            yield _rows(records, self.at, None)
        self.lines.append(lines.slice(starts[-1]))

    def close(self) -> Iterator[pa.RecordBatch]:
        open_ = self.quotes % 2 == 1
        # A record that goes on in the next block is a piece: of the record it
        # continues, or of the one that starts here.
        yield from self._end_record(self.origin if self.origin is not None else self.at[1] if open_ else None)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, file, block, opened, origin) in file order per block -> records and pieces."""
    block: _Block | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        for at, lo, hi in _runs(batch):
            if block is None or block.at != at:
                if block is not None:
                    yield from block.close()
                opened = batch.column(3)[lo].as_py()
                if opened is None:
                    raise RuntimeError(f"the blocks of the CSV files changed between two scans; set {_MIN_BLOCKS}")
                block = _Block(at, opened, batch.column(4)[lo].as_py())
            yield from block.take(batch.column(0).slice(lo, hi - lo))
    if block is not None:
        yield from block.close()


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` strings of all files, headers left out, written once."""
    if not spark.conf.get(_MIN_BLOCKS, None):
        # Both scans must cut files alike, also if the number of cores changes meanwhile.
        spark.conf.set(_MIN_BLOCKS, str(default_parallelism(spark)))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = written(lines.mapInArrow(_block_quotes, "file long, block long, quotes long, flips boolean"), "csv-quotes")
    if quotes.count() > BLOCK_LIMIT:
        raise ValueError(f"more than {BLOCK_LIMIT} blocks; raise spark.sql.files.maxPartitionBytes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    starts = quotes.withColumn("opened", opened).withColumn("starts", ~F.col("opened") | F.col("flips"))
    origin = F.last(F.when(F.col("starts"), F.col("block")), ignorenulls=True).over(before)
    blocks = written(starts.select("file", "block", "opened", origin.alias("origin")), "csv-blocks")
    # A broadcast join keeps the lines of a block in order and in their task.
    marked = lines.join(F.broadcast(blocks), ["file", "block"], "left") \
        .select("value", "file", "block", "opened", "origin")
    rows = written(marked.mapInArrow(_records, "record string, file long, block long, origin long"), "csv-records")
    pieces = rows.where("origin is not null").groupBy("file", F.when(F.col("origin") == -1, 0).otherwise(F.col("origin")).alias("start")).agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"), F.min("origin").alias("first"))
    cut = pieces.where("first <> -1").select(F.array_join(F.col("parts.record"), "\n").alias("record"))
    return rows.where("origin is null").select("record").unionByName(cut)


def read_csv_strings(spark: SparkSession, path: str, multi_line: bool = True, whole_files: bool = False) -> DataFrame:
    """All cells as strings; a quote inside a quoted cell is doubled, and quoted
    cells may hold line breaks (``\\n`` ends lines; a ``\\r`` before it is dropped at the
    end of a record).  Quotes may stand in quoted cells only: files with a lone quote in
    an unquoted cell need ``whole_files=True`` (one file is one task) or, without line
    breaks in cells, ``multi_line=False``.  Empty lines and empty files give no rows."""
    raw = spark.read.option("header", True).option("inferSchema", False) \
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    if multi_line and not whole_files and raw.columns:
        cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(raw.columns))])
        options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "mode": "PERMISSIVE",
                   "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        records = _csv_records(spark, path).select(F.regexp_replace("record", r"\r\z", "").alias("record"))
        parsed = records.where("record <> ''").select(F.from_csv("record", cells.simpleString(), options).alias("r"))
        raw = parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(raw.columns)])
    return raw.select(*[_na_to_null(c).alias(c) for c in raw.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """One aggregate pass over the string frame → Spark type per column."""
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        aggs += [F.count(col).alias(f"n{i}"),
                 F.count(col.try_cast("bigint")).alias(f"l{i}"),
                 F.count(col.try_cast("double")).alias(f"d{i}")]
    if not aggs:
        return {}
    r = df.agg(*aggs).collect()[0]
    types = {}
    for i, c in enumerate(df.columns):
        n, nl, nd = r[f"n{i}"], r[f"l{i}"], r[f"d{i}"]
        types[c] = "double" if n == 0 else ("bigint" if nl == n else ("double" if nd == n else "string"))
    return types


def read_csv_na(spark: SparkSession, path: str, types: dict[str, str] | None = None,
                multi_line: bool = True, whole_files: bool = False) -> DataFrame:
    strings = read_csv_strings(spark, path, multi_line, whole_files)
    types = types or infer_types(strings)
    return strings.select(*[(F.col(f"`{c}`").try_cast(t) if t != "string" else F.col(f"`{c}`")).alias(c)
                            for c, t in types.items()])
