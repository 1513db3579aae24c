"""Chat formatting by quotation linking.

Messages quote each other with ``>`` marks, nested to any level.  Every message is
cut into passages (neighbouring lines of one level); each passage and each of its
lines is normalised (lower case, letters and digits, single spaces) and hashed.
A message's own lines and passages are originals, the first message of a
conversation that has one is its source; quoted ones are joined to that source by
hash.  The parent of a message is the earlier one from which it quotes most words,
on the lowest level with any match.  Without marks the texts remain, and messages
are put in reply order: thread by thread, replies by depth, then by turn.

Joins are on (conversation, hash) against one source each, so a line that is said
or quoted very often makes no pairs; threads are followed by pointer doubling; the
order is a range-partitioned sort with offsets, so no conversation is gathered in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import released, stored

MAX_DOUBLINGS = 64
_MARKS = r"^((?:[ \t]*>)+)"


def _lines(text: Column) -> Column:
    """Array of (level, line); level 0 lines stay as they are."""
    def line(raw: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(raw, _MARKS, 1), "[ \t]", ""))
        return F.struct(level.alias("level"),
                        F.regexp_replace(raw, _MARKS + "[ \t]?", "").alias("line"))
    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(messages: DataFrame) -> DataFrame:
    """Distinct ``(conv, turn, level, hash, words)`` of lines and passages."""
    lines = messages.select("conv", "turn", "row", F.posexplode("lines").alias("at", "entry")).select(
        "conv", "turn", "row", "at", "entry.level", normalised(F.col("entry.line")).alias("said"))
    by = Window.partitionBy("row").orderBy("at")
    fresh = F.coalesce((F.col("level") != F.lag("level").over(by)).cast("int"), F.lit(1))
    lines = lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by)).filter("said <> ''")
    passages = lines.groupBy("row", "run", "level").agg(
        F.first("conv").alias("conv"), F.first("turn").alias("turn"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]),
                     " ").alias("said"))
    both = lines.select("conv", "turn", "level", "said").union(passages.select("conv", "turn", "level", "said"))
    return both.select("conv", "turn", "level", F.xxhash64("said").alias("hash"),
                       F.size(F.split("said", " ")).alias("words")).distinct()


def _parents(messages: DataFrame) -> DataFrame:
    """``(conv, turn, parent)`` of the messages whose quotes have a source."""
    known = messages.filter("conv is not null and turn is not null")
    quoting = known.filter("quoted > 0").select("conv").distinct()
    known = known.join(quoting, "conv", "left_semi").dropDuplicates(["row"])
    units = stored(_units(known), "quotes-units")
    sources = stored(units.filter("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("source")),
                     "quotes-sources")
    hits = (units.filter("level > 0").join(sources, ["conv", "hash"]).filter("source < turn")
            .groupBy("conv", "turn", "level", "source").agg(F.sum("words").alias("words")))
    best = F.max(F.struct(-F.col("level"), "words", "source"))
    return hits.groupBy("conv", "turn").agg(best.alias("best")).select(
        "conv", "turn", F.col("best.source").alias("parent"))


def _threads(links: DataFrame) -> DataFrame:
    """``(conv, turn, root, depth)`` of linked messages by pointer doubling."""
    jumps = stored(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")),
                   "quotes-jumps")
    for _ in range(MAX_DOUBLINGS):
        upper = jumps.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"),
                             F.col("depth").alias("d"))
        after = stored(jumps.join(upper, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left")
                       .select("conv", "turn", F.coalesce("r", "root").alias("root"),
                               (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"),
                               F.col("r").isNotNull().alias("moved")), "quotes-jumps")
        released(jumps)
        jumps = after.drop("moved")
        jumps._scratch = after._scratch
        if after.filter("moved").limit(1).count() == 0:
            break
    return jumps


def _ordered(rows: DataFrame) -> DataFrame:
    """``position`` of each row in its conversation, from 0."""
    keys = ["conv", "root", "depth", "turn", "row"]
    sorted_ = stored(rows.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
                     .withColumn("place", F.monotonically_increasing_id()), "quotes-sorted")
    part = F.shiftright("place", 33)
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = sorted_.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(   # a row per task
        "global", F.col("offset") + within)
    heads = stored(placed.groupBy("conv").agg(F.min("global").alias("head")), "quotes-heads")
    heads = heads.withColumnRenamed("conv", "c")
    return placed.join(heads, F.col("conv").eqNullSafe(F.col("c"))).withColumn(
        "position", F.col("global") - F.col("head"))


def linked(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, parent_turn, root_turn, depth, position, n_quoted, text)``,
    one row per input row.

    ``text`` has the level-0 lines only (unchanged without quotes, else without
    outer blank lines); ``n_quoted`` counts quoted lines; ``parent_turn`` is null
    for messages that quote nothing said earlier in their conversation, which
    start a thread of their own (``root_turn`` is their turn, depth 0).
    ``position`` numbers a conversation's rows from 0 in reply order; rows of one
    turn are one message for linking and are ordered by their text.  Rows with a
    null conversation or turn are not linked; a null text has nothing to quote.
    Empty tables give no rows.
    """
    lines = _lines(F.coalesce("text", F.lit("")))
    quoted = F.size(F.filter("lines", lambda x: x["level"] > 0))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                           F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = stored(rows.withColumn("row", F.xxhash64("conv", "turn", "role", "text")).withColumn("lines", lines)
                  .withColumn("quoted", quoted.cast("long"))
                  .withColumn("text", F.when(F.col("quoted") == 0, F.col("text"))
                              .otherwise(F.regexp_replace(own, r"^\s*\n|\s+$", ""))), "quotes-rows")
    parents = stored(_parents(rows), "quotes-parents")
    threads = _threads(parents)
    tree = stored(parents.join(threads, ["conv", "turn"])
                  .select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent", "root", "depth"),
                  "quotes-tree")
    placed = rows.drop("lines").join(tree, (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    placed = placed.drop("c", "t").withColumn("root", F.coalesce("root", "turn")).withColumn(
        "depth", F.coalesce("depth", F.lit(0)).cast("long"))
    return _ordered(placed).select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"), "depth", F.col("position").cast("long").alias("position"),
        F.col("quoted").alias("n_quoted"), "text")
