"""Mixing sources to target weights by hierarchical budgeting.

Weights are given per level of a tree (domain, language, source).  From the root
down, every node's token budget is shared among its children by weight; a child
that cannot use its share (all its documents, ``max_epochs`` times) gets what it
can use and the shortage goes to its siblings, again by weight.  Because a node's
budget was already cut to what its leaves can give, shortages reach other
branches only when a whole branch is short: siblings first, then ancestors.
Shares are exact integers; the odd tokens go to the first open children by name.

A leaf reads its documents in a seeded order that is new in every epoch and takes
a prefix of that stream.  Whole epochs need no order at all; for the last one the
order's leading digits are counted per leaf, so only the bucket that holds the
end of the prefix is sorted, and the selection is a comparison with that end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

NONE = "(none)"
#: Hexadecimal digits of the order key that are counted per round, all of them, and
#: the most rows of a leaf that are sorted.
ROUND_DIGITS = 2
KEY_DIGITS = 32
SORTED_ROWS = 1 << 16
WORDS = r"[^ \t-\r]+"


def word_count(text: str = "text") -> Column:
    """Tokens of a text: its words between ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(id_col: str, epoch: Column, seed: int) -> Column:
    """The place of a document in an epoch: rows of one id share it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(F.col(id_col).cast("string"), F.lit(NONE))))


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    if weights:
        table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
        out = F.coalesce(table[F.col(column)], F.lit(1))
    return out.cast("decimal(38,0)")


def _shares(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Share ``budget`` of each parent among children with ``weight`` and ``cap``."""
    key = list(parent) or [F.lit(0)]
    by_need = Window.partitionBy(*key).orderBy(F.col("cap") / F.col("weight"), F.col(name))
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    later = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*key)
    zero = F.lit(0).cast("decimal(38,0)")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), zero).cast("decimal(38,0)")
    full = (F.col("budget") - F.col("used")) * F.col("weight") >= F.col("cap") * F.col("open")
    nodes = (nodes.withColumn("used", total("cap", earlier)).withColumn("open", total("weight", later))
             .withColumn("full", full)
             .withColumn("rest", F.col("budget") - total(F.when(full, F.col("cap")), whole))
             .withColumn("open", total(F.when(~full, F.col("weight")), whole)))
    part = F.expr("cast(rest * weight div greatest(open, 1) as decimal(38,0))")
    nodes = nodes.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(part))
    odd = F.col("rest") - total(F.when(~F.col("full"), F.col("part")), whole)
    turn = F.row_number().over(Window.partitionBy(*key, "full").orderBy(name))
    return (nodes.withColumn("odd", odd).withColumn("turn", turn)
            .withColumn("budget", F.col("part") + F.when(~F.col("full") & (F.col("turn") <= F.col("odd")), 1)
                        .otherwise(0))
            .withColumn("budget", F.col("budget").cast("decimal(38,0)")))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]],
            total: int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``budget`` long per leaf."""
    leaves = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("decimal(38,0)"))
    given, parent = None, []
    for level, weight in zip(levels, weights):
        own = [*parent, level]
        nodes = (leaves.groupBy(*own).agg(F.sum("cap").cast("decimal(38,0)").alias("cap"))
                 .withColumn("weight", _weight(level, weight)))
        if given is None:
            capacity = F.sum("cap").over(Window.partitionBy(F.lit(0))).cast("decimal(38,0)")
            nodes = nodes.withColumn("budget", F.least(F.lit(total).cast("decimal(38,0)"), capacity))
        else:
            nodes = nodes.join(given, parent)
        given = _shares(nodes, parent, level).select(*own, "budget")
        parent = own
    return leaves.join(given, parent).select(*parent, "tokens", F.col("budget").cast("long").alias("budget"))


def prefix_ends(rows: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]],
                total: int | None, max_epochs: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Per leaf: ``epochs`` whole ones, then the key ``end`` of the last group of
    rows that the prefix reaches, ``inside`` tokens of whose ``size`` it takes.

    ``rows`` has the levels (no nulls), the id and ``tokens``.
    """
    levels = list(levels)
    leaves = stored(rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    if total is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
    planned = budgets(leaves, levels, weights, total, max_epochs)
    planned = stored(planned.select(
        *levels, "tokens", "budget",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int").alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("left")),
        "mix-plan")
    cut = planned.filter("left > 0").select(*levels, "epochs", "left")
    keyed = (rows.join(cut, levels)
             .withColumn("key", order_key(id_col, F.col("epochs"), seed)))
    earlier = Window.partitionBy(*levels).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    near, depth, largest = keyed.withColumn("before", F.lit(0).cast("long")), 0, None
    while largest is None or (largest > SORTED_ROWS and depth < KEY_DIGITS):
        depth += ROUND_DIGITS
        buckets = (near.withColumn("digits", F.substring("key", 1, depth)).groupBy(*levels, "left", "before", "digits")
                   .agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("rows"))
                   .withColumn("before", F.col("before") + F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
                   .filter("sum > 0 and before < left and before + sum >= left")
                   .select(*levels, "digits", "before", "rows"))
        buckets = stored(buckets, "mix-buckets")
        largest = buckets.agg(F.max("rows")).first()[0] or 0
        near = (keyed.withColumn("digits", F.substring("key", 1, depth))
                .join(buckets.drop("rows"), [*levels, "digits"]).drop("digits"))
    groups = near.groupBy(*levels, "left", "before", "key").agg(F.sum("tokens").alias("size"))
    inner = Window.partitionBy(*levels).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ends = (groups.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
            .filter("size > 0 and start < left and start + size >= left")
            .select(*levels, F.col("key").alias("end"), (F.col("left") - F.col("start")).alias("inside"),
                    "size"))
    return stored(planned.join(ends, levels, "left"), "mix-ends")


def chosen(rows: DataFrame, ends: DataFrame, levels: Sequence[str], seed: int,
           id_col: str = "doc_id") -> DataFrame:
    """``rows`` once per epoch that takes them, with ``__epoch``; ``__at_end`` marks
    the group that the prefix ends in."""
    table = ends.select(*[F.col(c).alias(f"__{c}") for c in levels], F.col("epochs").alias("__epochs"),
                        F.col("end").alias("__end"), F.col("inside").alias("__inside"),
                        F.col("size").alias("__size"))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in levels])
    key = order_key(id_col, F.col("__epochs"), seed)
    more = F.when(F.col("__end").isNotNull() & (key <= F.col("__end")), 1).otherwise(0)
    times = F.col("__epochs") + more
    return (rows.join(table, on).filter(times > 0)
            .withColumn("__epoch", F.explode(F.sequence(F.lit(0), times - 1)))
            .withColumn("__at_end", (F.col("__epoch") == F.col("__epochs")) & (key == F.col("__end"))))


def _labelled(docs: DataFrame, levels: Mapping[str, Column]) -> dict[str, Column]:
    return {k: F.coalesce(c.cast("string"), F.lit(NONE)) for k, c in levels.items()}


def mixed(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]],
          total: int | None = None, max_epochs: int = 2, seed: int = 0,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, levels..., epoch, tokens, taken)``: one row per document and epoch.

    ``total`` is the token budget (None: the tokens of ``docs``); weights are
    positive integers by level and child name, 1 where not listed.  ``taken`` is
    ``tokens`` but for the last document of a leaf's prefix, which gives the rest
    of the budget.  Rows of one id in a leaf share their place in the order and
    split such a rest by size, rounded down.  A null level value is the child
    ``(none)``; null and blank texts have no tokens and come with whole epochs or
    inside the prefix; a leaf without tokens gives nothing.  Empty tables give no
    rows.
    """
    names = _labelled(docs, levels)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in names.items()],
                              word_count(text_col).alias("tokens")), "mix-rows")
    ends = prefix_ends(rows, list(names), weights, total, max_epochs, seed)
    part = F.expr("cast(cast(__inside as decimal(38,0)) * tokens div __size as long)")
    return chosen(rows, ends, list(names), seed).select(
        "doc_id", *names, F.col("__epoch").cast("int").alias("epoch"), "tokens",
        F.when(F.col("__at_end"), part).otherwise(F.col("tokens")).alias("taken"))


def mixed_documents(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]],
                    total: int | None = None, max_epochs: int = 2, seed: int = 0,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mixed`` takes tokens from, once per epoch, with
    the columns of ``docs``.  Texts are not shuffled: a row is compared with the
    end of its leaf's prefix."""
    names = _labelled(docs, levels)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in names.items()],
                              word_count(text_col).alias("tokens")), "mix-rows")
    ends = prefix_ends(rows, list(names), weights, total, max_epochs, seed)
    inner = {f"__level_{i}": c for i, c in enumerate(names.values())}
    ends = ends.select(*[F.col(k).alias(f"__level_{i}") for i, k in enumerate(names)],
                       "epochs", "end", "inside", "size")
    out = chosen(docs.withColumns(inner), ends, list(inner), seed, id_col)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
