"""Exact running totals and order statistics without one-task groups.

A global window (``Window.orderBy``) or a window per feature / per class sends a
whole group to one task.  At 100 TB one class or one feature can hold a third of
all rows, so ranks, cumulative sums and k-th values are computed like this:

* :func:`running_totals` — one range exchange of the rows (sampled bounds split
  large groups over many tasks), local running sums over each sorted range in
  Arrow batches, the result written once to the checkpoint folder; totals per
  (range, group) — at most ranges + groups rows — become offsets that Spark joins
  back by their size;
* :func:`exact_medians` — counts per (feature, bin) with map-side combine, the bin
  that holds the middle rank is refined until one value is left;
* :func:`column_medians` — the same for the columns of a wide table in two scans: a
  mergeable sketch per column brackets both middle ranks, an exact count checks the
  bracket, and only values inside it are shuffled;
* :func:`keys_at_ranks` — counts per (group, leading digits) narrow the digits that
  hold the wanted ranks, round by round, until few rows are left to order.

Every step has one plan at every size, and no rows are fetched to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, scratch_path

#: Bins per refinement round of :func:`exact_medians`.
BINS = 4096
#: :func:`column_medians`: sketches err by at most 1/ACCURACY of the ranks; the bracket
#: reaches MARGIN times that to either side of the middle.
ACCURACY = 1000
MARGIN = 2
#: :func:`keys_at_ranks`: digits read per round, most digits, most rows ordered by a task.
DIGITS = 2
MAX_DIGITS = 32
BUCKET_ROWS = 1 << 16


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _equal(pairs: Sequence[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs], F.lit(True))


def _local_totals(names: list[str]):
    """mapInArrow function: running count, sums and non-null counts within each
    run of equal group hash of a sorted partition, carried over batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count = None, 0
        carry: dict[str, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: i for i, n in enumerate(batch.schema.names)}
            g = batch.column(at["_grp_hash"]).to_numpy(zero_copy_only=False)
            cuts = [0, *((g[1:] != g[:-1]).nonzero()[0] + 1).tolist(), len(g)]
            counts, sums, seen = [], {n: [] for n in names}, {n: [] for n in names}
            for lo, hi in zip(cuts, cuts[1:]):
                if g[lo] != group:
                    group, count, carry = g[lo], 0, {}
                counts.append(pa.array(range(count + 1, count + hi - lo + 1), pa.int64()))
                count += hi - lo
                for n in names:
                    part = batch.column(at[n]).slice(lo, hi - lo)
                    zero = pa.scalar(0, pa.int64()).cast(part.type)
                    total, known = carry.get(n, (zero, 0))
                    running = pc.cumulative_sum(pc.fill_null(part, zero), start=total)
                    valid = pc.add(pc.cumulative_sum(pc.cast(pc.is_valid(part), pa.int64())), known)
                    sums[n].append(running)
                    seen[n].append(valid)
                    carry[n] = (running[-1], valid[-1].as_py())
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "_grp_hash"]
            fields = [f for f in batch.schema if f.name != "_grp_hash"]
            extra = [("_lc", pa.concat_arrays(counts))]
            for n in names:
                extra += [(f"_l{n}", pa.concat_arrays(sums[n])), (f"_ln{n}", pa.concat_arrays(seen[n]))]
            yield pa.RecordBatch.from_arrays(columns + [a for _, a in extra], schema=pa.schema(
                fields + [pa.field(k, a.type) for k, a in extra]))
    return run


def running_totals(df: DataFrame, order_by: Sequence[Column | str],
                   partition_by: Sequence[str] = (),
                   sums: Mapping[str, Column | str] | None = None,
                   count_col: str | None = "rn",
                   num_partitions: int | None = None) -> DataFrame:
    """Add inclusive running count (``count_col``) and running sums (``sums``:
    output name → expression) within ``partition_by`` in ``order_by`` order.

    Ties in ``order_by`` are broken by a hash of the whole row, so even one
    order-key value that covers a third of the table is split over many ranges
    (only fully identical rows stay together).  A running sum is null only while
    every value so far is null.
    """
    sums = dict(sums or {})
    parts = list(partition_by)
    values = {f"_v_{name}": _as_col(expr) for name, expr in sums.items()}
    # A sum of integers is a long, as in Spark's own sum.
    kinds = df.select(*[F.sum(e).alias(n) for n, e in values.items()]).schema if values else None
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    base = df.select("*", *[e.cast(kinds[n].dataType).alias(n) for n, e in values.items()],
                     (F.xxhash64(*hashable) if hashable else F.lit(0).cast("long")).alias("_tb"),
                     (F.xxhash64(*parts) if parts else F.lit(0).cast("long")).alias("_grp_hash"))
    keys = [F.col(p) for p in parts] + [_as_col(c) for c in order_by] + [F.col("_tb")]
    ranged = (base.repartitionByRange(int(num_partitions), *keys) if num_partitions
              else base.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    fields = [f for f in ranged.schema.fields if f.name != "_grp_hash"] + [T.StructField("_lc", T.LongType())]
    for n in values:
        fields += [T.StructField(f"_l{n}", kinds[n].dataType), T.StructField(f"_ln{n}", T.LongType())]
    local = written(ranged.mapInArrow(_local_totals(list(values)), T.StructType(fields)), "running")

    totals = local.groupBy("_pid", *parts).agg(
        F.max("_lc").alias("_tc"), *[F.sum(n).alias(f"_t{n}") for n in values],
        *[F.count(n).alias(f"_tn{n}") for n in values])
    before = Window.partitionBy(*parts).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select(
        F.col("_pid").alias("_o_pid"), *[F.col(p).alias(f"_o_{p}") for p in parts],
        earlier("_tc").alias("_oc"), *[earlier(f"_t{n}").alias(f"_o{n}") for n in values],
        *[earlier(f"_tn{n}").alias(f"_on{n}") for n in values])
    offsets = written(offsets, "offsets")
    joined = local.join(offsets, (F.col("_pid") == F.col("_o_pid"))
                        & _equal([(local[p], offsets[f"_o_{p}"]) for p in parts]))
    out = [F.col(f"`{c}`") for c in df.columns]
    if count_col:
        out.append((F.col("_lc") + F.col("_oc")).alias(count_col))
    for name in sums:
        known = F.col(f"_ln_v_{name}") + F.col(f"_on_v_{name}") > 0
        out.append(F.when(known, F.col(f"_l_v_{name}") + F.col(f"_o_v_{name}")).alias(name))
    return joined.select(*out)


def row_index(df: DataFrame, order_by: Sequence[Column | str],
              partition_by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Exact 1-based ``row_number`` within ``partition_by`` (distributed)."""
    return running_totals(df, order_by, partition_by, None, count_col=out)


def exact_medians(long_df: DataFrame, group_col: str = "feature", value_col: str = "value",
                  bins: int = BINS) -> DataFrame:
    """Exact median per group (mean of the two middle values), NaN and null skipped.

    Per group and middle rank: count the values in equal bins between the smallest
    and largest value left, keep the bin that holds the rank with its own smallest
    and largest value, and repeat until these are equal.  Each round is one
    aggregation with map-side combine; at least one distinct value is ruled out
    every time, usually all but 1/``bins`` of them.

    Returns ``(group, median, n)``; groups with no valid value are absent.
    """
    clean = long_df.select(F.col(group_col).alias("_g"), F.col(value_col).cast("double").alias("_x")) \
        .where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    start = clean.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    ranks = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    goals = written(start.select("_g", "n", "lo", "hi", F.lit(0).cast("long").alias("below"),
                                 F.posexplode(ranks).alias("side", "rank")), "median")
    while goals.where("lo < hi").limit(1).count():
        # A bracket that both ranks share is read and counted once.
        open_ = goals.where("lo < hi").select("_g", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
        # Halves first: the difference of two doubles may not be one.
        share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.when(F.col("_x") == F.col("_lo"), 0).when(F.col("_x") == F.col("_hi"), bins - 1).otherwise(
            F.least(F.greatest(F.floor(F.nanvl(share, F.lit(0.5)) * bins), F.lit(0)), F.lit(bins - 1)))
        upto = F.sum("k").over(Window.partitionBy("_g", "_lo", "_hi").orderBy("bin"))
        counted = (clean.join(open_, "_g").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
                   .groupBy("_g", "_lo", "_hi", bin_.alias("bin"))
                   .agg(F.count(F.lit(1)).alias("k"), F.min("_x").alias("least"), F.max("_x").alias("most"))
                   .withColumn("upto", upto).withColumnRenamed("_g", "_b"))
        held = goals.where("lo < hi").join(counted, F.col("_g").eqNullSafe(F.col("_b")) & (F.col("lo") == F.col("_lo"))
                                           & (F.col("hi") == F.col("_hi")))
        last = F.col("below") + F.col("upto")
        found = (held.where((last >= F.col("rank")) & (last - F.col("k") < F.col("rank")))
                 .select("_g", "n", F.col("least").alias("lo"), F.col("most").alias("hi"),
                         (last - F.col("k")).alias("below"), "side", "rank"))
        goals = written(goals.where("lo = hi").unionByName(found), "median")
    return goals.groupBy(F.col("_g").alias(group_col)).agg(
        ((F.min("lo") + F.max("lo")) / 2.0).alias("median"), F.first("n").alias("n"))


def _bracket_counts(brackets: Sequence[tuple[float, float]]):
    """mapInArrow function: columns of doubles -> ``(feature, value, k)``: how often each
    value inside the column's bracket occurs, and (null value) how many lie below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, value, k = [], [], []
            for i, (low, high) in enumerate(brackets):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                inside, times = np.unique(x[(x >= low) & (x <= high)], return_counts=True)
                below = int((x < low).sum())
                feature.append(np.full(len(inside) + 1, i, np.int32))
                value += [pa.array(inside, pa.float64()), pa.nulls(1, pa.float64())]
                k += [times, [below]]
            if feature:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(feature)), pa.concat_arrays(value),
                     pa.array(np.concatenate(k).astype(np.int64))], ["feature", "value", "k"])
    return run


def column_medians(df: DataFrame, cols: Sequence[str],
                   margin: float | None = None) -> tuple[dict[str, float], list[str]]:
    """Exact medians (mean of the two middle values; NaN and null skipped) of many columns
    in two scans of ``df``.

    Scan 1 merges one quantile sketch per column; its values at the middle, less and plus
    ``margin`` sketch errors, bracket both middle ranks.  Scan 2 counts the values below
    each bracket and the distinct values inside it; the latter, a few thousandths of the
    table unless they repeat, are the only ones shuffled and ranked.

    Returns the medians and the columns whose bracket the exact counts refute (none, as
    long as sketches keep their error bound); columns without a valid value are in neither.
    """
    reach = (MARGIN if margin is None else margin) / ACCURACY
    spark = df.sparkSession
    raw = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    x = raw.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in raw.columns])
    ends = F.array(F.lit(0.5 - reach), F.lit(0.5 + reach))
    sketch = x.agg(*[F.count(c).alias(f"n{c}") for c in x.columns],
                   *[F.percentile_approx(c, ends, ACCURACY).alias(f"b{c}") for c in x.columns]).first()
    used = [c for c in x.columns if sketch[f"n{c}"]]
    if not used:
        return {}, []
    counted = written(x.select(*used).mapInArrow(_bracket_counts([tuple(sketch[f"b{c}"]) for c in used]),
                                                 "feature int, value double, k long")
                      .groupBy("feature", "value").agg(F.sum("k").alias("k")), "brackets")
    around = counted.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("k"))), F.lit(0)).alias("inside")).collect()
    goals, missed = [], []
    for r in around:
        n = sketch[f"n{used[r['feature']]}"]
        first, second = (n + 1) // 2 - r["below"], n // 2 + 1 - r["below"]
        if first >= 1 and second <= r["inside"]:
            goals.append((r["feature"], first, second))
        else:
            missed.append(cols[int(used[r["feature"]][1:])])
    wanted = spark.createDataFrame(goals, "goal int, first long, second long")
    ranked = running_totals(counted.where("value is not null"), ["value"], ["feature"], {"upto": "k"}, None)
    middles = ranked.join(wanted, F.col("feature") == F.col("goal")).groupBy("feature").agg(
        F.min(F.when(F.col("upto") >= F.col("first"), F.col("value"))).alias("a"),
        F.min(F.when(F.col("upto") >= F.col("second"), F.col("value"))).alias("b"))
    found = middles.select("feature", ((F.col("a") + F.col("b")) / 2.0).alias("median")).collect()
    return {cols[int(used[r["feature"]][1:])]: float(r["median"]) for r in found}, missed


def keys_at_ranks(df: DataFrame, group_col: str, order: Sequence[Column],
                  targets: Mapping[object, Sequence[int]], prefix: Column | None = None) -> DataFrame:
    """Exact order statistics: for each group and each requested 1-based rank,
    the row key ``struct(order…)`` at that rank (rows ordered by ``order``).

    ``prefix`` is a column whose order agrees with ``order`` and which spreads the rows
    evenly.  A string (a hash) is read ``DIGITS`` characters at a time: rows are counted per (group, digits so far, next digits), and the
    digits that hold a wanted rank are kept, until at most ``BUCKET_ROWS`` rows share
    them; only those are ordered.  Rows that more share than that to the last digit
    (copies of one key) go through :func:`row_index`.  Without ``prefix`` all keys are
    ranked with :func:`row_index`.

    ``targets`` maps group → ranks (bounded by groups and ranks; null is a group
    like any other).  Returns ``(group, j, rank, key)``, ``j`` the 0-based index.
    """
    spark = df.sparkSession
    kind = df.schema[group_col].dataType.simpleString()
    rows = [(g, j, int(r)) for g, ranks in targets.items() for j, r in enumerate(ranks)]
    wanted = spark.createDataFrame(rows, f"_t {kind}, j int, rank long")
    keys = df.select(F.col(group_col).alias("_g"), F.struct(*order).alias("key"),
                     *([prefix.alias("_p")] if prefix is not None else []))
    if prefix is None:
        ranked = row_index(keys, ["key"], ["_g"], out="_rn")
        hit = ranked.join(wanted, F.col("_g").eqNullSafe(F.col("_t")) & (F.col("_rn") == F.col("rank")))
        return hit.select(F.col("_g").alias(group_col), "j", "rank", "key")
    text = isinstance(keys.schema["_p"].dataType, T.StringType)
    digits = MAX_DIGITS if text else DIGITS           # other values are read whole

    def read(depth: int) -> Column:
        return F.substring("_p", 1, depth) if text else F.col("_p")

    def inside(goals: DataFrame, depth: int) -> DataFrame:
        spots = goals.select("_t", "at").distinct()
        same = F.col("_g").eqNullSafe(F.col("_t"))
        return keys.join(spots, same & read(depth).eqNullSafe(F.col("at")) if depth else same)

    def met(frame: DataFrame, goals: DataFrame) -> DataFrame:
        goals = goals.select(F.col("_t").alias("_goal"), F.col("at").alias("_goal_at"), "j", "rank", "below")
        return frame.join(goals, F.col("_t").eqNullSafe(F.col("_goal")) & F.col("at").eqNullSafe(F.col("_goal_at")))

    none = F.lit(None).cast(keys.schema["_p"].dataType)
    goals = wanted.select("*", none.alias("at"), F.lit(0).cast("long").alias("below"))
    depth, largest = 0, None
    while largest is None or (largest > BUCKET_ROWS and depth < digits):
        upto = F.sum("size").over(Window.partitionBy("_t", "at").orderBy("next"))
        counts = inside(goals, depth).groupBy("_t", "at", read(depth + DIGITS).alias("next")) \
            .agg(F.count(F.lit(1)).alias("size")).withColumn("upto", upto)
        last = F.col("below") + F.col("upto")
        held = met(counts, goals).where((last >= F.col("rank")) & (last - F.col("size") < F.col("rank")))
        goals = written(held.select("_t", "j", "rank", F.col("next").alias("at"),
                                    (last - F.col("size")).alias("below"), "size"), "ranks")
        depth += DIGITS
        largest = goals.agg(F.max("size")).first()[0] or 0
    left = inside(goals, depth)
    if largest > BUCKET_ROWS:
        placed = row_index(left, ["key"], ["_t", "at"], out="_rn")
    else:
        placed = left.withColumn("_rn", F.row_number().over(Window.partitionBy("_t", "at").orderBy("key")))
    hit = met(placed, goals).where(F.col("_rn") + F.col("below") == F.col("rank"))
    return hit.select(F.col("_g").alias(group_col), "j", "rank", "key")
