"""J1 — left equi-join with the reference's frame-library semantics.

* unmatched right rows → nulls; duplicate right keys multiply left rows;
* ``null_safe=True``: missing keys match each other (``<=>``), as the
  frame library's merge does; plain ``=`` leaves null keys unmatched;
* overlapping non-key column names get suffixes (``_x`` left, ``_y`` right).

Strategy is left to Catalyst/AQE: a broadcast hash join when the right side's
estimated size is under ``spark.sql.autoBroadcastJoinThreshold``, else a
sort-merge join (AQE can split skewed left partitions).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, on: str | Sequence[str],
              null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    overlap = (set(left.columns) & set(right.columns)) - set(keys)
    lsx, rsx = suffixes
    lhs = left.select(*[F.col(c).alias(c + lsx if c in overlap else c) for c in left.columns])
    rhs = right.select(*[F.col(c).alias(f"__rk_{c}" if c in keys else (c + rsx if c in overlap else c))
                         for c in right.columns])
    conds = [(lhs[k].eqNullSafe(rhs[f"__rk_{k}"]) if null_safe else lhs[k] == rhs[f"__rk_{k}"])
             for k in keys]
    cond = reduce(lambda a, b: a & b, conds)
    return lhs.join(rhs, cond, "left").drop(*[f"__rk_{k}" for k in keys])
