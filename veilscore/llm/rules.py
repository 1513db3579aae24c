"""Quality rules: robust multivariate outliers per language and source.

Every document is a vector of transformed statistics.  For each (language,
source) group the minimum covariance determinant (MCD) estimate - centre and
scatter of the three quarters of the rows that make the scatter's determinant
smallest - describes the ordinary document; a document is rejected when its
squared Mahalanobis distance exceeds a chi-square quantile.

The estimate covers all rows and runs as grouped sums: concentration steps take,
per group, the rows nearest to the current centre (the cut is found by counting
distances in narrow bins), sum their moments with map-side combine and repeat
until no determinant falls any more.  Two starts are followed, the coordinatewise
median with a robust spread and the plain mean and covariance; the smaller
determinant wins.  No group is ever gathered in one task.

Groups below ``MIN_GROUP`` rows are pooled within their language, small languages
with each other; if even that pool is small its rows are judged by an estimate over
all rows.  A floor is added to the scatter's diagonal: where most rows have, say, no
symbol at all the scatter would be singular and any symbol an outlier.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import released, stored
from .stats import counted

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Statistics: name, expression over the counts, floor of the standard deviation.
#: Ratios are shrunk by PRIOR pseudo-words, so very short texts are not outliers
#: by chance alone.
PRIOR = 50.0
_SQRT = "sqrt(({k}) / (({n}) + {prior}))"
FEATURES = [
    ("x0", f"ln((word_chars + 5.5 * {PRIOR}) / (n_words + {PRIOR}))", 0.08),
    ("x1", _SQRT.format(k="n_symbols", n="word_chars", prior=6 * PRIOR), 0.06),
    ("x2", _SQRT.format(k="n_dup_lines", n="n_lines", prior=8.0), 0.10),
    ("x3", _SQRT.format(k="n_repeat_words", n="n_words", prior=PRIOR), 0.10),
    ("x4", _SQRT.format(k="n_upper", n="n_letters", prior=6 * PRIOR), 0.05),
    ("x5", _SQRT.format(k="n_digits", n="word_chars", prior=6 * PRIOR), 0.08),
    ("x6", _SQRT.format(k="n_punctuation", n="word_chars", prior=6 * PRIOR), 0.05),
]
NAMES = [f[0] for f in FEATURES]
P = len(FEATURES)
KEPT_SHARE = 0.75
#: Rejection probability of an ordinary (normal) document.
TAIL = 1e-5
MIN_GROUP = 100
#: Steps after which determinants that still fall are an error.
MAX_STEPS = 1000
#: Least fall of a log determinant that asks for another step.
TOLERANCE = 1e-6
BINS_PER_DOUBLING = 64
#: Pieces that each group's rows are dealt over where Spark must shuffle them to
#: join their group's estimate (it does once there are too many groups to broadcast).
SALTS = 32
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def base_failed() -> Column:
    """Fewer than ten words, or over 20 % of the words in repeated 5-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# ------------------------------------------------------------- chi-square
def chi2_cdf(x: float, k: float) -> float:
    """Lower regularised incomplete gamma function of (k/2, x/2) by its series."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = math.exp(-z + a * math.log(z) - math.lgamma(a + 1))
    total, n = term, 1
    while term > total * 1e-16 and n < 10_000:
        term *= z / (a + n)
        total += term
        n += 1
    return min(total, 1.0)


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


# ------------------------------------------------------------------ groups
def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``grp``: language and source, or the pool they fall into."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("size"))
    own = F.col("size") >= MIN_GROUP
    rest = F.coalesce(F.sum(F.when(~own, F.col("size"))).over(Window.partitionBy("lang")), F.lit(0))
    label = F.when(own, F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})).when(
        F.col("rest") >= MIN_GROUP, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})).otherwise("")
    names = stored(sizes.withColumn("rest", rest).select(
        F.col("lang").alias("l"), F.col("source").alias("s"), label.alias("grp")), "mcd-groups")
    salted = rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    names = _salted(names).withColumnRenamed("salt", "n")
    return salted.join(names, salted.lang.eqNullSafe(names.l) & salted.source.eqNullSafe(names.s)
                       & (salted.salt == names.n)).drop("l", "s", "n")


# --------------------------------------------------------------------- MCD
_FIT = "grp string, start int, logdet double, " + ", ".join(
    [f"m{i} double" for i in range(P)] + [f"w{i}_{j} double" for i, j in _PAIRS])


def _whitener(mean: np.ndarray, cov: np.ndarray) -> tuple[float, list[float]]:
    """Log determinant and the lower triangle of the inverse Cholesky factor."""
    cov = cov + np.diag([f[2] ** 2 for f in FEATURES])
    factor = np.linalg.cholesky(cov)
    inverse = np.linalg.inv(factor)
    return 2 * float(np.log(np.diag(factor)).sum()), [float(inverse[i, j]) for i, j in _PAIRS]


def _fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, start, n, scale, sums, products) -> centre and whitening matrix."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
            cov = np.zeros((P, P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
            low = min(0.0, float(np.linalg.eigvalsh(cov)[0]))      # rounding only
            logdet, w = _whitener(mean, (cov - low * np.eye(P)) * r["scale"])
            rows.append({"grp": r["grp"], "start": r["start"], "logdet": logdet,
                         **{f"m{i}": float(mean[i]) for i in range(P)},
                         **{f"w{i}_{j}": x for (i, j), x in zip(_PAIRS, w)}})
        kind = pa.schema([("grp", pa.string()), ("start", pa.int32()), ("logdet", pa.float64())] +
                         [(f"m{i}", pa.float64()) for i in range(P)] +
                         [(f"w{i}_{j}", pa.float64()) for i, j in _PAIRS])
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)],
            *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i, j in _PAIRS]]


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates: 0 median and robust spread, 1 mean and covariance."""
    median = lambda x: F.percentile_approx(x, 0.5, F.lit(200))
    middle = stored(rows.groupBy("grp").agg(*[median(x).alias(f"c{i}") for i, x in enumerate(NAMES)]),
                    "mcd-middle")
    near = rows.join(_salted(middle), ["grp", "salt"]).groupBy("grp").agg(
        *[F.first(f"c{i}").alias(f"c{i}") for i in range(P)],
        *[median(F.abs(F.col(x) - F.col(f"c{i}"))).alias(f"d{i}") for i, x in enumerate(NAMES)])
    spread = lambda i: F.pow(1.4826 * F.col(f"d{i}"), 2)
    robust = near.select(
        "grp", F.lit(0).alias("start"), F.lit(1).cast("long").alias("n"),
        *[F.col(f"c{i}").alias(f"s{i}") for i in range(P)],
        *[(F.col(f"c{i}") * F.col(f"c{j}") + (spread(i) if i == j else F.lit(0.0))).alias(f"q{i}_{j}")
          for i, j in _PAIRS])
    plain = rows.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(1))
    return robust.unionByName(plain).withColumn("scale", F.lit(1.0)).mapInArrow(_fits, _FIT)


def _salted(table: DataFrame) -> DataFrame:
    """One copy of a per-group table for every piece of the group's rows."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _distance() -> Column:
    """Squared Mahalanobis distance under a joined fit."""
    diff = [F.col(NAMES[i]) - F.col(f"m{i}") for i in range(P)]
    total = None
    for i in range(P):
        part = None
        for j in range(i + 1):
            term = F.col(f"w{i}_{j}") * diff[j]
            part = term if part is None else part + term
        total = part * part if total is None else total + part * part
    return total


def _step(rows: DataFrame, fits: DataFrame, scale: float) -> DataFrame:
    """One concentration step for every group and start."""
    tiny = 1e-9
    # NaN cannot occur (floors keep the scatter regular); distance 0 has the lowest bin.
    bin_ = F.floor(F.log2(F.col("d2") + tiny) * BINS_PER_DOUBLING).cast("int")
    placed = rows.join(_salted(fits), ["grp", "salt"]).withColumn("d2", _distance()).withColumn("bin", bin_)
    counts = placed.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grp", "start")
    cut = stored(counts.withColumn("upto", F.sum("k").over(upto)).withColumn("all", F.sum("k").over(whole))
                 .filter(F.col("upto") >= F.ceil(F.col("all") * KEPT_SHARE))
                 .groupBy("grp", "start").agg(F.min("bin").alias("last")), "mcd-cut")
    sums = (placed.join(_salted(cut), ["grp", "start", "salt"]).filter("bin <= last").groupBy("grp", "start").agg(*_moments())
            .withColumn("scale", F.lit(scale)))
    out = stored(sums.mapInArrow(_fits, _FIT), "mcd-fit")
    released(cut)
    return out


def fitted(rows: DataFrame) -> DataFrame:
    """``grp`` with centre, whitening matrix and log determinant of its MCD, from
    ``rows(grp, salt, <statistics>)``."""
    # Consistency at the normal law: the kept share's covariance is too small.
    scale = KEPT_SHARE / chi2_cdf(chi2_quantile(KEPT_SHARE, P), P + 2)
    starts = stored(_starts(rows), "mcd-fit")
    fits = moving = _step(rows, starts, scale)
    released(starts)
    for _ in range(MAX_STEPS):
        # Cuts are whole bins, so a step can also raise a determinant: it is not taken.
        after = _step(rows, moving, scale)
        last = fits.select("grp", "start", F.col("logdet").alias("last"))
        fell = stored(after.join(last, ["grp", "start"]).filter(F.col("last") - F.col("logdet") > TOLERANCE)
                      .select(*fits.columns), "mcd-fell")
        if fell.isEmpty():
            break
        kept = stored(fits.join(fell, ["grp", "start"], "left_anti").unionByName(fell), "mcd-fit")
        released(after, fits, moving)
        fits, moving = kept, fell
    else:
        raise RuntimeError("determinants did not settle")
    win = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))
    return fits.withColumn("win", win).filter("win = 1").drop("win", "start")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """``(doc_id, <counts>, base_failed, distance, kept)``, one row per input row.

    ``kept`` is false if a base rule fails, else whether the squared distance is
    at most the chi-square quantile of ``1 - tail``.  Null, empty and blank texts
    have no words and fail the base rules.  Null languages and sources are groups
    like any other.  Repeated rows and ties are judged alike; an empty table gives
    no rows.  Estimates are made on rows that pass the base rules.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                                 F.col(source_col).cast("string").alias("source")).alias("doc_id"),
                        F.col(text_col).alias("text"))
    rows = counted(keyed).withColumn("base_failed", base_failed()).withColumns(
        {name: F.expr(how).cast("double") for name, how, _ in FEATURES})
    rows = stored(rows.select("doc_id.doc_id", "doc_id.lang", "doc_id.source",
                              *[c for c in rows.columns if c != "doc_id"]), "mcd-rows")
    passed = stored(_grouped(rows.filter(~F.col("base_failed"))).select("grp", "salt", *NAMES), "mcd-passed")
    last_pool = passed.filter("grp = ''")
    basis = passed
    if 0 < last_pool.limit(MIN_GROUP).count() < MIN_GROUP:
        basis = stored(passed.filter("grp <> ''").unionByName(passed.withColumn("grp", F.lit(""))), "mcd-basis")
    fits = stored(fitted(basis).drop("logdet"), "mcd-final")
    # Rows that failed belong to no group that is judged.
    good = _grouped(rows.filter(~F.col("base_failed"))).join(_salted(fits), ["grp", "salt"], "left").withColumn(
        "distance", _distance())
    bad = rows.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    limit = chi2_quantile(1 - tail, P)
    columns = [c for c in rows.columns if c not in NAMES]
    return good.select(*columns, "distance").unionByName(bad.select(*columns, "distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit))
