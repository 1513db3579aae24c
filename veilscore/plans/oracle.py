"""DuckDB oracle SQL for the registered queries (same column names).

Independent formulations: global windows, ``median``, ``quantile`` and HUGEINT
arithmetic that DuckDB runs on one machine — the Spark side computes the same
results with distributed plans.
"""

from __future__ import annotations

from ..sources.model import TEST_FEATURE_SCALE, TEST_MODEL_BIAS, TEST_MODEL_WEIGHTS_64
from . import inputs as I

M64 = 2 ** 64


def _list(values) -> str:
    return "[" + ", ".join(str(int(v)) for v in values) + "]"


def _q(col: str, scale) -> str:
    return f"CAST(round(CAST({col} AS DOUBLE) * {float(scale)!r}) AS BIGINT)"


# Quantized embeddings in tall form: (vec_id, label, i 1-based, x).
EMB_Q = f"""
emb_q AS (
  SELECT vec_id, label, i, {_q('e', TEST_FEATURE_SCALE)} AS x
  FROM (SELECT vec_id, label, unnest(embedding) AS e,
               generate_subscripts(embedding, 1) AS i FROM embeddings)
)"""

EMB_W = f"""
emb_w AS (
  SELECT unnest({_list(TEST_MODEL_WEIGHTS_64)}) AS w,
         generate_subscripts({_list(TEST_MODEL_WEIGHTS_64)}, 1) AS i
)"""


def _emb_score(name: str = "emb_score", max_i: int = 64) -> str:
    return f"""
{name} AS (
  SELECT q.vec_id, CAST(sum(CASE WHEN q.i <= {max_i} THEN q.x * w.w ELSE 0 END)
                        + ({TEST_MODEL_BIAS}) AS BIGINT) AS score
  FROM emb_q q JOIN emb_w w ON q.i = w.i
  GROUP BY q.vec_id
)"""


EMB = f"WITH {EMB_Q}, {EMB_W}, {_emb_score()}"
EMB_PROB_SCALE = float(I.embedding_model().probability_scale)

_lw = I.LINEITEM_WEIGHTS
_ls = I.LINEITEM_FEATURE_SCALE
LI_SCORED = f"""
li_s AS (
  SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS label,
         CAST({_lw[0]} * {_q('l_quantity', _ls)} + {_lw[1]} * {_q('l_extendedprice', _ls)}
              + ({_lw[2]}) * {_q('l_discount', _ls)} + {_lw[3]} * {_q('l_tax', _ls)}
              + ({I.LINEITEM_BIAS}) AS BIGINT) AS score
  FROM lineitem
),
li_p AS (
  SELECT *, 1.0 / (1.0 + exp(-CAST(score AS DOUBLE) / {float(I.lineitem_model().probability_scale)!r})) AS prob
  FROM li_s
),
pts AS (
  SELECT score, pos, neg, thr,
         sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
         sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg, max(prob) AS thr
        FROM li_p GROUP BY score)
),
pts2 AS (
  SELECT *, tp / (tp + fp) AS prec, CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 1.0 END AS rec,
         coalesce(CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) END, 1.0)
           AS prev_prec
  FROM pts
)"""

DIR_POINTS = """
dt AS (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
dw AS (SELECT i, CAST(round((avg(CASE WHEN label = 0 THEN CAST(e AS DOUBLE) END)
                             - avg(CASE WHEN label <> 0 THEN CAST(e AS DOUBLE) END)) * 1000.0) AS BIGINT) AS w
       FROM dt GROUP BY i),
ds AS (SELECT dt.vec_id, CAST(any_value(dt.label) = 0 AS INTEGER) AS label,
              CAST(sum(CAST(round(CAST(dt.e AS DOUBLE) * 1000.0) AS BIGINT) * dw.w) AS BIGINT) AS score
       FROM dt JOIN dw ON dt.i = dw.i GROUP BY dt.vec_id),
pts AS (
  SELECT score, pos, neg, thr,
         sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
         sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg, CAST(max(score) AS DOUBLE) AS thr
        FROM ds GROUP BY score)
),
pts2 AS (
  SELECT *, tp / (tp + fp) AS prec, CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 1.0 END AS rec,
         coalesce(CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) END, 1.0)
           AS prev_prec
  FROM pts
)"""

AREAS = """
areas AS (
  SELECT CASE WHEN max(n_pos) > 0 THEN sum(pos / n_pos * prec) END AS average_precision,
         CASE WHEN max(n_pos) > 0 THEN sum(pos / n_pos * (prec + prev_prec) / 2.0) END
           AS pr_auc_trapezoid,
         CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0
              THEN sum(neg * (2.0 * tp - pos)) / (2.0 * max(n_pos) * max(n_neg)) END AS roc_auc,
         CAST(coalesce(max(n_pos), 0) AS BIGINT) AS n_pos,
         CAST(coalesce(max(n_neg), 0) AS BIGINT) AS n_neg
  FROM pts2
)"""


def _thr(default: tuple[float, float, float]) -> str:
    return f"""
thr AS (
  SELECT coalesce(max(CASE WHEN rk = 1 THEN thr END), {default[0]}) AS thr,
         coalesce(max(CASE WHEN rk = 1 THEN prec END), {default[1]}) AS prec_at_thr,
         coalesce(max(CASE WHEN rk = 1 THEN rec END), {default[2]}) AS rec_at_thr
  FROM (SELECT *, row_number() OVER (ORDER BY score ASC) AS rk FROM pts2 WHERE prec >= 0.95)
)"""


DL = """
dl AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

OC = """
oc AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
         o.o_orderpriority, c.c_nationkey, c.c_acctbal, c.c_mktsegment
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""


def _holdout_sql() -> str:
    """sklearn-style hold-out quotas and md5-ordered ranks on `labels`."""
    return """
cls AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic),
tot AS (SELECT sum(n) AS n_all, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_test FROM cls),
share AS (
  SELECT c.toxic, c.n, c.n * (t.n_all - t.n_test) / t.n_all AS s, t.n_all, t.n_test
  FROM cls c, tot t
),
fl AS (SELECT *, floor(s) AS fl, s - floor(s) AS frac FROM share),
extra AS (SELECT max(n_all - n_test) - sum(fl) AS k FROM fl),
alloc AS (
  SELECT fl.toxic, fl.n, fl.n - (fl.fl + CASE WHEN rank_frac <= (SELECT k FROM extra) THEN 1 ELSE 0 END)
           AS n_test_c
  FROM (SELECT *, row_number() OVER (ORDER BY frac DESC, toxic ASC) AS rank_frac FROM fl) fl
),
ranked AS (
  SELECT doc_id, toxic,
         row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS r
  FROM labels
),
split AS (
  SELECT r.doc_id, r.toxic, r.r <= a.n_test_c AS is_test
  FROM ranked r JOIN alloc a ON r.toxic = a.toxic
)"""


def _folds_sql(k: int, shuffle: bool, table: str = "labels", key: str = "doc_id", label: str = "toxic") -> str:
    order = f"md5(concat('42:', CAST({key} AS VARCHAR))), {key}" if shuffle else key
    return f"""
cls AS (SELECT {label}, count(*) AS n FROM {table} GROUP BY {label}),
st AS (SELECT {label}, n, coalesce(sum(n) OVER (ORDER BY {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM cls),
fa AS (
  SELECT {label}, f AS fold,
         (CASE WHEN s0 + n > f THEN (s0 + n - f + {k} - 1) // {k} ELSE 0 END)
       - (CASE WHEN s0 > f THEN (s0 - f + {k} - 1) // {k} ELSE 0 END) AS cnt
  FROM st, range({k}) t(f)
),
fb AS (
  SELECT {label}, fold,
         sum(cnt) OVER (PARTITION BY {label} ORDER BY fold ROWS UNBOUNDED PRECEDING) AS hi,
         sum(cnt) OVER (PARTITION BY {label} ORDER BY fold ROWS UNBOUNDED PRECEDING) - cnt AS lo
  FROM fa
),
ranked AS (
  SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS r FROM {table}
),
folded AS (
  SELECT r.{key}, r.{label}, CAST(b.fold AS INTEGER) AS fold
  FROM ranked r JOIN fb b ON r.{label} = b.{label} AND r.r > b.lo AND r.r <= b.hi
)"""


def _wrap_sum(expr: str) -> str:
    """Reduce a HUGEINT sum mod 2^64 and recentre to int64."""
    u = f"((({expr}) % {M64}) + {M64}) % {M64}"
    return f"CAST(CASE WHEN {u} >= {2 ** 63} THEN {u} - {M64} ELSE {u} END AS BIGINT)"


_PREP_NUM = ["o_totalprice", "c_nationkey", "c_acctbal"]
_PREP_CAT = ["o_orderpriority", "c_mktsegment"]


def _prepare_sql() -> str:
    med = ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}" for c in _PREP_NUM)
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _PREP_NUM)
    st = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _PREP_NUM)
    scaled = ", ".join(
        f"round(({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in _PREP_NUM)
    cats = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'MISSING') AS {c}" for c in _PREP_CAT)
    code_ctes = ",\n".join(
        f"code_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code "
        f"FROM (SELECT DISTINCT {c} AS v FROM imp))" for c in _PREP_CAT)
    code_cols = ", ".join(f"coalesce(code_{c}.code, -1.0) AS {c}" for c in _PREP_CAT)
    code_joins = " ".join(f"LEFT JOIN code_{c} ON imp.{c} = code_{c}.v" for c in _PREP_CAT)
    return f"""
j AS (
  SELECT o.o_orderkey, o.o_totalprice, o.o_orderpriority,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS is_f, c.c_nationkey, c.c_acctbal, c.c_mktsegment
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
med AS (SELECT {med} FROM j),
imp AS (SELECT o_orderkey, {imp}, {cats}, is_f FROM j, med),
st AS (SELECT {st} FROM imp),
{code_ctes},
prep AS (
  SELECT imp.o_orderkey, {scaled}, {code_cols}, imp.is_f
  FROM imp CROSS JOIN st {code_joins}
)"""


_URGENT = """
WITH o AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS urgent, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
tot AS (SELECT sum(y) AS p_all, sum(1 - y) AS n_all FROM o),
g AS (SELECT urgent, sum(y) AS p, sum(1 - y) AS n FROM o GROUP BY urgent)"""

_SEARCH = f"""
WITH {EMB_Q}, {EMB_W},
w3 AS (SELECT i, 0 AS c, w FROM emb_w UNION ALL SELECT i, 1, CASE WHEN i <= 32 THEN w ELSE 0 END FROM emb_w
       UNION ALL SELECT i, 2, -w FROM emb_w),
sc AS (SELECT c, vec_id, CAST(any_value(label) = 0 AS INTEGER) AS y, sum(x * w) AS s
       FROM emb_q JOIN w3 USING (i) GROUP BY c, vec_id),
pt AS (SELECT c, vec_id % 3 AS f, s, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY c, f) AS np FROM pt
       WINDOW w AS (PARTITION BY c, f ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT c, f, sum(pos / np * tp / (tp + fp)) AS a FROM cu GROUP BY c, f),
t AS (SELECT CAST(c AS INTEGER) AS candidate, max(a) FILTER (f = 0) AS split0_score, max(a) FILTER (f = 1) AS split1_score,
      max(a) FILTER (f = 2) AS split2_score, avg(a) AS mean_score, stddev_pop(a) AS std_score FROM ap GROUP BY c)"""

_URGENT_FOLDS = f"""
WITH base AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS urgent, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
{_folds_sql(3, True, "base", "o_orderkey", "y")},
g AS (SELECT fold, urgent, sum(f.y) AS p, sum(1 - f.y) AS n FROM folded f JOIN base USING (o_orderkey) GROUP BY ALL),
tr AS (SELECT a.fold, b.urgent, sum(b.p) AS p, sum(b.n) AS n
       FROM (SELECT DISTINCT fold FROM g) a JOIN g b ON a.fold <> b.fold GROUP BY ALL)"""

SQL = {
    # scans, sinks
    "scan_parquet": "SELECT * FROM customer",
    "parquet_roundtrip": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
    "csv_roundtrip": """SELECT d.doc_id, lang, source, n_chars, '"' || text || '" said' AS text,
        CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "table_shape": "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem",
    "column_roles": f"""WITH {DL}
        SELECT 0 AS position, 'lang' AS "column", 'categorical' AS role, count(lang) AS n_non_null FROM dl
        UNION ALL SELECT 1, 'source', 'categorical', count(source) FROM dl
        UNION ALL SELECT 2, 'n_chars', 'numeric', count(n_chars) FROM dl
        UNION ALL SELECT 3, 'quality', 'numeric', count(quality) FROM dl""",
    # projections and casts
    "drop_cols": f"""WITH {OC} SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority,
        c_nationkey, c_acctbal, c_mktsegment FROM oc""",
    "label_cast": "SELECT doc_id, CAST(toxic AS INTEGER) AS label FROM labels",
    "narrow_types": """SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_partkey AS INTEGER) AS l_partkey,
        CAST(l_suppkey AS INTEGER) AS l_suppkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
        CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_extendedprice AS FLOAT) AS l_extendedprice,
        CAST(l_discount AS FLOAT) AS l_discount, CAST(l_tax AS FLOAT) AS l_tax, l_returnflag
        FROM lineitem""",
    "int_or_zero": """SELECT coalesce(l_orderkey, 0) AS g_orderkey, CAST(0 AS BIGINT) AS g_linenumber,
        CAST(0 AS BIGINT) AS g_quantity, CAST(0 AS BIGINT) AS g_returnflag FROM lineitem""",
    "uint64_reinterpret": f"""SELECT c_custkey,
        CAST(((CAST(c_custkey - 750 AS HUGEINT) % {M64}) + {M64}) % {M64} AS VARCHAR) AS u_key,
        CAST(((CAST(c_nationkey - 12 AS HUGEINT) % {M64}) + {M64}) % {M64} AS VARCHAR) AS u_nation
        FROM customer""",
    "quantize_features": f"WITH {EMB_Q} SELECT vec_id, CAST(i - 1 AS INTEGER) AS feature_idx, x FROM emb_q",
    "quantize_model": f"""SELECT CAST(i - 1 AS INTEGER) AS feature_idx,
        CAST(round((avg(CASE WHEN label = 0 THEN CAST(e AS DOUBLE) END)
                   - avg(CASE WHEN label <> 0 THEN CAST(e AS DOUBLE) END)) * 1000.0) AS BIGINT) AS w
        FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY i""",
    "model_roundtrip": f"""SELECT CAST(i - 1 AS INTEGER) AS feature_idx,
        CAST(round((avg(CASE WHEN label = 0 THEN CAST(e AS DOUBLE) END)
                   - avg(CASE WHEN label <> 0 THEN CAST(e AS DOUBLE) END)) * 1000.0) AS BIGINT) AS w
        FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY i""",
    "prefix_features": f"WITH {EMB_Q}, {EMB_W}, {_emb_score('s5', 5)} SELECT vec_id, score FROM s5",
    "zip_truncate": f"WITH {EMB_Q}, {EMB_W}, {_emb_score('s40', 40)} SELECT vec_id, score FROM s40",
    "first_n_rows": f"{EMB} SELECT vec_id, score FROM emb_score ORDER BY vec_id LIMIT 5",
    "batch_slices": """SELECT batch_id, count(*) AS n_rows FROM (
        SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 64) AS BIGINT) + 1 AS batch_id
        FROM orders) GROUP BY batch_id""",
    # join
    "left_join_identity": f"WITH {DL} SELECT * FROM dl",
    "left_join_nullsafe": f"""WITH {DL},
        st AS (SELECT quality, count(*) AS n_in_quality FROM dl GROUP BY quality)
        SELECT dl.doc_id, dl.quality, st.n_in_quality
        FROM dl LEFT JOIN st ON dl.quality IS NOT DISTINCT FROM st.quality""",
    # fitting
    "impute_median": f"""WITH {DL},
        m AS (SELECT median(CAST(n_chars AS DOUBLE)) AS mn, median(CAST(quality AS DOUBLE)) AS mq FROM dl)
        SELECT doc_id, coalesce(CAST(n_chars AS DOUBLE), mn) AS n_chars,
               coalesce(CAST(quality AS DOUBLE), mq) AS quality FROM dl, m""",
    "impute_constant": f"""WITH {DL} SELECT doc_id, coalesce(lang, 'MISSING') AS lang,
        coalesce(source, 'MISSING') AS source,
        coalesce(CAST(quality AS VARCHAR), 'MISSING') AS quality_tag FROM dl""",
    "ordinal_encode": """SELECT doc_id,
        CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS lang,
        CAST(dense_rank() OVER (ORDER BY source) - 1 AS DOUBLE) AS source FROM documents""",
    "ordinal_encode_unknown": """WITH fitrows AS (
          SELECT d.lang, d.source FROM documents d
          WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        cl AS (SELECT lang AS v, CAST(row_number() OVER (ORDER BY lang) - 1 AS DOUBLE) AS code
               FROM (SELECT DISTINCT lang FROM fitrows)),
        cs AS (SELECT source AS v, CAST(row_number() OVER (ORDER BY source) - 1 AS DOUBLE) AS code
               FROM (SELECT DISTINCT source FROM fitrows))
        SELECT d.doc_id, coalesce(cl.code, -1.0) AS lang, coalesce(cs.code, -1.0) AS source
        FROM documents d LEFT JOIN cl ON d.lang = cl.v LEFT JOIN cs ON d.source = cs.v""",
    "standard_scale": f"""WITH {OC},
        st AS (SELECT avg(o_totalprice) AS a1, stddev_pop(o_totalprice) AS s1,
                      avg(c_acctbal) AS a2, stddev_pop(c_acctbal) AS s2 FROM oc)
        SELECT o_orderkey, round((o_totalprice - a1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS o_totalprice,
               round((c_acctbal - a2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS c_acctbal
        FROM oc, st""",
    "scale_passthrough": f"""WITH {OC},
        st AS (SELECT avg(o_totalprice) AS a1, stddev_pop(o_totalprice) AS s1 FROM oc)
        SELECT round((o_totalprice - a1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS o_totalprice,
               o_orderkey, round(c_acctbal, 6) AS c_acctbal FROM oc, st""",
    "prepare_e2e": f"WITH {_prepare_sql()} SELECT * FROM prep",
    "dataset_metadata": f"""SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns,
        '{",".join(_PREP_NUM)}' AS numeric_cols, '{",".join(_PREP_CAT)}' AS categorical_cols,
        '' AS dropped_cols FROM orders""",
    # scoring
    "linear_score": f"{EMB} SELECT vec_id, score FROM emb_score",
    "linear_score_wrapping": f"""WITH
        q AS (SELECT vec_id, i, {_q('e', 2 ** 52)} AS x
              FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i
                    FROM embeddings)), {EMB_W}
        SELECT q.vec_id, {_wrap_sum(f'sum(CAST(q.x AS HUGEINT) * w.w) + ({TEST_MODEL_BIAS})')} AS score
        FROM q JOIN emb_w w ON q.i = w.i GROUP BY q.vec_id""",
    "dot_product_unsigned": f"""WITH {EMB_Q}, {EMB_W}
        SELECT q.vec_id, CAST(((sum(CAST(q.x AS HUGEINT) * w.w) % {M64}) + {M64}) % {M64} AS VARCHAR) AS dot
        FROM emb_q q JOIN emb_w w ON q.i = w.i GROUP BY q.vec_id""",
    "score_table": f"WITH {LI_SCORED} SELECT l_orderkey, l_linenumber, score FROM li_s",
    "score_probability": f"""{EMB} SELECT vec_id,
        round(1.0 / (1.0 + exp(-CAST(score AS DOUBLE) / {EMB_PROB_SCALE!r})), 6) AS prob FROM emb_score""",
    "flag_fraud": f"""{EMB} SELECT vec_id,
        CASE WHEN 1.0 / (1.0 + exp(-CAST(score AS DOUBLE) / {EMB_PROB_SCALE!r})) >= 0.5 THEN 1 ELSE 0 END
          AS flag FROM emb_score""",
    # sealed
    "sealed_score_opened": f"{EMB} SELECT vec_id, score FROM emb_score",
    "shared_score_opened": f"{EMB} SELECT vec_id, score FROM emb_score",
    "tampered_rows": f"""{EMB} SELECT vec_id, CASE WHEN vec_id % 7 IN (1, 2, 3, 4) THEN NULL ELSE score END AS score,
        CASE WHEN vec_id % 7 IN (1, 2, 3, 4) THEN 'FAIL' ELSE 'PASS' END AS status FROM emb_score""",
    "sealed_differs_from_plain": "SELECT vec_id, 0 AS n_equal FROM embeddings",
    "sealed_score": "SELECT vec_id, true AS is_residue, true AS differs FROM embeddings",
    "seal_roundtrip": f"WITH {EMB_Q} SELECT vec_id, CAST(i - 1 AS INTEGER) AS feature_idx, x FROM emb_q",
    "quantized_lr_verify": "SELECT count(*) AS n_rows, count(*) AS n_match, 'PASS' AS status FROM orders",
    "model_contract": """SELECT * FROM (VALUES ('exists', true), ('parses', true), ('has_bias', true),
        ('has_weights', true), ('bias_int', true), ('weights_int', true), ('feature_count', true),
        ('headroom', true)) AS t("check", ok)""",
    "model_contract_broken": """SELECT * FROM (VALUES ('float weight', 'weights_int'), ('float weight', 'feature_count'),
        ('no bias', 'has_bias'), ('no bias', 'bias_int'), ('no bias', 'headroom'), ('text bias', 'bias_int'),
        ('text bias', 'headroom'), ('broken JSON', 'parses'), ('broken JSON', 'has_bias'),
        ('broken JSON', 'has_weights'), ('broken JSON', 'bias_int'), ('broken JSON', 'weights_int'),
        ('broken JSON', 'feature_count'), ('broken JSON', 'headroom'), ('too large', 'headroom')) AS t(model, "check")
        WHERE EXISTS (SELECT 1 FROM embeddings)""",
    "run_log": f"""WITH {LI_SCORED}, {AREAS}
        SELECT 'lr' AS model, 'coarse' AS mode, 'r1' AS run_id, round(average_precision, 4) AS prauc FROM areas
        UNION ALL SELECT 'rf', 'final', 'r2', NULL""",
    "encrypted_batches": """SELECT batch_id, count(*) AS n_rows FROM (
        SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 256) AS BIGINT) + 1 AS batch_id
        FROM orders) GROUP BY batch_id""",
    "appended_batches": """WITH placed AS (
          SELECT o_orderkey % 3 AS part, CAST(floor((row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1) / 256)
                 AS BIGINT) + 1 AS batch FROM orders),
        runs AS (SELECT part, max(batch) AS n FROM placed GROUP BY part)
        SELECT batch + coalesce((SELECT CAST(sum(n) AS BIGINT) FROM runs r WHERE r.part < p.part), 0) AS batch_id, count(*) AS n_rows
        FROM placed p GROUP BY 1""",
    "rekeyed_score_opened": f"{EMB} SELECT vec_id, score FROM emb_score",
    "verify_scores": "SELECT count(*) AS n_rows, count(*) AS n_match, 'PASS' AS status FROM embeddings",
    "validation_pyramid": """WITH n AS (SELECT count(*) AS n FROM embeddings)
        SELECT 'SANITY' AS category, 'I/O Pipeline Check' AS description, CAST(5 AS BIGINT) AS features,
               least(5, n) AS rows, least(5, n) AS matches, 'PASS' AS status FROM n
        UNION ALL SELECT 'CRYPTO', 'Noise Budget Check', 64, least(1, n), least(1, n), 'PASS' FROM n
        UNION ALL SELECT 'SATURATION', '1:1 Core Mapping', 64, least(16, n), least(16, n), 'PASS' FROM n""",
    # metrics
    "pr_curve": f"""WITH {LI_SCORED}
        SELECT round(thr, 6) AS thr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
               round(prec, 6) AS prec, round(rec, 6) AS rec FROM pts2
        UNION ALL SELECT NULL, 0, 0, 1.0, 0.0""",
    "average_precision": f"WITH {LI_SCORED}, {AREAS} SELECT round(average_precision, 6) AS average_precision FROM areas",
    "pr_auc_trapezoid": f"WITH {LI_SCORED}, {AREAS} SELECT round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM areas",
    "roc_auc": f"WITH {LI_SCORED}, {AREAS} SELECT round(roc_auc, 6) AS roc_auc FROM areas",
    "threshold_at_precision": f"""WITH {LI_SCORED}, {_thr((0.5, 0.0, 0.0))}
        SELECT round(thr, 6) AS thr, round(prec_at_thr, 6) AS prec_at_thr,
               round(rec_at_thr, 6) AS rec_at_thr FROM thr""",
    "threshold_smoke": f"""WITH {LI_SCORED}, {_thr((1.0, 1.0, 0.0))}
        SELECT round(thr, 6) AS thr, round(prec_at_thr, 6) AS prec_at_thr,
               round(rec_at_thr, 6) AS rec_at_thr FROM thr""",
    "metric_summary": f"""WITH {LI_SCORED}, {AREAS}, {_thr((0.5, 0.0, 0.0))}
        SELECT round(average_precision, 6) AS average_precision,
               round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid, round(roc_auc, 6) AS roc_auc,
               n_pos, n_neg, round(thr, 6) AS thr, round(prec_at_thr, 6) AS prec_at_thr,
               round(rec_at_thr, 6) AS rec_at_thr FROM areas, thr""",
    "threshold_qualifying": f"""WITH {DIR_POINTS}, {_thr((0.5, 0.0, 0.0))}
        SELECT round(thr, 6) AS thr, round(prec_at_thr, 6) AS prec_at_thr,
               round(rec_at_thr, 6) AS rec_at_thr FROM thr""",
    "average_precision_direction": f"""WITH {DIR_POINTS}, {AREAS}
        SELECT round(average_precision, 6) AS average_precision,
               round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid, round(roc_auc, 6) AS roc_auc,
               n_pos, n_neg FROM areas""",
    # models and search
    "lr_fit_predict": f"""{_URGENT} SELECT o_orderkey, round((p / p_all) / (p / p_all + n / n_all), 3) AS prob
        FROM o JOIN g USING (urgent), tot""",
    "rf_fit_predict": f"{_URGENT} SELECT o_orderkey, round(10 * p / (10 * p + n), 6) AS prob FROM o JOIN g USING (urgent)",
    "gbt_fit_predict": f"""{_URGENT} SELECT o_orderkey,
        round(1.0 / (1.0 + exp(-2.0 * (2.0 * p / (p + n) - 1.0))), 6) AS prob FROM o JOIN g USING (urgent)""",
    "search_closed_form": f"""{_URGENT_FOLDS},
        cu AS (SELECT g.fold, g.p, sum(g.p) OVER w AS tp, sum(g.n) OVER w AS fp, sum(g.p) OVER (PARTITION BY g.fold) AS np
               FROM g JOIN tr USING (fold, urgent) WINDOW w AS (PARTITION BY g.fold ORDER BY tr.p / (tr.p + tr.n) DESC)),
        ap AS (SELECT fold, sum(p / np * tp / (tp + fp)) AS a FROM cu GROUP BY fold)
        SELECT CAST(c AS INTEGER) AS candidate, round(max(a) FILTER (fold = 0), 6) AS split0_score,
            round(max(a) FILTER (fold = 1), 6) AS split1_score, round(max(a) FILTER (fold = 2), 6) AS split2_score,
            round(avg(a), 6) AS mean_score, round(stddev_pop(a), 6) AS std_score, CAST(1 AS INTEGER) AS rank,
            CAST(12 AS BIGINT) AS fits
        FROM ap, range(4) t(c) GROUP BY c""",
    "search_coefficients": f"""{_URGENT_FOLDS},
        odds AS (SELECT fold, weights, urgent, ln(p / n * CASE WHEN weights = 'balanced' THEN n_all / p_all ELSE 1 END) AS o
            FROM (SELECT *, sum(p) OVER (PARTITION BY fold) AS p_all, sum(n) OVER (PARTITION BY fold) AS n_all FROM tr),
                 (VALUES ('balanced'), ('none')) v(weights))
        SELECT fold, weights, round(max(o) FILTER (NOT urgent), 5) AS intercept,
            round(max(o) FILTER (urgent) - max(o) FILTER (NOT urgent), 5) AS slope
        FROM odds GROUP BY fold, weights""",
    "search_rank": f"""{_SEARCH} SELECT candidate, round(split0_score, 6) AS split0_score,
        round(split1_score, 6) AS split1_score, round(split2_score, 6) AS split2_score,
        round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score,
        CAST(rank() OVER (ORDER BY mean_score DESC) AS INTEGER) AS rank FROM t""",
    "search_best": f"{_SEARCH} SELECT candidate FROM t ORDER BY mean_score DESC, candidate LIMIT 1",
    "train_all_models": """SELECT m AS model, n - t AS n_train, t AS n_test, CAST(c AS BIGINT) AS n_candidates,
        CAST(k AS BIGINT) AS n_folds, true AS metrics_match, true AS best_is_used
        FROM (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM orders),
            (VALUES ('lr', 10, 3), ('rf', 30, 2), ('xgb', 30, 2)) AS u(m, c, k)""",
    "cost_report": """SELECT event_id, round(s, 2) AS seconds, round(3600 / s, 2) AS rows_per_sec,
        round(CAST(0.78 AS DOUBLE) / 3600 * s, 6) AS cost_usd FROM (SELECT event_id, value + 0.003 AS s FROM events)""",
    # splits
    "stratified_split": f"WITH {_holdout_sql()} SELECT doc_id, toxic, is_test FROM split",
    "stratified_split_counts": f"""WITH {_holdout_sql()}
        SELECT toxic, is_test, count(*) AS n FROM split GROUP BY toxic, is_test""",
    "stratified_folds": f"WITH {_folds_sql(5, True)} SELECT doc_id, toxic, fold FROM folded",
    "stratified_folds_counts": f"""WITH {_folds_sql(5, True)}
        SELECT toxic, fold, count(*) AS n FROM folded GROUP BY toxic, fold""",
    "folds_by_order": f"WITH {_folds_sql(2, False)} SELECT doc_id, toxic, fold FROM folded",
    "class_weights": """WITH cls AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic),
        k AS (SELECT sum(n) AS n_all, count(*) AS k FROM cls)
        SELECT l.doc_id, l.toxic, round(k.n_all / (k.k * c.n), 6) AS weight
        FROM labels l JOIN cls c ON l.toxic = c.toxic CROSS JOIN k""",
}
SQL["artifact_roundtrip"] = SQL["prepare_e2e"]
SQL["metadata_json"] = SQL["dataset_metadata"]

SQL["merged_metrics"] = SQL["metric_summary"]
