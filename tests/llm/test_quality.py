import re
import struct
import zlib
from math import log

import numpy as np
import pandas as pd
import xxhash

from tests.conftest import SF_ORACLE
from tests.llm.test_rules import WORD, brute
from veilscore.llm import quality as Q
from veilscore.llm.queries import QUERIES


def auc(score, label):
    rank = pd.Series(score).rank().to_numpy()
    pos, neg = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


def test_held_out_accuracy(spark):
    got = QUERIES["op3_quality_classifier"](spark, SF_ORACLE).toPandas()
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF_ORACLE}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert len(held) > 50
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.95
    assert (held.predicted == held.quality).mean() > 0.95


def brute_statistics(text):
    c, text = brute(text), text or ""
    words = WORD.findall(text)
    letters = re.findall(r"[A-Za-z\u0080-\U0010ffff]", text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    many = lambda chars: sum(text.count(x) for x in chars)
    n, chars = c["n_words"], c["word_chars"]
    per = lambda k, of: k / max(of, 1)
    return [log(1 + n), per(chars, n), per(c["n_symbols"], chars) ** 0.5, per(c["n_dup_lines"], lines) ** 0.5,
            per(c["n_repeat_words"], n) ** 0.5, per(len(set(words)), n),
            per(sum("A" <= x <= "Z" for x in letters), len(letters)) ** 0.5, per(many("0123456789"), chars) ** 0.5,
            per(many(".,;:!?\"'()-"), chars) ** 0.5, per(sum(x > "\x7f" for x in letters), len(letters)),
            log(1 + per(n, lines))]


def isotonic(raw, label):
    """Distinct raw scores and the non-decreasing fit by pooling adjacent violators."""
    knots, at = np.unique(raw, return_inverse=True)
    blocks = []
    for total, n in zip(np.bincount(at, label), np.bincount(at)):
        blocks.append([total, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return knots, np.concatenate([[t / n] * k for t, n, k in blocks])


def test_scores_match_brute_force(spark):
    """Every score recomputed on one machine: statistics, features, ridge, calibration."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    labels = [(r.doc_id, float(r.quality)) for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()
              if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs]
    x = {i: brute_statistics(t) for i, t in docs.items()}
    fold = np.array([xxhash.xxh64_intdigest(b"fold", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)) % 2
                     for i, _ in labels])
    train, label = np.array([x[i] for i, _ in labels]), np.array([v for _, v in labels])
    mean, spread = train.mean(0), np.maximum(train.std(0), 1e-3)
    rng = np.random.default_rng(Q.SEED)
    weights = rng.normal(size=(train.shape[1], Q.FEATURES)) / Q.WIDTH
    phase = rng.uniform(0.0, 2.0 * np.pi, Q.FEATURES)
    lift = lambda m: np.sqrt(2 / Q.FEATURES) * np.cos(np.clip((m - mean) / spread, -8, 8) @ weights + phase)
    z, base, n = lift(train), label.mean(), len(label)
    fit = lambda rows, of: np.linalg.solve(z[rows].T @ z[rows] + Q.RIDGE * of * np.eye(Q.FEATURES),
                                           z[rows].T @ (label[rows] - base))
    outside = base + np.where(fold == 0, z @ fit(fold == 1, n / 2), z @ fit(fold == 0, n / 2))
    knots, heights = isotonic(outside, label)
    ids = list(docs)
    raw = base + lift(np.array([x[i] for i in ids])) @ fit(fold >= 0, n)
    want = (1 - Q.SLOPE) * np.interp(raw, knots, heights) + Q.SLOPE / (1 + np.exp(-np.clip(8 * (raw - 0.5), -50, 50)))
    got = QUERIES["op3_quality_classifier"](spark, SF_ORACLE).toPandas().set_index("doc_id").score
    assert np.abs(got[ids].to_numpy() - want).max() < 1e-6


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, len(Q.NAMES)))
    weights = rng.normal(size=(len(Q.NAMES), 40_000)) / Q.WIDTH
    z = Q.features(x, 0.0, 1.0, weights, rng.uniform(0, 2 * np.pi, 40_000))
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-gap / (2 * Q.WIDTH ** 2))).max() < 0.05


def test_normal_equations_equal_one_pass(spark):
    rng = np.random.default_rng(1)
    n, d = 200, 16
    x = rng.normal(size=(n, len(Q.NAMES)))
    label, fold = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, n)
    weights, phase = rng.normal(size=(len(Q.NAMES), d)), rng.uniform(0, 6, d)
    frame = pd.DataFrame(x, columns=Q.NAMES).assign(label=label, fold=fold.astype(np.int32))
    got = Q._normal_equations(spark.createDataFrame(frame).repartition(5), 0.0, 1.0, weights, phase, 0.3)
    z = np.column_stack((Q.features(x, 0.0, 1.0, weights, phase), label - 0.3))
    for f in (0, 1):
        assert np.allclose(got[f], z[fold == f].T @ z[fold == f])


def test_edge_cases(spark):
    rows = [(i, "Some words in a plain sentence here. " * 3) for i in range(30)]
    rows += [(100 + i, "### $$$ %%% &&& ***" * 5) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \n"), (202, " \n"), (None, "plain words"), (203, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, length int")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)]
                                   + [(None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    stats = Q.statistics(docs)
    model = Q.train(stats, labels)
    got = Q.predict(stats, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and got.score.notna().all()
    by = got.dropna().set_index("doc_id").score
    assert by[0] > 0.5 > by[100]
    assert by[202].nunique() == 1
    assert Q.train(stats, labels.limit(0)) is None
    assert set(Q.predict(stats, None).toPandas().score) == {0.5}
    assert Q.predict(Q.statistics(docs.limit(0)), model).count() == 0
    one_class = Q.train(stats, labels.filter("quality = 1"))
    assert (Q.predict(stats, one_class).toPandas().score > 0.5).all()
