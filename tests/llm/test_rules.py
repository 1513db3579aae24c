import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE
from veilscore.llm import rules as R
from veilscore.llm import stats as S
from veilscore.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i:i + 5])] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def test_counts_match_brute_force_on_whole_texts(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    got = QUERIES["op7_mcd_quality_rules"](spark, SF_ORACLE).collect()
    assert len(got) == len(text)
    for r in got:
        want = brute(text[r.doc_id])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert r.base_failed == failed and not (r.kept and failed)


def test_clean_documents_stay_and_junk_goes(spark):
    got = QUERIES["op7_mcd_quality_rules"](spark, SF_ORACLE)
    both = got.join(spark.read.parquet(f"{SF_ORACLE}/labels.parquet"), "doc_id").toPandas()
    good = both[(both.quality == 1) & ~both.base_failed]
    assert good.kept.mean() > 0.99
    assert both[both.quality == 0].kept.mean() < 0.5


@pytest.mark.parametrize("text", [None, "", " \n\t\n", "a\na\n\x0b\na b\na", "x " * 40, "é\u0085ü \u00a0 z", "w" * 70_000])
def test_counts_of_odd_texts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = S.counted(df).first()
    want = brute(text)
    assert {k: row[k] for k in want} == want


@pytest.mark.parametrize("k, p, want", [(1, 0.95, 3.841459), (7, 0.999, 24.32189), (2, 0.5, 1.386294)])
def test_chi_square(k, p, want):
    assert R.chi2_quantile(p, k) == pytest.approx(want, rel=1e-5)


def slow_steps(x, steps=60):
    """Concentration steps of one group from both starts, on all rows in memory."""
    scale = R.KEPT_SHARE / R.chi2_cdf(R.chi2_quantile(R.KEPT_SHARE, R.P), R.P + 2)
    floors = np.diag([f[2] ** 2 for f in R.FEATURES])
    best = None
    mid = np.median(x, axis=0)
    starts = [(mid, np.diag((1.4826 * np.median(np.abs(x - mid), axis=0)) ** 2)), (x.mean(0), np.cov(x.T, bias=True))]
    for mean, cov in starts:
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov + floors), x - mean)
            near = x[np.argsort(d, kind="stable")[:int(np.ceil(len(x) * R.KEPT_SHARE))]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) * scale
        det = np.linalg.slogdet(cov + floors)[1]
        if best is None or det < best[0]:
            best = det, mean, cov + floors
    return best


def test_estimate_is_near_the_in_memory_one(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(R.P, R.P)) * 0.3 + np.eye(R.P)
    x = rng.normal(size=(2000, R.P)) @ mix
    x[:300] += 9.0                                     # 15 % far away
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x],
                                  "grp string, " + ", ".join(f"{n} double" for n in R.NAMES))
    frame = frame.withColumn("salt", (F.monotonically_increasing_id() % R.SALTS).cast("int"))
    fit = R.fitted(frame).first()
    det, mean, cov = slow_steps(x)
    assert fit.logdet == pytest.approx(det, abs=0.15)
    assert np.allclose([fit[f"m{i}"] for i in range(R.P)], mean, atol=0.1)
    judged = frame.join(spark.createDataFrame([fit]), "grp").withColumn("d", R._distance()).toPandas()
    limit = R.chi2_quantile(0.999, R.P)
    assert (judged.d[:300] > limit).all() and (judged.d[300:] > limit).mean() < 0.02


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    vocab = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "elit", "sed", "do", "eiusmod", "tempor"]
    plain = lambda: " ".join(rng.choice(vocab, 30)).capitalize() + "."
    rows = [(i, plain(), "en", "a") for i in range(150)]
    rows += [(500 + i, plain(), "en", f"s{i}") for i in range(120)]               # small sources pool
    rows += [(700 + i, plain(), None, None) for i in range(5)]                    # too few to judge
    rows += [(800, "#$%&* " * 40 + plain(), "en", "a"), (801, None, "en", "a"), (802, "", None, "a"),
             (803, " \n ", "en", None), (0, plain(), "en", "a"), (None, plain(), "en", "a"),
             (804, plain() * 3000, "en", "a"), (805, "#$%&* " * 40, "zz", "q")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "doc_id long, text string, lang string, source string, kept string, grp int")
    got = R.judged(df).collect()
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        kept.setdefault(r.doc_id, []).append(r.kept)
    assert kept[800] == [False] and kept[801] == [False] and kept[802] == [False] and kept[803] == [False]
    assert all(all(kept[i]) for i in range(1, 150) if not brute(rows[i][1])["n_repeat_words"]) and all(kept[700 + i] == [True] for i in range(5))
    failed = {r.doc_id for r in got if r.base_failed}
    assert all(kept[500 + i] == [500 + i not in failed] for i in range(120)) and kept[None] == [True]
    assert R.judged(df.limit(0)).count() == 0


@pytest.mark.parametrize("others", [0, 150])
def test_small_last_pool_is_judged(spark, others):
    rng = np.random.default_rng(7)
    vocab = [a + b for a in ("lo", "ip", "do", "si", "am", "con", "el") for b in ("rem", "sum", "lor", "met", "tur", "sed")]
    plain = lambda: " ".join(rng.choice(vocab, 30, replace=False)).capitalize() + "."
    rows = [(i, plain(), "en", "a") for i in range(others)] + [(500 + i, plain(), None, "q") for i in range(60)]
    rows += [(800, " ".join(f"#$%&*{a}" for a in vocab[:30]), None, "q")]
    got = {r.doc_id: r for r in R.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and not got[800].base_failed and not got[800].kept
    assert all(r.kept and r.distance is not None for i, r in got.items() if i != 800)


def test_unsettled_determinants_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_STEPS", 1)
    x = np.random.default_rng(4).normal(size=(500, R.P)) * 3
    x[:100] += 30.0
    frame = spark.createDataFrame([("g", i % R.SALTS, *map(float, r)) for i, r in enumerate(x)],
                                  "grp string, salt int, " + ", ".join(f"{n} double" for n in R.NAMES))
    with pytest.raises(RuntimeError):
        R.fitted(frame)
