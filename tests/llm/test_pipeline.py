"""Every stage of the pipeline against a brute-force version on a small fixture."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_shard import check_law
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_winnow import brute as brute_hits
from veilscore.llm import mix
from veilscore.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, SHARDS, mix_levels

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    en = "the of and to in that is was for it with as his on be at by".split()
    de = "der die und in den von zu das mit sich des auf ist nicht ein eine als".split()
    line = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "en", "ing", "ly"]) for _ in range(n))
    items = [(i, line(en, 30)) for i in range(4)]
    docs = [(i, line(en, 60), "en", f"src{i % 5}") for i in range(60)]
    docs += [(100 + i, line(de, 60), "de", f"src{i % 3}") for i in range(40)]
    docs += [(200 + i, docs[i][1], "en", "src1") for i in range(10)]                     # copies
    docs += [(300 + i, line(en, 20) + " " + items[i][1] + " " + line(en, 20), "en", "src2") for i in range(4)]
    docs += [(400, None, "en", "src1"), (401, "", "de", "src1"), (402, "12 34 !?", None, None),
             (403, line(de, 50), None, None), (None, line(en, 50), "en", "src0"), (0, docs[0][1], "en", "src0"),
             (404, line(en, 30_000), "en", "src4")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*d, 1, "own") for d in docs], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages(spark, tables):
    path, _, items = tables
    stage = dict(P.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    kept = stage["language"](spark, docs, path)
    assert kept.columns == columns
    before, after = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in kept.collect())
    assert before - after == Counter([400, 401, 402])
    assert kept.filter("doc_id = 403").first().lang == "de"

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    single = stage["near-duplicates"](spark, kept, path)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    prints = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    groups = brute_components(prints)
    lone = {r.doc_id for r in single.collect()} - {None}
    assert single.columns == columns and lone == set(groups.values())
    assert single.count() == len(lone) + sum(i is None for i, _ in rows)

    single = spark.createDataFrame(single.collect(), docs.schema)
    clean = stage["decontamination"](spark, single, path)
    want = [d for d, _, hits, _ in brute_hits([(r.doc_id, r.text) for r in single.collect()], items) if not hits]
    assert clean.columns == columns and Counter(r.doc_id for r in clean.collect()) == Counter(want)
    assert {300, 301, 302, 303}.isdisjoint(want)

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    mixed = stage["mix"](spark, clean, path)
    plan = mix.mixed(clean, mix_levels(), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    assert mixed.columns == columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in plan.collect())

    mixed = spark.createDataFrame(mixed.collect(), docs.schema)
    dealt = stage["shards"](spark, mixed, path)
    out = dealt.collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    check_law(out, SHARDS)


def test_run_is_reproducible(spark, tables):
    path = tables[0]
    first = sorted(map(repr, P.run(spark, path).drop("n_chars").collect()))
    assert first == sorted(map(repr, P.run(spark, path).drop("n_chars").collect())) and first


def test_empty_documents(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, tables[0]).collect(), stage(spark, docs, tables[0]).schema)
        assert docs.count() == 0
