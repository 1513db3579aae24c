import random

from veilscore.llm.components import connected_components


def test_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)]
    edges += [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0
