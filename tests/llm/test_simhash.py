import numpy as np
import pytest
import xxhash

from veilscore.llm import simhash as S

WS = b" \t\n\r\x0b\x0c"


def brute_components(prints):
    """Smallest id over links of at most 3 bits; prints: {id: fingerprint}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\x0b", " ").replace(
        "\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b\x0bC d\u0085e é", "x " * 50])
def test_fingerprint_matches_brute_force(text):
    assert S.fingerprint(S.shingle_hashes((text or "").encode())) == brute_fingerprint(text)


def edges_of(fps):
    out = [b for b in S._variants(iter([__import__("pyarrow").RecordBatch.from_pydict(
        {"fp": np.array(fps, np.uint64).view(np.int64)})]))]
    key = np.concatenate([b.column(0).to_numpy() for b in out]).view(np.uint64)
    fp = np.concatenate([b.column(1).to_numpy() for b in out]).view(np.uint64)
    order = np.argsort(key.view(np.int64), kind="stable")
    return S.link_sorted(key[order], fp[order])


@pytest.mark.parametrize("seed", range(4))
def test_links_connect_exactly_the_pairs_within_three_bits(seed):
    rng = np.random.default_rng(seed)
    fps = set()
    for _ in range(12):                                   # dense clouds around centres
        centre = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(25):
            flip = 0
            for bit in rng.choice(64, size=rng.integers(0, 7), replace=False):
                flip |= 1 << int(bit)
            fps.add(centre ^ flip)
    fps = sorted(fps)
    a, b = edges_of(fps)
    assert all(bin(int(x) ^ int(y)).count("1") <= 3 for x, y in zip(a, b))
    want = brute_components({f: f for f in fps})
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x, y in zip(a.tolist(), b.tolist()):
        lo, hi = sorted((find(x), find(y)))
        root[hi] = lo
    assert {f: find(f) for f in fps} == want


def test_query_matches_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again ".split()
    long = base * 40
    rows = [(1, None), (2, ""), (3, " \n "), (4, "alpha beta"), (5, "ALPHA beta"), (5, "ALPHA beta"),
            (6, " ".join(long)), (7, " ".join(long + ["tail"])), (None, " ".join(long)), (8, "x y z " * 200)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows],
                               "doc_id long, text string, component_id string, fp int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in S.near_duplicates(df).collect()}
    prints = {(i, t): brute_fingerprint(t) for i, t in rows}
    want = brute_components({i: f for (i, t), f in prints.items() if i is not None})
    for (i, t), f in prints.items():
        assert got[(i, f"{f:016x}")] == (want[i] if i is not None else want[6])
    assert S.near_duplicates(df).count() == len(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in S.near_duplicates(df).collect()] == [None, None]
    assert S.one_per_group(df).count() == 1


def test_one_row_of_each_group_stays(spark):
    rows = [(2, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (3, "other words entirely here now"),
            (None, "a b c d e"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    kept = sorted((r.doc_id, r.text, r.digest) for r in S.one_per_group(df).collect())
    assert kept == sorted([(1, "a b c d e", "x"), (3, "other words entirely here now", "x"), (4, None, "x")])


def test_callers_digest_column_stays(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (2, "a b c d", 6)], "doc_id long, text string, __digest int")
    assert [tuple(r) for r in S.one_per_group(df).select("doc_id", "__digest").collect()] == [(1, 5)]
