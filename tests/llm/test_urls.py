import re

import numpy as np
import pytest

from tests.conftest import SF_ORACLE
from veilscore.llm import urls as U
from veilscore.llm.queries import QUERIES, URL_RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path, rules):
    fit = [(len(h + p), h + p, a) for h, p, a in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit) if fit else None


URLS = [None, "", "nohost", "http://", "HTTP://EXAMPLE.org/es/x", "http://example.org/en/12?q", "https://a.b.org", "http://org/",
        "http://notexample.org/es/", "x://y.com/fr/?z=://w.org/", "http://É.com/de/#f", "http://a.com?x/fr/", "http://com/de/",
        "http://h.net/\nq", "://z.com/fr/", "http://a.com#://b.org/"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)],
                               "page_id long, url string, html string, rule string")
    for r in U.judged(df, URL_RULES).collect():
        host, path = parse(URLS[r.page_id])
        want = rule(host, path, URL_RULES)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (want and want[1])
        if want:
            assert r.verdict == ("allow" if want[2] else "block")


def test_query_rules(spark):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{SF_ORACLE}/pages.parquet").collect()}
    got = QUERIES["op10_link_graph_url_filter"](spark, SF_ORACLE).collect()
    assert len(got) == len(url)
    for r in got:
        host, path = parse(url[r.page_id])
        want = rule(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, want and want[1])
        assert r.verdict in ("allow", "block")


def test_scores_match_dense_power_iteration(spark):
    rng = np.random.default_rng(5)
    hosts = [f"h{i}.net" for i in range(12)]
    pages, weight = [], np.zeros((12, 12))
    for i in range(12):
        for _ in range(3):
            to = rng.choice(12, size=3, replace=False)
            pages.append((len(pages), f"http://{hosts[i]}/x", "".join(f'<a href="https://{hosts[j]}/y">' for j in to)))
            for j in to:
                if i != j:
                    weight[i, j] += 1
    pages += [(100, "http://h0.net/good/", None), (101, "http://h1.net/bad/", None), (102, "http://h1.net/bad/", None)]
    rules = [("h0.net", "/good/", True), ("h1.net", "/bad/", False)]
    got = {r.host: (r.trust, r.distrust) for r in U.judged(
        spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    good, bad = np.zeros(12), np.zeros(12)
    good[0], bad[1] = 1 / 4, 2 / 5
    forward = weight / np.maximum(weight.sum(1, keepdims=True), 1)
    backward = weight.T / np.maximum(weight.T.sum(1, keepdims=True), 1)
    trust, distrust = good * 0.15, bad * 0.15
    for _ in range(300):
        trust, distrust = good * 0.15 + 0.85 * forward.T @ trust, bad * 0.15 + 0.85 * backward.T @ distrust
    for i, h in enumerate(hosts):
        assert got[h] == pytest.approx((trust[i], distrust[i]), abs=2e-3)


def test_small_scores_flow_on(spark):
    edges = spark.range(200_000).selectExpr("concat('l', id) source", "'bad' target", "1d weight").union(
        spark.createDataFrame([("far", "l0", 1.0), ("farther", "far", 1.0)], "source string, target string, weight double"))
    seeds = spark.createDataFrame([("bad", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: r.distrust for r in U.link_scores(seeds, edges).filter("host in ('l0', 'far', 'farther')").collect()}
    want = 0.15 * 0.85 / 200_000
    assert got == pytest.approx({"l0": want, "far": want * 0.85, "farther": want * 0.85 ** 2}, rel=1e-9)


def test_unsettled_scores_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_ITERATIONS", 3)
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "source string, target string, weight double")
    with pytest.raises(RuntimeError):
        U.link_scores(spark.createDataFrame([("a", 1.0, 0.0)], "host string, good double, bad double"), edges)


def test_links_decide_and_edge_cases(spark):
    rows = [(1, "http://a.net/x", '<a href="http://bad.example.org/es/">'), (2, "http://bad.example.org/es/q", None),
            (3, "HTTPS://C.Net", '<A class=x HREF=//good.org/z> <a href="/rel">'), (4, None, '<a href="http://bad.example.org">'),
            (6, "http://good.org/", "<a href='http://d.net?x'><a href=\"http://d.net/2\">" + "x" * 200_000),
            (7, "http://d.net/", None), (7, "http://d.net/", None), (None, "http://d.net/", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    rules = [("org", "/", True), ("example.org", "/es/", False)]
    got = {}
    for r in U.judged(df, rules).collect():
        got.setdefault(r.page_id, []).append(r.verdict)
    assert got == {1: ["block"], 2: ["block"], 3: ["allow"], 4: ["allow"], 6: ["allow"], 7: ["allow"] * 2, None: ["allow"]}
    assert U.judged(df.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judged(df, []).collect()} == {"allow"}
