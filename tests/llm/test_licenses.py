import re

from hypothesis import given, settings
from hypothesis import strategies as st

from veilscore.llm import licenses
from veilscore.llm.license_rules import BASE, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(f" {w} " for w in WORD.findall(lower))


def brute(text):
    """Every rule on every text, suppression by comparing all pairs."""
    t, found = spaced(text), []
    for r in rules():
        for m in re.finditer(r.regex, t):
            at = t[:m.start()].count(" ") // 2
            found.append((at, at + m.group().count(" ") // 2, r))
    inside = lambda a, b: b is not a and b[0] <= a[0] and a[1] <= b[1] and (
        b[:2] != a[:2] or (b[2].priority, b[2].number) < (a[2].priority, a[2].number))
    free = [a for a in found if not any(inside(a, b) for b in found)]
    kept = [a for a in free if not any(b[0] < a[1] and a[0] < b[1] and b[2].priority < a[2].priority for b in free)]
    base = [a for a in found if a[2].base]
    counted = base + kept
    return (t.count(" ") // 2, len(base), min((a[0] for a in base), default=None), max((a[0] for a in base), default=None),
            sorted({a[2].label for a in base}), sorted({a[2].label for a in counted}),
            max((a[2].confidence for a in counted), default=0.0),
            sorted((a[0], a[1], a[2].number, a[2].label) for a in kept))


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"],
                          r["score"], [tuple(s) for s in r["spans"]]) for r in licenses.licenses(docs).collect()}


def same(spark, texts):
    got = run(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == brute(text), (text, got[i], brute(text))


def samples(parsed):
    """Strings a parsed pattern matches: every branch and option, first characters."""
    out = [""]
    for kind, arg in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            part = [chr(arg)]
        elif kind == "IN":
            part = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])] if str(arg[0][0]) != "NEGATE" else ["q"]
        elif kind == "NOT_LITERAL":
            part = ["q"]
        elif kind == "SUBPATTERN":
            part = samples(arg[-1])
        elif kind == "BRANCH":
            part = [x for branch in arg[1] for x in samples(branch)]
        elif kind == "MAX_REPEAT":
            part = ([""] if arg[0] == 0 else []) + samples(arg[2])
        else:
            raise AssertionError(f"construct {kind} is not allowed")
        out = [x + y for x in out for y in part]
    return out


def test_every_match_holds_its_keyword():
    for r in rules():
        tries = samples(re._parser.parse(r.regex))
        assert all(re.fullmatch(r.regex, t) and f" {r.keyword} " in t for t in tries), r
    assert len(rules()) > 300 and [r.label for r in rules() if r.base] == [label for _, label in BASE]


def test_known_texts(spark):
    got = run(spark, ["This work is licensed under the GNU General Public License, version 3.",
                      "Released under the MIT License. See MIT-License, mit\tlicense!",
                      "// SPDX-License-Identifier: GPL-2.0-or-later", "licensed under CC BY-NC 4.0."])
    assert got[0][4:7] == (["gpl"], ["gpl", "gpl-3.0"], 0.9)
    assert got[1][1:5] == (3, 3, 8, ["mit"])
    assert got[2][4:7] == ([], ["gpl-2.0-or-later"], 1.0)
    assert got[3][5] == ["cc-by-nc-4.0"]


def test_edge_cases(spark):
    long = "word " * 150_000 + "MIT License " * 1500 + "É" * 200_000 + " Apache License, Version 2.0"
    same(spark, [None, "", " \n.,", "mit", "license mit license mit license", "MIT License", "mitlicense mit licenses",
                 "GPL v2 or later GPL", "cc by nc sa 4.0 cc by", "new bsd license zlib license", "x" * 100_000,
                 "the mit license the mit license", "a mit license", "a mit license"])
    got = run(spark, [long])[0]
    assert got[0] == 150_000 + 3000 + 1 + 5 and got[1] == 1501 and got[5] == ["apache", "apache-2.0", "mit"]


def test_ids_tables_and_names(spark):
    rows = [(None, "mit license", 1, 2), (None, "mit license", 1, 2), (7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` int, `a.b` int")
    got = sorted((r["doc_id"] or 0, r["n_base"]) for r in licenses.licenses(docs).collect())
    assert got == [(0, 1), (0, 1), (7, 0)]
    assert licenses.licenses(docs.limit(0)).count() == 0


_WORDS = ["mit", "license", "gpl", "v2", "2", "0", "or", "later", "general", "public", "gnu", "the", "apache", "version",
          "licensed", "under", "bsd", "3", "clause", "cc", "by", "sa", "nc", "4", "x", "lesser", "new", "spdx", "identifier"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_WORDS), max_size=30).map(" ".join), min_size=20, max_size=40))
def test_random_phrases_match_brute_force(spark, texts):
    same(spark, texts)
