import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_ORACLE
from veilscore.llm import pii as P
from veilscore.llm.queries import QUERIES

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn_table(digits):
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    out = []
    for k, form in enumerate(FORMS.values()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".") if k == 1),
                    16 <= len(digits) <= 19 and luhn_table(digits), 8 <= len(digits) <= 15][k]
            if good:
                out.append((k, *m.span()))
    return out


ODD = ["a.b@c.d@e.f", "@a.b", "x@y", "x@y.", "x@-.-", "é@a.b", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "1.2.3.400 1.2.3.4",
       "01.002.0003.255", "4111 1111-1111 1111", "5 4111111111111111", "4111111111111111", "41111111111111111",
       "+1 (234) 555-0100", "+1", "+1 ", "+12345678901234567", "++123456789", "+1234567 .", "a+1@b.co", "", None,
       "💥 x@y.z 10.0.0.1", "1" * 400, "12.34 " * 50]


@pytest.mark.parametrize("text", ODD)
def test_strict_forms(text):
    assert P.seeds(text or "") == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- ()é9", max_size=40))
def test_strict_forms_on_random_texts(text):
    assert P.seeds(text) == brute(text)


def test_long_runs_stay_fast():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 100_000, "a@" * 50_000,
                 "1 " * 100_000, "at " * 50_000 + "dot"):
        taken = P.seeds(text)
        P.candidates(text, taken)


def test_query_matches_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").collect()}
    got = QUERIES["op5_bootstrapped_pii"](spark, SF_ORACLE).collect()
    assert len(got) == len(text)
    for r in got:
        base = brute(text[r.doc_id])
        named = [f"{P.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        assert set(named) <= set(filter(None, r.spans.split(",")))


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base string, row int")
    out = {}
    for r in P.personal_data(df).select("doc_id", P.listed("base").alias("b"), P.listed("spans").alias("s")).collect():
        out.setdefault(r.doc_id, []).append((r.b, r.s))
    return out


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 (20{i}) 555-01{i}0 thanks a lot") for i in range(5)]
    rows += [(20 + i, f"write to {c}1@x.org now") for i, c in enumerate("abc")]
    rows += [(10, "please call me at 555-123-4567 thanks a lot"), (11, "number 555-123-9999 of boxes"),
             (12, "é call me at (030) 1234 567 today"), (23, "write to john.doe at example dot com now"),
             (13, None), (14, ""), (15, "no data"), (None, "call me at 555-123-4567")]
    got = found(spark, rows)
    assert got[10] == [("", "phone:18:30")] and got[12] == [("", "phone:13:27")]
    assert got[None] == [("", "phone:11:23")]
    assert got[23] == [("", "email:9:36")]
    assert got[11] == [("", "")] == got[13] == got[14] == got[15]


def test_overlapping_candidates_are_all_scored(spark):
    rows = [(i, f"please call me at +1 (20{i}) 555-01{i}0. Thanks a lot") for i in range(5)]
    rows += [(20 + i, f"write to {c}1@x.org now") for i, c in enumerate("abc")]
    rows += [(10, "please call me at 555-123-4567. Thanks a lot"),
             (11, "An anecdote: please call me at 555-123-4567. Thanks a lot"),
             (12, "An anecdote: write to john.doe at 5551234567 dot com now"),
             (13, "An anecdote: write to look at john.doe at example.com now")]
    got = found(spark, rows)
    assert got[10] == [("", "phone:18:30")] and got[11] == [("", "phone:31:43")]
    assert got[12] == [("", "email:22:52")]
    assert (0, 30, 53) in P.candidates(rows[-1][1], []) and len(P.candidates(rows[-1][1], [])) == 2


@pytest.mark.parametrize("form, kind", [("write to john.doe at example.com now", 0), ("mail a(at)b dot org please", 0),
                                        ("ask x [at] y.net today", 0), ("host dead:beef:cafe:feed is up", 1)])
def test_other_words_of_a_text_decide_nothing(form, kind):
    alone = P.candidates(form, [])
    assert [c[0] for c in alone] == [kind]
    for other in ("An anecdote: ", "(look at) ", "Flat] ", "In 7 days: "):
        assert P.candidates(other + form, []) == [(k, s + len(other), e + len(other)) for k, s, e in alone]


def test_spelled_addresses_need_contexts_only(spark):
    rows = [(20 + i, f"write to {c}1@x.org now") for i, c in enumerate("abc")]
    rows += [(10, "write to john.doe at example.com now"), (11, "An anecdote: write to john.doe at example.com now"),
             (12, "we looked at it. Then we left")]
    got = found(spark, rows)
    assert got[10] == [("", "email:9:32")] and got[11] == [("", "email:22:45")] and got[12] == [("", "")]


def test_overlaps_go_to_the_most_confident():
    assert P.apart([(0.9, 0, 5, 20), (0.95, 3, 8, 12), (0.85, 3, 12, 15), (0.9, 1, 30, 40), (0.9, 3, 30, 35)]) == [
        (3, 8, 12), (3, 12, 15), (1, 30, 40)]
    assert P.apart([(0.8, k, i, i + 2) for k in (0, 3) for i in range(6)]) == [(0, 0, 2), (0, 2, 4), (0, 4, 6)]
    assert P.apart([]) == []


def chain(spark, n):
    """Patterns that share four instances with the next; only the first has seeds."""
    rows = [("p0", 3, i, True) for i in range(4)]
    rows += [(f"p{p}", 3, 100 + 4 * k + i, False) for k in range(n) for p in (k, k + 1) if p < n for i in range(4)]
    return spark.createDataFrame(rows, "pattern string, kind int, instance long, seed boolean")


def test_turns_go_on_until_the_far_end_is_reached(spark):
    got = {(r.kind, r.instance) for r in P.confident(chain(spark, 14)).collect()}
    assert got == {(3, 100 + i) for i in range(56)}


def test_unfinished_turns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_ROUNDS", 5)
    with pytest.raises(RuntimeError):
        P.confident(chain(spark, 14))


def test_copies_are_no_evidence_and_mixed_contexts_discover_nothing(spark):
    rows = [(i, "please call me at +1 (200) 555-0100 thanks") for i in range(30)]         # one instance
    rows += [(40, "please call me at 555-123-4567 thanks")]
    rows += [(50 + i, f"the value is +1 (20{i}) 555-0100 here") for i in range(4)]
    rows += [(60 + i, f"the value is 10.0.0.{i} here") for i in range(4)]
    rows += [(70, "the value is 555-123-4567 here")]
    got = found(spark, rows)
    assert got[40] == [("", "")] and got[70] == [("", "")]


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_pattern_keys_are_one_to_one():
    def keys(before, after):
        return set(P.patterns(f"{before} X {after}", len(before) + 1, len(before) + 2))
    sides = ["a|b", "a", "|", "_", "a b", "b", "||", "a | b", "b|c", "c", "two a", "around"]
    seen = {}
    for before in sides:
        for after in ["c", "b|c", "|", "_", "||"]:
            for key in keys(before, after):
                kind, *words = key.split(" ")
                left = [w for w in before.split()]
                want = {"around": [*left[-1:], after], "two": left[-2:], "three": left[-3:]}[kind]
                assert words == want
                assert seen.setdefault(key, (kind, words)) == (kind, words)


def test_contexts_behind_many_blanks():
    near = P.patterns("please call me at 5551234 now", 18, 25)
    far = "please call" + " " * 500 + "me at" + "\n" * 300 + "5551234" + " " * 400 + "now"
    at = far.index("5551234")
    assert near and P.patterns(far, at, at + 7) == near
    assert P.patterns("x" * 1000 + " 5", 1001, 1002) == [] or len(P.patterns("x" * 1000 + " 5", 1001, 1002)[0]) < 200
    assert P.patterns("", 0, 0) == [] and P.patterns("   5", 3, 4) == []
