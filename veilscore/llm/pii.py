"""Personal data by bootstrapped contextual extraction.

Strict forms of four kinds - e-mail address, IP address, card number, telephone
number - are the seeds; they are always reported.  The words around seeds are
lexical patterns.  Looser forms (a number without its country code, an address
spelled with "at" and "dot", an IPv6 address, a card number with a typing error)
are candidates and are reported only on the word of their contexts.  Candidates may
overlap: all are scored, and of overlapping ones that are confident enough the most
confident is reported:

* a pattern's score for a kind is its confident instances of that kind over
  those plus the seeds of other kinds it also surrounds (plus one half);
* a candidate's confidence is 1 minus the product of (1 - score) over its
  patterns with a high score and enough support (weak ones do not add up);
* both are computed in turns over the pattern-instance graph in Spark until no
  candidate's confidence moves.

Support counts distinct instances, so copies of a document prove nothing.  One
pass over the texts finds seeds, candidates and contexts; the graph holds hashes
and short patterns only.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import released, stored
from .textbytes import id_and_text

KINDS = ("email", "ip", "card", "phone")
#: Least summed confidence of distinct instances under a pattern that may discover.
MIN_SUPPORT = 3.0
MIN_SCORE = 0.8
#: Turns carry confidence one hop each, so the graph's depth sets their number;
#: beyond this many the query fails rather than report an unfinished state.
MAX_ROUNDS = 1000
#: A confidence moves if it changes by more than rounding.  It never falls, and a late
#: small rise can still lift a pattern over its thresholds, so this is not looser.
TOLERANCE = 1e-9
CONTEXT_CHARS = 160

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that starts inside a run of digits matches only if the whole run does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[ ().-]{0,3}[0-9]){6,18}(?![0-9A-Za-z])")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
# Looks ahead, so that an address is also found inside another's match.
_LOOSE_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?=([A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b) ?"
    r"[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]{2,63}){1,4}))")
_EDGE = " \t\r\n\v\f.,;:!?\"'()[]{}<>=-"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their ``@``: the local part
    cannot hold one, so it is the run of its characters before."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text)
            if all(len(p) <= 3 and int(p) <= 255 for p in
                   (x.lstrip("0") or "0" for x in m.group().split(".")))]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; positions in code points."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        out += [(1, *s) for s in ips(text)] + [(2, *s) for s in cards(text)]
        out += [(3, *s) for s in phones(text)] if "+" in text else []
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose forms that touch no seed, by start; they may overlap each other (an address
    also starts inside another), which only their confidence can decide."""
    found: list[tuple[int, int, int]] = []
    # Only what a form needs itself is asked of the text: its other words decide nothing.
    if "at" in text:
        found += [(0, *m.span(1)) for m in _LOOSE_MAIL.finditer(text)]
    if ":" in text:
        found += [(1, *m.span()) for m in _LOOSE_IP.finditer(text)]
    if any(d in text for d in "0123456789"):
        for m in _LOOSE_NUMBER.finditer(text):
            n = len(_digits(m.group()))
            found.append((2 if n >= 13 else 3, *m.span()))
    spans = sorted((s, e) for _, s, e in taken)
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        while at < len(spans) and spans[at][1] <= s:
            at += 1
        if not (at < len(spans) and spans[at][0] < e):
            out.append((kind, s, e))
    return out


def apart(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The (conf, kind, start, end) that overlap none of higher confidence that is
    itself kept; equal confidence goes to the earlier start, then the longer one."""
    out: list[tuple[int, int, int]] = []
    for _, kind, s, e in sorted(spans, key=lambda x: (-round(x[0], 9), x[2], -x[3], x[1])):
        i = bisect(out, s, key=lambda x: x[1])
        if not (i and out[i - 1][2] > s) and not (i < len(out) and out[i][1] < e):
            out.insert(i, (kind, s, e))
    return out


def _word(token: str) -> str:
    return re.sub("[0-9]+", "0", token.strip(_EDGE).lower())


def _words_before(text: str, at: int, n: int) -> list[str]:
    """The last ``n`` words before a place, in text order: blanks are walked over,
    however many; of the words at most CONTEXT_CHARS characters are read."""
    out: list[str] = []
    left = CONTEXT_CHARS
    while len(out) < n and left:
        while at and text[at - 1].isspace():
            at -= 1
        end = at
        while at and left and not text[at - 1].isspace():
            at, left = at - 1, left - 1
        if at == end:
            break
        out.append(text[at:end])
    return out[::-1]


def _word_after(text: str, at: int) -> str:
    while at < len(text) and text[at].isspace():
        at += 1
    right = text[at:at + CONTEXT_CHARS].split(None, 1)
    return right[0] if right else ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts of a span: one word on either side, two and three before,
    and a label with a colon or equals sign right before.  A key is the kind of
    context and its words; words hold no blanks, so no two contexts share a key."""
    left = _words_before(text, start, 4)
    words = [w for w in (_word(t) for t in left) if w]
    after = _word(_word_after(text, end))
    out = []
    if words and after:
        out.append(f"around {words[-1]} {after}")
    if len(words) >= 2:
        out.append("two " + " ".join(words[-2:]))
    if len(words) >= 3:
        out.append("three " + " ".join(words[-3:]))
    if words and left[-1].rstrip("\"'([").endswith((":", "=")):
        out.append(f"label {words[-1]}")
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
_NODE = pa.struct([("kind", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("seed", pa.bool_()),
                   ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
_SPAN_SQL = "array<struct<kind:int,lo:long,hi:long>>"
_NODE_SQL = "array<struct<kind:int,lo:long,hi:long,seed:boolean,instance:long,patterns:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, nodes = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            own = seeds(text)
            loose = candidates(text, own)
            base.append([{"kind": k, "lo": s, "hi": e} for k, s, e in own])
            nodes.append([
                {"kind": k, "lo": s, "hi": e, "seed": seed, "patterns": patterns(text, s, e),
                 "instance": xxhash.xxh64_intdigest(text[s:e].lower(), k) - (1 << 63)}
                for seed, spans in ((True, own), (False, loose)) for k, s, e in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(nodes, pa.list_(_NODE))],
            ["doc_id", "base", "nodes"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        more = [[{"kind": k, "lo": s, "hi": e} for k, s, e in
                 apart([(x["conf"], x["kind"], x["lo"], x["hi"]) for x in value.as_py()])]
                for value in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(more, pa.list_(_SPAN))], ["row", "more"])


def confident(edges: DataFrame) -> DataFrame:
    """Candidates worth reporting: ``(kind, instance, conf)`` with confidence of at least
    MIN_SCORE, from ``edges(pattern, kind, instance, seed)``."""
    edges = edges.distinct()
    useful = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"),
                                          F.max(~F.col("seed")).alias("open")).filter("n >= 2 and open")
    useful = stored(useful.select("pattern"), "pii-useful")
    edges = stored(edges.join(useful, "pattern"), "pii-edges")
    belief = stored(edges.filter("not seed").select("kind", "instance").distinct()
                    .withColumn("conf", F.lit(0.0)), "pii-belief")
    # Seeds of other kinds speak against a pattern: all seeds less those of the kind.
    all_seeds = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"))
    against = stored(edges.groupBy("pattern", "kind").agg(F.sum(F.col("seed").cast("int")).alias("own"))
                     .join(stored(all_seeds, "pii-seeds"), "pattern")
                     .select("pattern", "kind", "own", (F.col("seeds") - F.col("own")).alias("other")),
                     "pii-against")
    loose = stored(edges.filter("not seed").select("pattern", "kind", "instance"), "pii-loose")
    for _ in range(MAX_ROUNDS):
        trust = loose.join(belief, ["kind", "instance"]).groupBy("pattern", "kind").agg(
            F.sum("conf").alias("conf"))
        good = F.col("own") + F.coalesce("conf", F.lit(0.0))
        score = good / (good + F.col("other") + 0.5)
        scores = stored(against.join(trust, ["pattern", "kind"], "left").select(
            "pattern", "kind", F.when((good >= MIN_SUPPORT) & (score >= MIN_SCORE), score)
            .otherwise(0.0).alias("score")), "pii-scores")
        doubt = F.sum(F.log(F.lit(1.0) - F.col("score")))
        after = stored(loose.join(scores, ["pattern", "kind"]).groupBy("kind", "instance").agg(
            (F.lit(1.0) - F.exp(doubt)).alias("conf")), "pii-belief")
        moved = after.withColumnRenamed("conf", "now").join(belief, ["kind", "instance"]).agg(
            F.max(F.abs(F.col("now") - F.col("conf")))).first()[0]
        released(belief, scores)
        belief = after
        if (moved or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError("confidences did not settle")
    return belief.filter(F.col("conf") >= MIN_SCORE).select("kind", "instance", "conf")


def listed(spans: str) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: arrays of (kind, lo, hi), one row per input row.

    ``base`` are the strict forms, ``spans`` those and the discovered ones; kinds
    number ``KINDS``, positions are code points, ends exclusive.  Null and empty
    texts have none; repeated rows are kept and count once as evidence; an empty
    table gives no rows.
    """
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = stored(source.mapInArrow(_scan, f"doc_id {kind}, base {_SPAN_SQL}, nodes {_NODE_SQL}")
                  .withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    nodes = rows.select("row", F.inline("nodes"))
    edges = nodes.select(F.explode("patterns").alias("pattern"), "kind", "instance", "seed")
    sure = stored(confident(edges), "pii-sure")
    found = (nodes.filter("not seed").join(sure, ["kind", "instance"])
             .groupBy("row").agg(F.collect_list(F.struct("conf", "kind", "lo", "hi")).alias("more"))
             .mapInArrow(_resolved, f"row long, more {_SPAN_SQL}"))
    return rows.join(found, "row", "left").select(
        "doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast(_SPAN_SQL))).alias("spans"))
