"""License scan: ordered signature rules with a keyword prefilter.

A text becomes its words (lower-case runs of ASCII letters, digits and non-ASCII
characters), each with a space on both sides, so a rule's regular expression over
words cannot start or end inside one.  The words that are keywords of rules are
found in one pass; only rules whose keyword is present are tried.

Detections are intervals of words.  One that lies inside another is suppressed
(of equal intervals the one of higher priority stays, then of the lower rule
number); of the rest, one that overlaps a detection of higher priority is
suppressed too.  Suppression is two running extremes over the detections of a
document in start order, so its work grows with their number, not its square.

Scanning is one projection without an exchange; afterwards only detections are
shuffled.  All of it is DataFrame functions.

Null and empty texts have no words, no labels and score 0.  Repeated rows are
judged each for itself (rows are told apart by a number of their own, so null and
repeated ids do no harm); very long texts are scanned whole; no rows give no
rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_rules import KINDS, Rule, rules
from .scratch import stored

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def spaced_words(text: Column) -> Column:
    """The words of a text, each with a space before and after; empty without words."""
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    joined = F.trim(F.regexp_replace(lower, _NO_WORD, "  "))
    return _let(joined, lambda w: F.when(w == "", F.lit("")).otherwise(F.concat(F.lit(" "), w, F.lit(" "))))


def _n_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _places(spaced: Column, regex: Column) -> Column:
    """Per match: words between the match before and this one, words of this one."""
    pair = lambda gap, hit: F.struct(_n_words(gap).alias("gap"), _n_words(hit).alias("words"))
    return _let(F.regexp_extract_all(spaced, regex, F.lit(0)), lambda hits: F.when(
        F.size(hits) > 0, F.zip_with(F.slice(F.split(spaced, regex, -1), 1, F.size(hits)), hits, pair)))


def scan(docs: DataFrame, signatures: Sequence[Rule] | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per document, written: ``row, doc_id, n_words, hits`` with the places
    of every rule that matches."""
    signatures = rules() if signatures is None else signatures
    # One literal each: hundreds of separate ones take seconds to build.
    table = F.from_json(F.lit(json.dumps([{"rule": r.number, "keyword": r.keyword, "regex": r.regex}
                                          for r in signatures])),
                        "array<struct<rule int, keyword string, regex string>>")
    keywords = F.from_json(F.lit(json.dumps(sorted({r.keyword for r in signatures}))), "array<string>")

    def tried(spaced: Column, present: Column) -> Column:
        chosen = F.filter(table, lambda r: F.array_contains(present, r["keyword"]))
        return F.filter(F.transform(chosen, lambda r: F.struct(
            r["rule"].alias("rule"), _places(spaced, r["regex"]).alias("places"))),
            lambda h: h["places"].isNotNull())

    found = _let(spaced_words(F.col(text_col).cast("string")), lambda spaced: F.struct(
        _n_words(spaced).alias("n_words"),
        _let(F.array_intersect(F.split(F.trim(spaced), "  "), keywords),
             lambda present: tried(spaced, present)).alias("hits")))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("found"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                              "found.n_words", "found.hits"), "license-scan")


def detections(scanned: DataFrame, signatures: Sequence[Rule] | None = None) -> DataFrame:
    """One row per match of a rule: ``row, rule, label, priority, confidence, base,
    start, end`` (words from 0, end exclusive) and ``kept``."""
    signatures = rules() if signatures is None else signatures
    # The rules are a fixed list, so this table has a fixed size.
    about = scanned.sparkSession.createDataFrame(
        [(r.number, r.label, r.priority, r.confidence, r.base) for r in signatures],
        "rule int, label string, priority int, confidence double, base boolean")
    each = scanned.select("row", F.explode("hits").alias("hit")).select(
        "row", "hit.rule", F.posexplode("hit.places").alias("place", "size"))
    upto = F.sum(F.col("size.gap") + F.col("size.words")).over(
        Window.partitionBy("row", "rule").orderBy("place"))
    spans = each.select("row", "rule", upto.alias("end"), (upto - F.col("size.words")).alias("start"))
    spans = spans.join(F.broadcast(about), "rule")

    order = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "priority", "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    outer = spans.withColumn("inside", F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False)))
    # What is left starts and ends in the same order: overlaps show in two extremes.
    levels = sorted({p for p, _ in KINDS.values()} | {r.priority for r in signatures})
    beaten = F.lit(False)
    for level in levels:
        free = (F.col("priority") == level) & ~F.col("inside")
        last, first = F.max(F.when(free, F.col("end"))).over(before), F.min(F.when(free, F.col("start"))).over(after)
        hit = F.coalesce(last > F.col("start"), F.lit(False)) | F.coalesce(first < F.col("end"), F.lit(False))
        beaten = beaten | (hit & (F.col("priority") > level))
    return outer.withColumn("kept", ~F.col("inside") & ~beaten).drop("inside")


def licenses(docs: DataFrame, signatures: Sequence[Rule] | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word``
    are the smallest and largest word they start at (null without any); labels are
    distinct and sorted.  ``spans`` are the kept detections in order; ``score`` is
    the confidence of the surest kept detection or base phrase, else 0.
    """
    scanned = scan(docs, signatures, id_col, text_col)
    found = detections(scanned, signatures)
    base, counted = F.col("base"), F.col("base") | F.col("kept")
    summary = found.groupBy(F.col("row").alias("found_row")).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(counted, F.col("label")))).alias("labels"),
        F.max(F.when(counted, F.col("confidence"))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("start", "end", "rule", "label")))).alias("spans"))
    none = F.array().cast("array<string>")
    return scanned.drop("hits").join(summary, F.col("row") == F.col("found_row"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast(summary.schema["spans"].dataType)).alias("spans"))
