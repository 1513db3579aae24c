"""Registered queries of the corpus operators: (spark, sf_dir) -> DataFrame.

Every query runs its operator with production parameters over the whole table.
``SQL`` has the DuckDB form where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import language, mix, pii, quality, quotes, rules, shard, simhash, term_queries, urls, winnow
from .scratch import stored


def _crc_of_id(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_language_id(spark, sf):
    """PPM language of every document; rows with crc32(doc_id) mod 4 = 2 are held out."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang")
    model = language.train(docs, allowed=_crc_of_id() % 4 != 2)
    return language.predict(docs, model).select(
        "doc_id", (_crc_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score")


SHARDS = 16


def op2_feistel_sharding(spark, sf):
    """Feistel shuffle of `documents` into 16 shards (law: row counts at most one apart)."""
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64("text").alias("digest"))
    dealt = shard.sharded(rows, SHARDS, ["doc_id", "digest"], seed=2024)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_classifier(spark, sf):
    """Quality of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    stats = stored(quality.statistics(docs), "quality-stats")
    model = quality.train(stats, read_table(spark, sf, "labels", "doc_id", "quality"),
                          allowed=_crc_of_id() % 3 != 1)
    return quality.predict(stats, model).select(
        "doc_id", (_crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted")


#: Target weights of the mix, by level; a name not listed weighs 1.
MIX_WEIGHTS = [{"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 4, "de": 2, "es": 2, "fr": 2}, {}]
MIX_EPOCHS = 2
MIX_SEED = 7


def mix_levels():
    """Domain (of the source's number), language, source."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


def op4_mix_sources(spark, sf):
    """`documents` mixed to target weights over domain, language and source."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return mix.mixed(docs, mix_levels(), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op5_bootstrapped_pii(spark, sf):
    """Personal data of every document: strict forms and what their contexts discover."""
    found = pii.personal_data(read_table(spark, sf, "documents", "doc_id", "text"))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"),
                        pii.listed("spans").alias("spans"))


def op6_winnow_decontamination(spark, sf):
    """Benchmark words found in every document by winnowing."""
    found = winnow.contamination(read_table(spark, sf, "documents", "doc_id", "text"),
                                 read_table(spark, sf, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op7_mcd_quality_rules(spark, sf):
    """Base counts of every document, base rules, then robust outliers per language and source."""
    judged = rules.judged(read_table(spark, sf, "documents", "doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "distance")


def op8_quotation_threads(spark, sf):
    """`conversations` in reply order without quotes."""
    return quotes.linked(read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text"))


def op9_simhash_neardup(spark, sf):
    """SimHash near-duplicates of `documents`: fingerprint and component per row."""
    return simhash.near_duplicates(read_table(spark, sf, "documents", "doc_id", "text"))


#: Host, path and whether the rule allows.
URL_RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False),
             ("com", "/fr/", True), ("com", "/de/", False)]


def op10_link_graph_url_filter(spark, sf):
    """Verdict on every url of `pages`: rules, else trust and distrust of its host."""
    return urls.judged(read_table(spark, sf, "pages", "page_id", "url", "html"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_feistel_sharding": op2_feistel_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mix_sources": op4_mix_sources,
    "op5_bootstrapped_pii": op5_bootstrapped_pii,
    "op6_winnow_decontamination": op6_winnow_decontamination,
    "op7_mcd_quality_rules": op7_mcd_quality_rules,
    "op10_link_graph_url_filter": op10_link_graph_url_filter,
    "op8_quotation_threads": op8_quotation_threads,
    "op9_simhash_neardup": op9_simhash_neardup,
    **term_queries.QUERIES,
}

_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

def _share_sql(level: str, parents: list[str], name: str, weights: dict, given: str) -> str:
    """CTEs that share the parents' budget among the children of one level."""
    own = ", ".join([*parents, name])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    weight = f"CASE {name} " + "".join(f"WHEN '{k}' THEN {v} " for k, v in weights.items()) + "ELSE 1 END" \
        if weights else "1"
    budget = f"JOIN {given} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {given}"
    return f"""
{level}a AS (SELECT * FROM (SELECT {own}, CAST(sum(cap) AS HUGEINT) AS cap,
             CAST({weight} AS HUGEINT) AS weight FROM leaves GROUP BY ALL) {budget}),
{level}b AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, {name}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(weight) OVER ({part} ORDER BY cap / weight, {name}
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {level}a),
{level}c AS (SELECT *, (budget - used) * weight >= cap * open AS filled FROM {level}b),
{level}d AS (SELECT * EXCLUDE (open), budget - coalesce(sum(cap) FILTER (filled) OVER ({part}), 0) AS rest,
             coalesce(sum(weight) FILTER (NOT filled) OVER ({part}), 0) AS open FROM {level}c),
{level}e AS (SELECT *, CASE WHEN filled THEN cap ELSE (rest * weight) // greatest(open, 1) END AS part
             FROM {level}d),
{level}f AS (SELECT *, rest - coalesce(sum(part) FILTER (NOT filled) OVER ({part}), 0) AS odd,
             row_number() OVER (PARTITION BY {', '.join([*parents, 'filled'])} ORDER BY {name}) AS turn
             FROM {level}e),
{level} AS (SELECT {own}, part + CASE WHEN NOT filled AND turn <= odd THEN 1 ELSE 0 END AS budget
            FROM {level}f)"""


_MIX_SQL = f"""
WITH raw AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS tokens,
    coalesce('d' || CAST(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 4 AS VARCHAR),
             '(none)') AS domain,
    coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin FROM documents),
leaves AS (SELECT domain, language, origin, CAST(sum(tokens) AS HUGEINT) AS tokens,
           CAST(sum(tokens) * {MIX_EPOCHS} AS HUGEINT) AS cap FROM raw GROUP BY ALL),
top AS (SELECT CAST(least(sum(tokens), sum(cap)) AS HUGEINT) AS budget FROM leaves),
{_share_sql('lv1', [], 'domain', MIX_WEIGHTS[0], 'top')},
{_share_sql('lv2', ['domain'], 'language', MIX_WEIGHTS[1], 'lv1')},
{_share_sql('lv3', ['domain', 'language'], 'origin', MIX_WEIGHTS[2], 'lv2')},
plan AS (SELECT leaves.*, CAST(budget // tokens AS INT) AS epochs, budget % tokens AS rest
         FROM leaves JOIN lv3 USING (domain, language, origin) WHERE tokens > 0),
keyed AS (SELECT raw.*, epochs, rest, md5('{MIX_SEED}:' || epochs || ':' ||
          coalesce(CAST(doc_id AS VARCHAR), '(none)')) AS k
          FROM raw JOIN plan USING (domain, language, origin)),
streams AS (SELECT *, sum(tokens) OVER g AS size, sum(tokens) OVER (PARTITION BY domain, language, origin
            ORDER BY k) - sum(tokens) OVER g AS start FROM keyed
            WINDOW g AS (PARTITION BY domain, language, origin, k)),
ends AS (SELECT domain, language, origin, min(k) AS last, min(rest - start) AS inside, min(size) AS size
         FROM streams WHERE size > 0 AND start < rest AND start + size >= rest GROUP BY ALL),
whole AS (SELECT doc_id, domain, language, origin, CAST(unnest(range(epochs)) AS INT) AS epoch, tokens,
          tokens AS taken FROM keyed),
partial AS (SELECT doc_id, domain, language, origin, epochs AS epoch, tokens,
            CASE WHEN k = last THEN inside * tokens // ends.size ELSE tokens END AS taken
            FROM keyed JOIN ends USING (domain, language, origin) WHERE k <= last)
SELECT doc_id, domain, language, origin, epoch, tokens, CAST(taken AS BIGINT) AS taken FROM whole
UNION ALL SELECT doc_id, domain, language, origin, epoch, tokens, CAST(taken AS BIGINT) FROM partial"""

_QUOTES_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text,
    string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls
    FROM conversations),
l AS (SELECT r, conv_id, turn, i,
    length(regexp_replace(regexp_extract(ls[i], '^((?:[ \t]*>)+)', 1), '[ \t]', '', 'g')) AS level,
    regexp_replace(ls[i], '^((?:[ \t]*>)+)[ \t]?', '') AS line
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
f AS (SELECT *, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS said,
    CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY r ORDER BY i)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM f),
u AS (SELECT conv_id, turn, level, said FROM s WHERE said <> ''
    UNION SELECT any_value(conv_id), any_value(turn), any_value(level), string_agg(said, ' ' ORDER BY i)
    FROM s WHERE said <> '' GROUP BY r, run),
src AS (SELECT conv_id, said, min(turn) AS source FROM u WHERE level = 0 GROUP BY ALL),
hit AS (SELECT u.conv_id, u.turn, u.level, source, sum(len(string_split(said, ' '))) AS words
    FROM u JOIN src USING (conv_id, said) WHERE u.level > 0 AND source < u.turn GROUP BY ALL),
par AS (SELECT conv_id, turn, source AS parent FROM hit
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, words DESC, source DESC) = 1),
up AS (SELECT conv_id, turn, parent AS root, 1 AS depth FROM par
    UNION ALL SELECT up.conv_id, up.turn, par.parent, up.depth + 1
    FROM up JOIN par ON par.conv_id = up.conv_id AND par.turn = up.root),
thread AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM up GROUP BY ALL),
q AS (SELECT r, count(*) FILTER (level > 0) AS n_quoted,
    string_agg(line, chr(10) ORDER BY i) FILTER (level = 0) AS own FROM l GROUP BY r),
o AS (SELECT m.*, par.parent, coalesce(thread.root, m.turn) AS root, coalesce(thread.depth, 0) AS depth, n_quoted, own
    FROM m JOIN q USING (r) LEFT JOIN par ON par.conv_id = m.conv_id AND par.turn = m.turn
    LEFT JOIN thread ON thread.conv_id = m.conv_id AND thread.turn = m.turn)
SELECT conv_id, turn, role, parent AS parent_turn, root AS root_turn, CAST(depth AS BIGINT) AS depth,
    row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, depth, turn NULLS FIRST) - 1 AS position,
    CAST(n_quoted AS BIGINT) AS n_quoted,
    CASE WHEN n_quoted = 0 THEN text ELSE regexp_replace(coalesce(own, ''), '^\s*\n|\s+$', '', 'g') END AS text
FROM o"""

SQL: dict[str, str] = {
    "op8_quotation_threads": _QUOTES_SQL,
    "op4_mix_sources": _MIX_SQL,
    "op6_winnow_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark),
spans AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
                 unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
                         FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS s
          FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM spans),
places AS (SELECT r, n, unnest([{{'i': i, 's': array_to_string(w[i:i + n - 1], ' ')}}
                                FOR i IN range(1, len(w) - n + 2)]) AS p
           FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT r, item_id, n, p.i AS lo FROM places JOIN spans USING (n) WHERE p.s = spans.s),
words AS (SELECT r, count(DISTINCT k) AS n_hit
          FROM (SELECT DISTINCT r, unnest(range(lo, lo + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL)
          GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    **term_queries.SQL,
}
