"""Registered queries of spelling variants, ranked search and license scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import licenses, search, variants
from .license_rules import rules


#: One in so many runs loses a code point, by the checksum of document and run.
MISSPELT = 31


def _misspelt():
    """The run, or what is left of it when the checksum chooses it."""
    mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (mark % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return F.when(mark % MISSPELT == 0, less).otherwise(F.col("run"))


def op11_spelling_variants(spark, sf):
    """Words of `documents` (some misspelt by a fixed rule), their near words and forms."""
    runs = variants.letter_runs(read_table(spark, sf, "documents", "doc_id", "text"))
    return variants.variants(variants.word_counts(runs, _misspelt()))


def op12_ranked_search(spark, sf):
    """The 20 best documents for every benchmark item."""
    return search.ranked(read_table(spark, sf, "documents", "doc_id", "text"),
                         read_table(spark, sf, "benchmark", "item_id", "text"))


def op13_license_scan(spark, sf):
    """Licenses named in every document, by ordered signature rules."""
    found = licenses.licenses(read_table(spark, sf, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ",\n".join(f"({r.number}, {quoted(r.label)}, {r.priority}, {r.confidence}, {quoted(r.keyword)}, "
                       f"{quoted(r.regex)}, {r.base})" for r in rules())
    levels = sorted({r.priority for r in rules()})
    beaten = " OR ".join(
        f"(priority > {p} AND (coalesce(max(CASE WHEN priority = {p} AND NOT inside THEN e END) OVER b > s, false) "
        f"OR coalesce(min(CASE WHEN priority = {p} AND NOT inside THEN s END) OVER a < e, false)))" for p in levels)
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    return rf"""
WITH rules(rule, label, priority, confidence, keyword, re, base) AS (VALUES
{table}),
t AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS t
  FROM documents),
d AS (SELECT r, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS t FROM t),
m AS (SELECT r, rule, regexp_extract_all(t, re) AS hits, string_split_regex(t, re) AS gaps
  FROM d JOIN rules ON contains(t, ' ' || keyword || ' ')),
p AS (SELECT r, rule, k, {words('gaps[k]')} AS gap, {words('hits[k]')} AS w
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM m)),
x AS (SELECT r, rule, w, sum(gap + w) OVER (PARTITION BY r, rule ORDER BY k) AS e FROM p),
s AS (SELECT r, rule, e, e - w AS s, label, priority, confidence, base FROM x JOIN rules USING (rule)),
i AS (SELECT *, coalesce(max(e) OVER (PARTITION BY r ORDER BY s, e DESC, priority, rule
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= e, false) AS inside FROM s),
k AS (SELECT *, NOT inside AND NOT ({beaten}) AS kept FROM i
  WINDOW b AS (PARTITION BY r ORDER BY s, e DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY r ORDER BY s, e DESC, priority, rule ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base OR kept)), ',') AS labels,
  max(confidence) FILTER (base OR kept) AS score FROM k GROUP BY r)
SELECT doc_id, CAST({words('t')} AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (r)"""


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS w FROM documents),
total AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
m AS (SELECT r, doc_id, 100 - 25 + (25 * CAST(len(w) AS BIGINT) * docs) // terms AS m FROM d, total WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
           FROM tf, total GROUP BY term),
q AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS_SQL}) AS term
      FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20"""

_VARIANTS_SQL = f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
marked AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  [CAST(16 * (strpos('0123456789ABCDEF', h[j]) - 1) + strpos('0123456789ABCDEF', h[j + 1]) - 1 AS BIGINT)
   FOR j IN range(1, length(h), 2)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM coded, tab),
cut AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
  ELSE run END AS word, k FROM marked),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS p FROM gaps),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS p FROM gaps),
near AS (SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.p = b.p AND a.word <> b.word
  UNION ALL SELECT less.word, words.word, words.n FROM less JOIN words ON less.p = words.word
  UNION ALL SELECT words.word, less.word, less.n FROM less JOIN words ON less.p = words.word),
counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, other, n AS form_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
forms AS (SELECT words.word, n, n_near, CASE WHEN form_n >= 10 * n THEN other END AS form,
  CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN counted USING (word) LEFT JOIN best USING (word)),
chain(word, root, step) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL UNION ALL
  SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
FROM forms LEFT JOIN ends USING (word)"""

QUERIES = {
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_license_scan": op13_license_scan,
}

SQL: dict[str, str] = {
    "op11_spelling_variants": _VARIANTS_SQL,
    "op12_ranked_search": _SEARCH_SQL,
    "op13_license_scan": _license_sql(),
}
