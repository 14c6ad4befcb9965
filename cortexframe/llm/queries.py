"""Registered queries of the subpackage, one for each operator, and their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, language_masks, line_windows, llr_rules, nbsvm, near_dups, packing, prefix_doubling, substring_dedup,
    target_resampling, url_graph, variants, warc_zip,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def trusted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def tokenizer_path() -> str:
    """The vocabulary file, named by the installed package or by ``CORTEXFRAME_TOKENIZER``."""
    named = os.environ.get("CORTEXFRAME_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The rules of the query (fixed values of its contract).
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


@query
def op1_link_graph(spark, sf_dir):
    return url_graph.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("trust", "distrust")


ORACLES["op1_link_graph"] = url_graph.oracle(URL_RULES)


@query
def op2_suffix_automaton(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_nbsvm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_warc_zip(spark, sf_dir):
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


ORACLES["op4_warc_zip"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


@query
def op5_line_windows(spark, sf_dir):
    out = line_windows.remove_repeated(table(spark, sf_dir, "documents"))
    return out.select(
        "_doc.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
        F.col("_left").alias("text"),
    )


@query
def op6_superminhash(spark, sf_dir):
    return near_dups.groups(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("row_key")


@query
def op7_best_fit(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_fm_index(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


ORACLES["op8_fm_index"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM s
), f AS (
  SELECT doc_id, i FROM g JOIN (SELECT h, min(doc_id) AS first FROM g GROUP BY h) USING (h) WHERE first < doc_id
), c AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS p FROM f GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN p IS NULL THEN w ELSE
    [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(p, k)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""


@query
def op9_prefix_doubling(spark, sf_dir):
    return prefix_doubling.digest(table(spark, sf_dir, "documents"))


@query
def op10_llr_rules(spark, sf_dir):
    judged = llr_rules.judge(table(spark, sf_dir, "documents"), trusted_docs(spark, sf_dir))
    return judged.drop("score")


@query
def op11_aho_corasick(spark, sf_dir):
    drawn = target_resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.drop("n_words")


@query
def op12_language_masks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_masks.predict(docs, language_masks.train(docs))


@query
def op13_pivotal_grams(spark, sf_dir):
    return variants.group(table(spark, sf_dir, "documents"))


#: CRC-32 in SQL: ``crc_table`` holds what one byte does to the register, ``_crc32`` runs the bytes of a string through it.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
)"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a non-empty string; needs ``t`` of ``crc_table`` in scope."""
    each = f"CAST('0x' || substr(hex({text}), 2 * k - 1, 2) AS BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({text}) + 1), lambda k: {each})),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"""


ORACLES["op11_aho_corasick"] = rf"""
WITH {CRC_TABLE}, texts AS (
  SELECT true AS own, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT false, -row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT own, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), found AS (
  SELECT own, r, unnest(w) AS f FROM words
  UNION ALL SELECT own, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), feature AS (
  SELECT own, r, f, count(*) AS n FROM found GROUP BY ALL
), bucket AS (
  SELECT f, {_crc32("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM feature) CROSS JOIN crc_table
), counts AS (
  SELECT b, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t
  FROM feature JOIN bucket USING (f) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM counts) + 10000)
    / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS g FROM counts
), mean AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS total
  FROM feature JOIN bucket USING (f) JOIN gain USING (b) WHERE own GROUP BY r
), scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS luck
  FROM words LEFT JOIN mean USING (r) WHERE own
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY weight + luck DESC, doc_id) AS k FROM scored
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + luck AS BIGINT) AS score,
  CASE WHEN able AND k <= (SELECT 25 * count(*) // 100 FROM scored WHERE able) THEN k END AS rank
FROM ranked
"""


ORACLES["op13_pivotal_grams"] = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), hashed AS (
  SELECT doc_id, w, {_crc32("(doc_id || ':' || w)")} AS h
  FROM (SELECT DISTINCT doc_id, w FROM runs WHERE length(w) >= 7) CROSS JOIN crc_table
), noisy AS (
  SELECT CASE WHEN h % 31 = 0 THEN w[:CAST(h % length(w) AS INT)] || w[CAST(h % length(w) AS INT) + 2:] ELSE w END AS word
  FROM runs JOIN hashed USING (doc_id, w)
), v AS (
  SELECT word, count(*) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word AS a, b.word AS b, b.n AS bn FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM v a JOIN cut b ON a.word = b.rest
), best AS (
  SELECT a AS word, count(*) AS n_near, min((-bn, encode(b))) AS m, arg_min(b, (-bn, encode(b))) AS b FROM near GROUP BY a
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m[1] >= 10 * v.n THEN best.b END AS form,
    CASE WHEN -m[1] >= 10 * v.n THEN -m[1] END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""


ORACLES["op2_suffix_automaton"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM d CROSS JOIN (SELECT DISTINCT n FROM grams) WHERE len(w) >= n
), hits AS (
  SELECT s.doc_id, s.i, s.n, g.item_id FROM starts s JOIN grams g
    ON g.n = s.n AND g.g = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    sha256(array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',')) AS h FROM hits GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES["op5_line_windows"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT doc_id, i, x, lead(i) OVER o AS i2, lead(x) OVER o AS x2, lead(i, 2) OVER o AS i3, lead(x, 2) OVER o AS x3
  FROM l WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY x, x2, x3 ORDER BY doc_id, i) AS k FROM f WHERE i3 IS NOT NULL
), cut AS (
  SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM r WHERE k > 1
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
    coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '') AS text
  FROM l LEFT JOIN cut c USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  kept.text AS text
FROM documents LEFT JOIN kept USING (doc_id)
"""
