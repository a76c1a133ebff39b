"""Queries of this subpackage over the supplied tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepiece_codec
from .bpe_codec import digests, encode_decode
from .collocations import collocations
from .common import table
from .decontamination import decontaminate
from .line_dedup import CLAUSES, dedup_report
from .lm_words import lm_word_scores
from .pii import personal_data, summary
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .sharding import shard_table
from .simhash import near_duplicates
from .spelling import spelling_variants
from .token_counts import token_counts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_report(table(spark, sf_dir, "documents"), CLAUSES)
    return found.select("doc_id", "n_removed", "n_chars_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(personal_data(table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_word_scores(table(spark, sf_dir, "documents"))


def op11_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_bpe_codec, op3_token_counts, op4_quality_classifier, op5_simhash, op6_decontamination, op7_lm_scoring, op8_sharding, op9_pii, op10_line_dedup, op11_sentencepiece_codec, op12_collocations, op13_spelling_variants)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k1, count(*) FILTER (10 * n_symbols > 3 * word_chars) AS k2,
             count(*) FILTER (2 * n_dup_lines > n_lines) AS k3 FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT (sum(k1) + 1) / (sum(n) + 2) AS m1, (sum(k2) + 1) / (sum(n) + 2) AS m2, (sum(k3) + 1) / (sum(n) + 2) AS m3,
             greatest(var_pop(k1 / n), 1e-9) AS v1, greatest(var_pop(k2 / n), 1e-9) AS v2, greatest(var_pop(k3 / n), 1e-9) AS v3 FROM h),
p AS (SELECT m1, m2, m3, least(greatest(m1 * (1 - m1) / v1 - 1, 2), 1000) AS w1, least(greatest(m2 * (1 - m2) / v2 - 1, 2), 1000) AS w2,
             least(greatest(m3 * (1 - m3) / v3 - 1, 2), 1000) AS w3 FROM m),
v AS (SELECT source, greatest((k1 + m1 * w1) / (n + w1), (k2 + m2 * w2) / (n + w2), (k3 + m3 * w3) / (n + w3)) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate, 0) <= 0.5 AS kept, round(host_rate, 9) AS host_rate, coalesce(host_rate > 0.5, false) AS host_rejected
FROM f LEFT JOIN v USING (source)
"""

ORACLE_SQL["op6_decontamination"] = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id,
       list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
cand AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, cand.n, item_id FROM cand JOIN win ON cand.n = win.n AND cand.g = win.g),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

ORACLE_SQL["op10_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '(?:[^.,;:!?…、。！，：；？\n]|[.,;:!?…、。！，：；？]*[.,;:!?…][^\x20\x09\x0B-\x0D.,;:!?…、。！，：；？\n])+(?:[.,;:!?…、。！，：；？]*\n+|[.,;:!?…、。！，：；？]+|\z)|[.,;:!?…、。！，：；？]*\n+|[.,;:!?…、。！，：；？]+') AS l FROM documents),
k AS (SELECT r, doc_id, l, list_transform(l, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS k FROM d),
w AS (SELECT r, doc_id, i, k[i:i+2] AS g FROM (SELECT *, unnest(range(1, len(l) - 1)) AS i FROM k WHERE len(l) >= 3)),
o AS (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, r, i) AS k FROM w),
cut AS (SELECT r, list(p) AS cut FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) AS p FROM o WHERE k > 1) GROUP BY r),
f AS (SELECT doc_id, t, coalesce(len(cut), 0) AS n,
             CASE WHEN cut IS NULL THEN t ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(cut, i)), lambda i: l[i]), '') END AS k
      FROM d LEFT JOIN cut USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_removed, CAST(length(t) - length(k) AS BIGINT) AS n_chars_removed, sha256(k) AS text_sha256 FROM f
"""

ORACLE_SQL["op12_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS q, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
w AS (SELECT q, lang, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM q),
s AS (SELECT lang, w, lead(w, 1) OVER p AS x, lead(w, 2) OVER p AS y, lead(w, 3) OVER p AS z, lead(w, 4) OVER p AS u FROM w WINDOW p AS (PARTITION BY q ORDER BY i)),
g AS (SELECT lang, 1 AS m, w AS phrase FROM s UNION ALL SELECT lang, 2, w || ' ' || x FROM s WHERE x IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || x || ' ' || y FROM s WHERE y IS NOT NULL
      UNION ALL SELECT lang, 4, w || ' ' || x || ' ' || y || ' ' || z FROM s WHERE z IS NOT NULL UNION ALL SELECT lang, 5, w || ' ' || x || ' ' || y || ' ' || z || ' ' || u FROM s WHERE u IS NOT NULL),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS MATERIALIZED (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM f WHERE f >= 100),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE m > 1),
cut AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, total.n, (1000::HUGEINT * c.a * total.n) // (l.f::HUGEINT * r.f) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN total ON total.lang = c.lang
        JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k+1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a AS f, array_to_string(w[i:i+s-1], ' ') AS phrase FROM cand, range(2, 5) t(s), range(1, 5) u(i) WHERE s < m AND i + s - 1 <= m)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM low WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = low.lang AND sub.phrase = low.phrase AND sub.f >= low.a) QUALIFY rank <= 2000
"""

ORACLE_SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda c: list_reduce(range(0, 8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, c)) AS t),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM o GROUP BY id, run),
b AS (SELECT run, k, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i+1] AS BIGINT)) AS bytes FROM c),
h AS (SELECT run, k, xor(list_reduce(bytes, lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, steps),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
del AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM words)),
pair AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM del a JOIN del b ON a.s = b.s AND a.p = b.p WHERE a.word <> b.word
         UNION SELECT a.word, a.n, b.word, b.n FROM del a JOIN words b ON a.s = b.word
         UNION SELECT b.word, b.n, a.word, a.n FROM del a JOIN words b ON a.s = b.word),
v AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pair GROUP BY word),
f AS MATERIALIZED (SELECT word, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
last AS (SELECT word, root FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.word = r.root AND f.form IS NOT NULL))
SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, word) AS root FROM words LEFT JOIN f USING (word) LEFT JOIN last USING (word)
"""
