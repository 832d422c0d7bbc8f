"""Registered queries of the training-data operators: each applies one operator
to its whole table. name -> (callable(spark, sf_dir), oracle SQL or None)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from chartlore.llm import (edit_leaks, fill_middle, license_scan, order_minhash, phrase_mining, prefix_bpe, quality_forest, secret_scan,
                           sharding, site_quality, toxicity, url_filter, window_dedup)
from chartlore.llm.common import table, word_model


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_report(table(spark, sf_dir, "documents"))


# Positions follow from the text between matches, entropy from list_entropy.
_SPANS = """
  SELECT doc_id, unnest(list_zip(whole, part, gap, range(1, len(whole) + 1))) m, gap, whole, {rank} AS rk, '{kind}' AS kind
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) whole, regexp_extract_all(t, '{pattern}', {group}) part,
               string_split_regex(t, '{pattern}') gap FROM d)"""
_ASSIGN_SQL = ("(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
               "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
raw AS ({" UNION ALL ".join(_SPANS.format(rank=r, kind=k, pattern=p, group=g) for r, k, p, g in (
    (0, "assign", _ASSIGN_SQL, 1), (1, "access", "AKIA[A-Z0-9]+", 0), (2, "hex", "[0-9a-f]+", 0),
    (3, "cand", secret_scan.CANDIDATE, 0)))}),
placed AS (
  SELECT doc_id, kind, rk, m[1] whole, m[2] part,
         coalesce(list_sum(list_transform(gap[:m[4]], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(whole[:m[4] - 1], lambda x: length(x))), 0) AS s
  FROM raw WHERE (kind = 'assign' AND length(m[2]) >= 8) OR (kind = 'access' AND length(m[1]) >= 16)
              OR (kind = 'hex' AND length(m[1]) >= 32) OR kind = 'cand'),
spans AS (SELECT doc_id, kind, rk, whole, cast(s AS BIGINT) s, cast(s + length(whole) AS BIGINT) e FROM placed),
whole AS (
  SELECT *, row_number() OVER () AS id FROM spans
  WHERE kind = 'cand' {" ".join(f"AND NOT regexp_matches(whole, '{a}')" for a in secret_scan.ALLOW)}),
known AS (
  SELECT c.id, b.s, b.e, b.rk FROM whole c JOIN spans b ON b.kind <> 'cand' AND b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e),
edge AS (
  SELECT id, s AS until, max(e) OVER (PARTITION BY id ORDER BY s, rk, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM known
  UNION ALL SELECT c.id, c.e, max(k.e) FROM whole c LEFT JOIN known k ON k.id = c.id GROUP BY ALL),
part AS (
  SELECT doc_id, greatest(s, coalesce(since, s)) AS s, substr(whole, greatest(s, coalesce(since, s)) - s + 1, until - greatest(s, coalesce(since, s))) AS whole
  FROM edge JOIN whole USING (id) WHERE until - greatest(s, coalesce(since, s)) >= {secret_scan.WINDOW}),
cand AS (
  SELECT *, CASE
      WHEN regexp_matches(whole, '^[0-9a-fA-F]+$') AND regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[a-fA-F]')
        THEN 2.93
      WHEN regexp_matches(whole, '^[a-z0-9]+$') AND regexp_matches(whole, '([0-9].*){{3}}')
        AND regexp_matches(whole, '([a-z].*){{3}}') THEN 3.47
      WHEN regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[a-z]') AND regexp_matches(whole, '[A-Z]') THEN 3.77
      WHEN regexp_matches(whole, '^[A-Z0-9]+$') AND regexp_matches(whole, '([0-9].*){{3}}')
        AND regexp_matches(whole, '([A-Z].*){{3}}') THEN 3.47
      WHEN regexp_matches(whole, '[0-9]') THEN 3.77 ELSE 4.0 END AS bits
  FROM part),
win AS (
  SELECT doc_id, s + i AS s FROM (SELECT *, unnest(range(0, length(whole) - {secret_scan.WINDOW} + 1)) i FROM cand)
  WHERE list_entropy(string_split(substr(whole, i + 1, {secret_scan.WINDOW}), '')) >= bits),
isl AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {secret_scan.WINDOW} THEN 0 ELSE 1 END AS fresh FROM win),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS no FROM isl),
found AS (
  SELECT doc_id, 'entropy' AS kind, 3 AS rk, min(s) s, max(s) + {secret_scan.WINDOW} e FROM run GROUP BY doc_id, no
  UNION ALL SELECT doc_id, kind, rk, s, e FROM spans WHERE kind <> 'cand'),
per AS (
  SELECT doc_id, count(*) FILTER (rk = 0) n_assign, count(*) FILTER (rk = 1) n_access, count(*) FILTER (rk = 2) n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rk) FILTER (rk < 3) base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rk, e) spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM documents LEFT JOIN per USING (doc_id)
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, coalesce(strlen(text), 0) n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 12))::UBIGINT), 48, '0')
         || lpad(bin(('0x' || substr(md5(coalesce(text, '')), 1, 12))::UBIGINT), 48, '0') bits
  FROM documents),
steps AS (SELECT *, unnest(range(0, {sharding.ALL_BITS} + 1)) AS depth FROM d),
fits AS (
  SELECT depth, substr(bits, 1, depth) AS shard FROM steps GROUP BY ALL
  HAVING sum(n_bytes) <= {sharding.LIMIT} OR count(*) = 1 OR depth = {sharding.ALL_BITS}),
leaf AS (SELECT s.row_no, s.doc_id, s.bits, s.n_bytes, min(s.depth) shard_depth
  FROM steps s JOIN fits f ON s.depth = f.depth AND substr(s.bits, 1, s.depth) = f.shard GROUP BY ALL)
SELECT doc_id, substr(bits, 1, shard_depth) shard, cast(shard_depth AS INTEGER) shard_depth, cast(n_bytes AS BIGINT) n_bytes FROM leaf
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.repeats_report(table(spark, sf_dir, "documents"))


def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.bpe_report(table(spark, sf_dir, "documents"), word_model())


def op10_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_leaks.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.phrase_report(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece
  FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w FROM pieces),
sizes AS (SELECT unnest(range(1, {phrase_mining.LONGEST} + 1)) m),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) i FROM runs, sizes WHERE len(w) >= m)),
counts AS (SELECT lang, m, phrase, count(*) f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::HUGEINT n FROM counts WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= {phrase_mining.LEAST}),
cand AS (
  SELECT * FROM often c
  WHERE m >= 2 AND NOT EXISTS (SELECT 1 FROM often b WHERE b.lang = c.lang AND b.m > c.m AND b.f >= c.f
                               AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cut AS (SELECT *, string_split(phrase, ' ') w, unnest(range(1, m)) k FROM cand),
scored AS (
  SELECT cut.lang, cut.phrase, cut.f a, x.f l, y.f r, n::BIGINT n, k, ((1000::HUGEINT * cut.f * n) // (x.f::HUGEINT * y.f))::BIGINT score
  FROM cut JOIN total USING (lang)
  JOIN often x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[:k], ' ')
  JOIN often y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {phrase_mining.TOP}
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.middle_report(table(spark, sf_dir, "documents"))


_HASHES = ", ".join(f"('0x' || substr(sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')), {8 * i + 1}, 8))::UBIGINT h{i + 1}" for i in range(4))
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, length(coalesce(text, ''))::UBIGINT n, {_HASHES} FROM documents),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END form
  FROM d),
o AS (SELECT *, substr(t, 1, a::BIGINT) p, substr(t, (a + 1)::BIGINT, (b - a)::BIGINT) mid, substr(t, (b + 1)::BIGINT) s FROM c)
SELECT doc_id, n::BIGINT n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || mid WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || mid ELSE t END)
         output_sha256, sha256(t) restored_sha256
FROM o
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_secret_scan": (op1_secret_scan, OP1_SQL),
    "op2_sharding": (op2_sharding, OP2_SQL),
    "op3_toxicity": (op3_toxicity, None),
    "op4_site_quality": (op4_site_quality, None),
    "op5_order_minhash": (op5_order_minhash, None),
    "op6_url_filter": (op6_url_filter, None),
    "op7_window_dedup": (op7_window_dedup, None),
    "op8_quality_forest": (op8_quality_forest, None),
    "op9_bpe": (op9_bpe, None),
    "op10_edit_leaks": (op10_edit_leaks, None),
    "op11_phrase_mining": (op11_phrase_mining, OP11_SQL),
    "op12_fill_middle": (op12_fill_middle, OP12_SQL),
    "op13_license_scan": (op13_license_scan, None),
}
