"""Registered queries: scalar functions, validation, year-end, matching,
exports, visits and streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlore.functions import credits, dates, text
from chartlore.operators import (
    calendar, history, ingest, matching, quality, reshape, stats, titles, visits, yearend)
from chartlore.plans import fixtures as fx
from chartlore.plans.fixtures import (
    ALBUMS_SQL, ENTRIES_SQL, GAPPED_SQL, KEYED_SQL, REGISTRY_SQL, SOURCE_SQL, VISITS_SQL, YEAREND_SQL,
    sql_lead_artist, sql_norm, sql_primary_artist, sql_primary_credit, sql_title_key, with_sql)
from chartlore.plans.history_queries import _VERSUS_SQL
from chartlore.plans.ingest_queries import NAMES, named_sql
from chartlore.session import scratch
from chartlore.streaming import sinks
from chartlore.streaming import visits as stream_visits
from chartlore.streaming import weeks as stream_weeks

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# --- scalar functions -------------------------------------------------------
# Each runs over every document or line of a table, so real text with accents,
# commas, markers and junk passes through it.

_DOC = "documents"


def docs(spark, sf):
    return fx.table(spark, sf, _DOC).select("doc_id", "text")


@register("primary_credit", f"SELECT doc_id, md5({sql_primary_credit('t')}) AS v FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents) d")
def primary_credit(spark, sf):
    line = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return docs(spark, sf).select("doc_id", F.md5(credits.primary_credit(line)).alias("v"))


# Names whose comma does and does not separate two artists.
_NAMED = """concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ', Jr.' WHEN 1 THEN ' and the 10,000 Bolts' WHEN 2 THEN ', III & Guest'
  WHEN 3 THEN ', The Maker' WHEN 4 THEN ', sr, Other' WHEN 5 THEN ',Iverson' WHEN 6 THEN ' X Ray Featuring A, B'
  WHEN 7 THEN ' (with A)' ELSE '' END)"""


@register("primary_artist", with_sql(ENTRIES_SQL) + f"""
SELECT artist, {sql_primary_artist('artist')} AS v FROM (
  SELECT DISTINCT artist FROM entries UNION SELECT DISTINCT {_NAMED} FROM part) d""")
def primary_artist(spark, sf):
    named = fx.table(spark, sf, "part").select(F.expr(_NAMED).alias("artist"))
    credit = fx.entries(spark, sf).select("artist").union(named).distinct()
    return credit.select("artist", credits.primary_artist(F.col("artist")).alias("v"))


@register("credit_names", with_sql(ENTRIES_SQL, named_sql()) + "SELECT name, artist, count(*) AS n FROM named GROUP BY 1, 2")
def credit_names(spark, sf):
    asked = fx.entries(spark, sf).groupBy("artist").agg(F.count("*").alias("n"))
    named = asked.withColumn("name", F.explode(F.array(*[F.lit(n) for n in NAMES])))
    return named.filter(credits.names_artist_col(F.col("artist"), F.col("name"))).select("name", "artist", "n")


@register("safe_int", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN CAST(trunc(value) AS INT) = 0 THEN NULL
       ELSE CAST(trunc(value) AS INT) END AS v FROM events""")
def safe_int(spark, sf):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN '-' WHEN 1 THEN cast(value AS string) "
                 "WHEN 2 THEN concat(' ', cast(value AS string)) ELSE cast(value AS string) END")
    return fx.table(spark, sf, "events").select("event_id", text.safe_int(raw).alias("v"))


@register("parse_artist_list", """
SELECT o_orderkey, x AS name, CAST(pos AS INT) AS pos FROM (
  SELECT o_orderkey, [o_orderpriority, CASE WHEN lower(o_orderstatus) <> lower(o_orderpriority) THEN o_orderstatus END] AS l
  FROM orders) o, (SELECT unnest([1, 2]) AS pos) p, LATERAL (SELECT l[pos] AS x) q WHERE x IS NOT NULL""")
def parse_artist_list(spark, sf):
    raw = F.concat(F.lit(" "), "o_orderpriority", F.lit(" || "), "o_orderstatus", F.lit("|"), F.lower("o_orderpriority"))
    o = fx.table(spark, sf, "orders").select("o_orderkey", F.posexplode(text.artist_list(raw)).alias("p", "name"))
    return o.select("o_orderkey", "name", (F.col("p") + 1).alias("pos"))


@register("norm", f"SELECT doc_id, md5({sql_norm('text')}) AS v FROM documents")
def norm(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(text.norm(F.col("text"))).alias("v"))


_TITLED = """concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' (EP)' WHEN 1 THEN ' Vol. 2' WHEN 2 THEN ' Volume 2'
  WHEN 3 THEN ' (Original Motion Picture Soundtrack) Pt. 1' WHEN 4 THEN ' Part 1 & More' ELSE ' (Live)' END)"""


@register("title_key", f"SELECT p_partkey, {sql_title_key('t')} AS v FROM (SELECT p_partkey, {_TITLED} AS t FROM part) p")
def title_key(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", text.title_key(F.expr(_TITLED)).alias("v"))


@register("lead_artist", with_sql(ENTRIES_SQL) + f"""
SELECT artist, {sql_lead_artist('artist')} AS v FROM (SELECT DISTINCT artist FROM entries) d""")
def lead_artist(spark, sf):
    return fx.entries(spark, sf).select("artist").distinct().select(
        "artist", text.lead_artist(F.col("artist")).alias("v"))


@register("swap_placeholders", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || ' , SEASON 1' ELSE p_brand END AS title,
       CASE p_partkey % 4 WHEN 0 THEN 'Soundtrack' WHEN 1 THEN 'Various Artists' WHEN 2 THEN 'Soundtrack' ELSE p_name END AS artist
FROM part""")
def swap_placeholders(spark, sf):
    title = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'SOUNDTRACK' WHEN 1 THEN 'VARIOUS ARTISTS' "
                   "WHEN 2 THEN 'SOUNDTRACK, SEASON 1' ELSE p_brand END")
    return text.unswap(fx.table(spark, sf, "part").select("p_partkey", title.alias("title"), F.col("p_name").alias("artist")))


@register("number", """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS v FROM customer""")
def number(spark, sf):
    raw = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE format_number(floor(c_acctbal), 0) END")
    return fx.table(spark, sf, "customer").select("c_custkey", text.number(raw).alias("v"))


@register("clean_title", r"""
SELECT doc_id, md5(CASE WHEN q <> '' THEN trim(q) ELSE trim(regexp_replace(trim(t), '^["“”]+|["“”]+$', '', 'g')) END) AS v
FROM (SELECT doc_id, t, regexp_extract(t, '["“”‘’]\s*(.+?)\s*["“”‘’]', 1) AS q FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '" ' || text || ' " / "B"' ELSE text END AS t FROM documents) d) e""")
def clean_title(spark, sf):
    raw = F.expr("""CASE WHEN doc_id % 2 = 0 THEN concat('" ', text, ' " / "B"') ELSE text END""")
    return docs(spark, sf).select("doc_id", F.md5(text.clean_title(raw)).alias("v"))


@register("normalise_title", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS v FROM documents")
def normalise_title(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(text.normalise_title(F.col("text"))).alias("v"))


@register("bare_title", rf"""
SELECT p_partkey, CASE WHEN b = '' THEN t ELSE b END || ' ' || {sql_primary_artist('p_brand')} AS v FROM (
  SELECT p_partkey, p_brand, t, trim(regexp_replace(t, '\s*\([^)]*\)', '', 'g')) AS b FROM (
    SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN '(' || p_name || ')' ELSE {_TITLED} END AS t FROM part) a) c""")
def bare_title(spark, sf):
    t = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise(F.expr(_TITLED))
    return fx.table(spark, sf, "part").select("p_partkey", text.search_key(t, F.col("p_brand")).alias("v"))


@register("split_title", """
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title,
       CASE WHEN p_partkey % 5 = 1 THEN p_brand || ' - x' WHEN p_partkey % 5 <> 0 THEN p_brand END AS artist,
       p_partkey % 5 = 1 AS ambiguous FROM part""")
def split_title(spark, sf):
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' - ', p_brand, ' - x') "
                 "ELSE concat(p_name, ' - ', p_brand) END")
    return fx.table(spark, sf, "part").select("p_partkey", text.split_pair(raw).alias("s")).select("p_partkey", "s.*")


@register("label_year_date", """
SELECT o_orderkey, try_cast((y + CASE WHEN wk >= 52 AND m = 1 THEN 1 WHEN wk <= 1 AND m = 12 THEN -1 ELSE 0 END + o_orderkey % 3)
                            || '-' || m || '-' || d AS DATE) AS v FROM (
  SELECT o_orderkey, CAST(o_orderkey % 53 + 1 AS INT) AS wk, extract(year FROM o_orderdate) AS y,
         extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d FROM orders) x""")
def label_year_date(spark, sf):
    # Printed years are off by up to two, so that a leap day may not exist.
    d = F.col("o_orderdate")
    return fx.table(spark, sf, "orders").select("o_orderkey", dates.label_year_date(
        F.expr("cast(o_orderkey % 53 + 1 AS int)"), F.year(d) + F.expr("o_orderkey % 3"), F.month(d), F.day(d)).alias("v"))


@register("to_saturday", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST((13 - dayofweek(o_orderdate)) % 7 AS INT) AS v FROM orders""")
def to_saturday(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", dates.to_saturday(F.to_date("o_orderdate")).alias("v"))


@register("artwork_url", with_sql(YEAREND_SQL) + """
SELECT chart, year, rank, CASE WHEN image_url IS NULL OR contains(image_url, 'lazyload-fallback') THEN '' ELSE image_url END AS small,
  CASE WHEN image_url IS NULL OR contains(image_url, 'lazyload-fallback') THEN ''
       ELSE replace(image_url, '-180x180.', '-344x344.') END AS large FROM yearend""")
def artwork_url(spark, sf):
    u = F.col("image_url")
    return fx.yearend(spark, sf).select("chart", "year", "rank", text.artwork_url(u).alias("small"),
                                        text.artwork_url(u, "344x344").alias("large"))


@register("pipe_to_comma", "SELECT doc_id, md5(replace(replace(text, 'e', '|'), '|', ',')) AS v FROM documents")
def pipe_to_comma(spark, sf):
    piped = F.replace(F.col("text"), F.lit("e"), F.lit("|"))
    return docs(spark, sf).select("doc_id", F.md5(text.pipe_to_comma(piped)).alias("v"))


@register("visitor_hash", """
SELECT event_id, substr(sha256('salt:' || CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END
       || ':' || event_type), 1, 16) AS v FROM events""")
def visitor_hash(spark, sf):
    address = F.expr("CASE WHEN event_id % 5 <> 0 THEN cast(user_id AS string) END")
    return fx.table(spark, sf, "events").select(
        "event_id", text.visitor_hash(address, F.col("event_type"), "salt").alias("v"))


@register("stated_year", """
SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS v FROM orders WHERE o_orderkey % 3 <> 0""")
def stated_year(spark, sf):
    page = F.concat(F.lit("Top <b>Countdown  "), F.year("o_orderdate"), F.lit("</b>"))
    page = F.when(F.col("o_orderkey") % 3 == 0, F.lit("no year")).otherwise(page)
    asked = F.year("o_orderdate")
    return fx.table(spark, sf, "orders").select("o_orderkey", text.stated_year(page).alias("v"), asked.alias("asked")).filter(
        "v = asked").drop("asked")


# --- validation -------------------------------------------------------------

_SIG = """CAST(count(*) AS VARCHAR) || '-' || CAST(sum(('0x' || substr(h, 1, 15))::BIGINT) AS VARCHAR) || '-' ||
  CAST(sum(('0x' || substr(h, 16, 15))::BIGINT) AS VARCHAR)"""


@register("ranking_signature", with_sql(ENTRIES_SQL) + f"""
SELECT chart, date, {_SIG} AS signature, CAST(count(*) AS INT) AS n
FROM (SELECT chart, date, md5(concat_ws('|', CAST(rank AS VARCHAR), title, artist)) AS h FROM entries) e GROUP BY chart, date""")
def ranking_signature(spark, sf):
    return quality.ranking_signatures(fx.entries(spark, sf), ["chart", "date"])


_LISTS_SQL = """
glists AS (SELECT chart, date, string_agg(rank || '|' || lower(trim(title)), chr(10) ORDER BY rank) AS l FROM gapped GROUP BY 1, 2),
glag AS (SELECT *, lag(l) OVER w AS pl, lag(date) OVER w AS prev_date FROM glists WINDOW w AS (PARTITION BY chart ORDER BY date)),
clamped AS (SELECT chart, prev_date, date FROM glag WHERE l = pl)"""
_CLAMPED = with_sql(ENTRIES_SQL, GAPPED_SQL, _LISTS_SQL)


def gapped(spark, sf):
    return fx.gapped(fx.entries(spark, sf))


@register("clamped_weeks", _CLAMPED + "SELECT * FROM clamped")
def clamped_weeks(spark, sf):
    return quality.clamped_weeks(gapped(spark, sf))


@register("first_genuine_week", with_sql(ENTRIES_SQL, """
early AS (SELECT * FROM entries UNION ALL
          SELECT e.* REPLACE (e.date - 7 * k AS date) FROM entries e, (SELECT unnest([1, 2, 3]) AS k) t
          WHERE (chart, date) IN (SELECT (chart, min(date)) FROM entries GROUP BY chart))""") + """
SELECT chart, min(date) + 21 AS first_week FROM early GROUP BY chart""")
def first_genuine_week(spark, sf):
    e = fx.entries(spark, sf)
    first = e.groupBy("chart").agg(F.min("date").alias("date"))
    clamp = e.join(first, ["chart", "date"], "left_semi").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    early = clamp.withColumn("date", F.expr("date_sub(date, 7 * k)")).drop("k")
    return quality.first_genuine_week(e.unionByName(early))


@register("list_depth", with_sql(ENTRIES_SQL) + """
SELECT chart, date, CAST(count(*) AS INT) AS rows, count(*) < 5 AS thin FROM entries GROUP BY 1, 2""")
def list_depth(spark, sf):
    return quality.list_depth(fx.entries(spark, sf))


@register("depth_floor", with_sql(ENTRIES_SQL, REGISTRY_SQL, """
d AS (SELECT chart, date, count(*) AS rows FROM entries GROUP BY ALL)""") + """
SELECT chart, CAST(min(rows) AS INT) AS low, CAST(max(rows) AS INT) AS high, CAST(least(min(rows), depth) AS INT) AS floor
FROM d JOIN registry USING (chart) GROUP BY chart, depth""")
def depth_floor(spark, sf):
    return quality.depth_floor(fx.entries(spark, sf), fx.registry(spark, sf))


_COPIES_SQL = """dup AS (SELECT * FROM entries UNION ALL SELECT * FROM entries WHERE metric % 50 = 0)"""


@register("duplicates", with_sql(ENTRIES_SQL, _COPIES_SQL) + """
SELECT chart, date, rank, CAST(count(*) AS INT) AS copies FROM dup GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicates(spark, sf):
    e = fx.entries(spark, sf)
    return quality.duplicates(e.unionByName(e.filter("metric % 50 = 0")))


@register("non_weekly_steps", with_sql(ENTRIES_SQL, GAPPED_SQL) + """
SELECT chart, prev_date, date, date - prev_date AS days FROM (
  SELECT chart, date, lag(date) OVER (PARTITION BY chart ORDER BY date) AS prev_date FROM (
    SELECT DISTINCT chart, date FROM gapped) d) s WHERE date - prev_date <> 7""")
def non_weekly_steps(spark, sf):
    return calendar.non_weekly_steps(gapped(spark, sf))


_KNOWN_SQL = "known AS (SELECT chart, date FROM clamped WHERE extract(year FROM date) < 1999 UNION ALL " \
             "SELECT chart, DATE '1990-01-01' FROM registry)"


def known(spark, sf):
    return quality.clamped_weeks(gapped(spark, sf)).filter(F.year("date") < 1999).select("chart", "date").unionByName(
        fx.registry(spark, sf).select("chart", F.lit("1990-01-01").cast("date").alias("date")))


@register("baseline_ratchet", with_sql(ENTRIES_SQL, GAPPED_SQL, _LISTS_SQL, REGISTRY_SQL, _KNOWN_SQL) + """
SELECT chart, date, 'new' AS status FROM clamped WHERE (chart, date) NOT IN (SELECT (chart, date) FROM known)
UNION ALL SELECT chart, date, 'stale' FROM known WHERE (chart, date) NOT IN (SELECT (chart, date) FROM clamped)""")
def baseline_ratchet(spark, sf):
    return quality.baseline_ratchet(quality.clamped_weeks(gapped(spark, sf)), known(spark, sf), ["chart", "date"])


@register("verify_lists", with_sql(ENTRIES_SQL, GAPPED_SQL, _LISTS_SQL, REGISTRY_SQL, _KNOWN_SQL, """
f AS (
  SELECT chart, 'fail' AS severity, 'new clamped' AS "check", 1 AS n FROM clamped
  WHERE (chart, date) NOT IN (SELECT (chart, date) FROM known)
  UNION ALL SELECT chart, 'warn', 'known clamped', 1 FROM clamped WHERE (chart, date) IN (SELECT (chart, date) FROM known)
  UNION ALL SELECT chart, 'warn', 'non-weekly steps', 1 FROM glag WHERE date - prev_date <> 7
  UNION ALL SELECT chart, 'warn', 'thin weeks', 1 FROM (SELECT chart, date FROM gapped GROUP BY 1, 2 HAVING count(*) < 5) t
  UNION ALL SELECT chart, 'fail', 'duplicates', count(*) - 1 FROM gapped GROUP BY chart, date, rank HAVING count(*) > 1)""") + """
SELECT chart, severity, "check", CAST(sum(n) AS INT) AS findings FROM f GROUP BY 1, 2, 3""")
def verify_lists(spark, sf):
    return quality.verify_lists(gapped(spark, sf), known(spark, sf))


@register("prove_feed", with_sql(ENTRIES_SQL, """
last AS (SELECT * FROM entries WHERE (chart, date) IN (SELECT (chart, max(date)) FROM entries GROUP BY chart)),
feeds AS (SELECT chart, 'same' AS feed, rank, title FROM last UNION ALL
          SELECT chart, 'other', rank, CASE WHEN rank = 4 THEN title || '?' ELSE title END FROM last),
tops AS (SELECT chart, feed, string_agg(rank || '|' || lower(trim(title)), chr(10) ORDER BY rank) AS l, count(*) AS n
         FROM feeds WHERE rank <= 5 GROUP BY 1, 2)""") + """
SELECT a.chart, a.feed, b.n >= 3 AND a.l = b.l AS proven FROM tops a JOIN tops b ON a.chart = b.chart AND b.feed = 'same'""")
def prove_feed(spark, sf):
    e = fx.entries(spark, sf).select("chart", "date", "rank", "title")
    same = e.withColumn("feed", F.lit("same"))
    other = e.withColumn("feed", F.lit("other")).withColumn(
        "title", F.expr("CASE WHEN rank = 4 THEN concat(title, '?') ELSE title END"))
    return quality.prove_feed(e, same.unionByName(other))


# --- year-end ---------------------------------------------------------------

_REAL_SQL = """
ysig AS (SELECT chart, year, string_agg(rank || '|' || title || '|' || artist, chr(10) ORDER BY rank) AS s FROM yearend GROUP BY 1, 2),
wsig AS (SELECT chart, s FROM ysig WHERE year = 1996),
marked AS (SELECT chart, year, s, EXISTS (SELECT 1 FROM wsig w WHERE w.chart = y.chart AND w.s = y.s) AS weekly FROM ysig y),
real AS (SELECT chart, year, weekly, max(CASE WHEN NOT weekly THEN year END) OVER (PARTITION BY chart, s) AS last FROM marked)"""


@register("real_years", with_sql(YEAREND_SQL, _REAL_SQL) + """
SELECT chart, year, NOT weekly AND year = last AND year <> 2000 AS genuine,
       CASE WHEN NOT weekly AND year < last THEN last END AS duplicate_of FROM real""")
def real_years(spark, sf):
    y = fx.yearend(spark, sf)
    weekly = quality.ranking_signatures(y.filter("year = 1996"), ["chart"])
    named = y.select("chart").distinct().withColumn("year", F.lit(2000))
    return yearend.real_years(y, weekly, named)


_GENUINE_SQL = """
ysig AS (SELECT chart, year, string_agg(rank || '|' || title || '|' || artist, chr(10) ORDER BY rank) AS s FROM yearend GROUP BY 1, 2),
genuine AS (SELECT chart, max(year) AS year FROM ysig GROUP BY chart, s)"""


@register("yearend_page", with_sql(YEAREND_SQL, REGISTRY_SQL, _GENUINE_SQL) + """
SELECT chart, year, rank, title, CASE WHEN kind = 'artist' THEN title ELSE artist END AS artist,
  CASE WHEN image_url IS NULL OR contains(image_url, 'lazyload') THEN '' ELSE image_url END AS image_url,
  CASE WHEN image_url IS NULL OR contains(image_url, 'lazyload') THEN '' ELSE replace(image_url, '-180x180.', '-344x344.') END AS image_url_lg
FROM yearend JOIN registry USING (chart)
WHERE (chart, year) IN (SELECT (chart, max(year)) FROM genuine GROUP BY chart)""")
def yearend_page(spark, sf):
    return yearend.yearend_page(fx.yearend(spark, sf), fx.registry(spark, sf))


def with_empty_lists(spark, sf):
    """The registry with as many lists again that no row belongs to."""
    r = fx.registry(spark, sf)
    return r.unionByName(r.withColumn("chart", F.concat("chart", F.lit("_empty"))))


@register("yearend_lists", with_sql(YEAREND_SQL, REGISTRY_SQL) + """
SELECT * FROM registry WHERE chart IN (SELECT chart FROM yearend)""")
def yearend_lists(spark, sf):
    return yearend.yearend_charts(fx.yearend(spark, sf), with_empty_lists(spark, sf))


@register("available_charts", with_sql(ENTRIES_SQL, REGISTRY_SQL) + """
SELECT * FROM registry WHERE chart IN (SELECT chart FROM entries)""")
def available_charts(spark, sf):
    return yearend.available_charts(fx.entries(spark, sf), with_empty_lists(spark, sf))


def _spelled(frame):
    """Titles that name the act, so that years differ."""
    return frame.withColumn("title", F.concat(F.trim("title"), F.lit(" by "), "artist"))


_OVERLAP_SQL = """
yt AS (SELECT DISTINCT chart, year, {yk} AS t FROM (SELECT *, trim(title) || ' by ' || artist AS ttl FROM yearend) y),
wt AS (SELECT DISTINCT chart, CAST(extract(year FROM date) AS INT) AS year, {yk} AS t
       FROM (SELECT *, trim(title) || ' by ' || artist AS ttl FROM kept) e),
cov AS (SELECT chart, CAST(extract(year FROM date) AS INT) AS year, CAST(count(DISTINCT date) AS INT) AS weeks FROM kept GROUP BY 1, 2),
ov AS (SELECT yt.chart, yt.year, CAST(count(*) AS INT) AS titles, CAST(count(wt.t) AS INT) AS matched, coalesce(any_value(weeks), 0) AS weeks
       FROM yt LEFT JOIN wt ON wt.chart = yt.chart AND wt.year = yt.year AND wt.t = yt.t
       LEFT JOIN cov ON cov.chart = yt.chart AND cov.year = yt.year GROUP BY 1, 2)"""
# Odd lists lack the first nine months of 1997, so that a year of theirs is thin.
_KEPT_SQL = """kept AS (SELECT * FROM entries WHERE NOT (CAST(substr(chart, 6) AS INT) % 2 = 1
  AND date BETWEEN DATE '1997-01-01' AND DATE '1997-09-30'))"""
_LOWER, _ALNUM = "lower(trim(ttl))", "regexp_replace(lower(ttl), '[^a-z0-9]', '', 'g')"
_OVER = with_sql(ENTRIES_SQL, YEAREND_SQL, _KEPT_SQL, _OVERLAP_SQL.format(yk=_LOWER))


def weekly_kept(spark, sf):
    e = fx.entries(spark, sf).filter("NOT (cast(substr(chart, 6) AS int) % 2 = 1 AND date BETWEEN date'1997-01-01' AND date'1997-09-30')")
    return _spelled(e).select("chart", "date", "rank", "title", "artist")


@register("yearend_overlap", _OVER + "SELECT * FROM ov")
def yearend_overlap(spark, sf):
    return yearend.yearend_overlap(_spelled(fx.yearend(spark, sf)), weekly_kept(spark, sf))


@register("verify_yearend", _OVER.rstrip() + """
SELECT *, CASE WHEN weeks < 20 AND chart = 'list_2' THEN 'accepted' WHEN weeks < 20 THEN 'untestable'
               WHEN pct < bar THEN 'fail' ELSE 'ok' END AS status FROM (
  SELECT *, CAST(floor(100 * matched / greatest(titles, 1)) AS INT) AS pct, 60.0 * least(1.0, weeks / 52) AS bar FROM ov) v""")
def verify_yearend(spark, sf):
    y = _spelled(fx.yearend(spark, sf))
    accepted = y.filter("chart = 'list_2'").select("chart", "year").distinct()
    return yearend.verify_yearend(y, weekly_kept(spark, sf), accepted)


_BEST_SQL = """
score AS (SELECT y.chart, y.year, wt.year AS wy, CAST(count(*) AS INT) AS score FROM (
            SELECT chart, year, {yk} AS t FROM (SELECT *, trim(title) || ' by ' || artist AS ttl FROM yearend) a) y
          JOIN wt ON wt.chart = y.chart AND wt.t = y.t JOIN cov ON cov.chart = wt.chart AND cov.year = wt.year AND weeks >= 20
          GROUP BY 1, 2, 3),
best AS (SELECT chart, year, arg_max(wy, (score, -wy)) AS best_year, max(score) AS score FROM score GROUP BY 1, 2)""".format(yk=_ALNUM)
_BESTQ = with_sql(ENTRIES_SQL, YEAREND_SQL, _KEPT_SQL, _OVERLAP_SQL.format(yk=_ALNUM), _BEST_SQL)


@register("best_matching_year", _BESTQ + "SELECT * FROM best")
def best_matching_year(spark, sf):
    return yearend.best_matching_year(_spelled(fx.yearend(spark, sf)), weekly_kept(spark, sf))


@register("accept_yearend", _BESTQ + """
SELECT chart, year, coalesce(weeks >= 20 AND share >= 0.6 * least(1.0, weeks / 52) AND best_year = year, false) AS accepted
FROM (SELECT y.chart, y.year, count(wt.t) / count(*) AS share FROM (
        SELECT chart, year, regexp_replace(lower(trim(title) || ' by ' || artist), '[^a-z0-9]', '', 'g') AS t FROM yearend) y
      LEFT JOIN wt ON wt.chart = y.chart AND wt.year = y.year AND wt.t = y.t GROUP BY 1, 2) s
LEFT JOIN cov USING (chart, year) LEFT JOIN best USING (chart, year)""")
def accept_yearend(spark, sf):
    return yearend.accept_yearend(_spelled(fx.yearend(spark, sf)), weekly_kept(spark, sf))


# --- matching a second source -----------------------------------------------

_SRC = (ENTRIES_SQL, ALBUMS_SQL, SOURCE_SQL)


def source(spark, sf):
    return fx.source_rows(fx.albums(spark, sf))


def both_sources(spark, sf):
    lists = fx.albums(spark, sf)
    return lists, fx.source_rows(lists)


def dated(rows):
    return rows.withColumn("date", F.date_add("week", matching.OFFSET_DAYS))


@register("offset_join", with_sql(*_SRC) + """
SELECT DISTINCT chart, week, CAST(week + 9 AS DATE) AS date FROM src WHERE (chart, CAST(week + 9 AS DATE)) IN (SELECT (chart, date) FROM albums)""")
def offset_join(spark, sf):
    return matching.offset_join(source(spark, sf).select("chart", "week").distinct(), fx.albums(spark, sf))


_CAND_SQL = """
cand AS (SELECT DISTINCT w.chart, week, date FROM (SELECT DISTINCT chart, week FROM src) w
         JOIN (SELECT DISTINCT chart, date FROM albums) d ON d.chart = w.chart AND date - week BETWEEN 1 AND 25)"""


@register("week_candidates", with_sql(*_SRC, _CAND_SQL) + "SELECT * FROM cand")
def week_candidates(spark, sf):
    return matching.week_candidates(source(spark, sf), fx.albums(spark, sf))


_FIT_SQL = f"""
top AS (SELECT chart, date, {sql_norm('title')} AS t, max(rank) AS rank FROM albums WHERE rank <= 20 GROUP BY 1, 2, 3),
ten AS (SELECT chart, week, src_rank, {sql_norm('title')} AS t FROM src WHERE src_rank <= 10),
fits AS (SELECT c.chart, c.week, c.date, CAST(count(*) FILTER (top.rank = ten.src_rank) AS INT) AS exact,
                CAST(count(top.rank) AS INT) AS overlap
         FROM cand c JOIN ten ON ten.chart = c.chart AND ten.week = c.week
         LEFT JOIN top ON top.chart = c.chart AND top.date = c.date AND top.t = ten.t GROUP BY 1, 2, 3)"""


def fits(spark, sf):
    lists, rows = both_sources(spark, sf)
    tasks = fx.tasks(spark, sf)
    return matching.best_fit(rows, lists, matching.week_candidates(rows, lists, partitions=tasks), tasks)


@register("best_fit", with_sql(*_SRC, _CAND_SQL, _FIT_SQL) + "SELECT * FROM fits")
def best_fit(spark, sf):
    return fits(spark, sf)


_COPY_SQL = """
slist AS (SELECT chart, week, string_agg(src_rank || '|' || artist || '|' || title || '|' || units, chr(10) ORDER BY src_rank) AS l
          FROM src GROUP BY 1, 2),
own AS (SELECT chart, week, overlap * 100 + exact AS fit FROM fits WHERE date - week = 9),
pairs AS (SELECT *, lead(l) OVER w AS nl, lead(week) OVER w AS nw, lead(coalesce(fit, 0)) OVER w AS nf
          FROM slist LEFT JOIN own USING (chart, week) WINDOW w AS (PARTITION BY chart ORDER BY week))"""


@register("copied_weeks", with_sql(*_SRC, _CAND_SQL, _FIT_SQL, _COPY_SQL) + """
SELECT chart, nw AS week FROM pairs WHERE l = nl AND coalesce(fit, 0) >= nf
UNION SELECT chart, week FROM pairs WHERE l = nl AND coalesce(fit, 0) <= nf""")
def copied_weeks(spark, sf):
    own = fits(spark, sf).filter(F.datediff("date", "week") == 9).withColumn("fit", F.expr("overlap * 100 + exact"))
    return matching.copied_weeks(source(spark, sf), own)


@register("copied_weeks_drop_both", with_sql(*_SRC, _CAND_SQL, _FIT_SQL, _COPY_SQL) + """
SELECT chart, nw AS week FROM pairs WHERE l = nl UNION SELECT chart, week FROM pairs WHERE l = nl""")
def copied_weeks_drop_both(spark, sf):
    return matching.copied_weeks(source(spark, sf))


_PLACE_SQL = """
r AS (SELECT *, date - week AS lg, row_number() OVER w AS n, lead(exact) OVER w = exact AND lead(overlap) OVER w = overlap AS tied
      FROM fits WINDOW w AS (PARTITION BY chart, week ORDER BY exact DESC, overlap DESC, date DESC)),
fst AS (SELECT * FROM r WHERE n = 1 AND overlap >= 7 AND NOT coalesce(tied, false)),
ar AS (SELECT *, lag(lg) OVER w AS b, lead(lg) OVER w AS a FROM fst WINDOW w AS (PARTITION BY chart ORDER BY week)),
odd AS (SELECT *, coalesce(abs(b - a) <= 2 AND abs(lg - b) >= 4, false) AS odd FROM ar),
mv AS (SELECT o.chart, o.week, min(r.date) AS date, min(r.exact) AS exact, min(r.overlap) AS overlap
       FROM odd o JOIN r ON r.chart = o.chart AND r.week = o.week AND abs(r.lg - o.b) <= 2 WHERE o.odd
       GROUP BY 1, 2 HAVING count(*) = 1 AND min(r.overlap) >= 7),
pl AS (SELECT chart, week, date, exact, overlap FROM odd WHERE NOT odd UNION ALL SELECT * FROM mv)"""


@register("place_weeks", with_sql(*_SRC, _CAND_SQL, _FIT_SQL, _PLACE_SQL) + """
SELECT chart, week, date FROM pl p WHERE NOT EXISTS (
  SELECT 1 FROM pl q WHERE q.chart = p.chart AND q.date = p.date AND q.week <> p.week AND (q.exact, q.overlap) >= (p.exact, p.overlap))""")
def place_weeks(spark, sf):
    return matching.place_weeks(fits(spark, sf))


_UNSWAP_SQL = f"""
us AS (SELECT chart, CAST(week + 9 AS DATE) AS date, week, src_rank, units,
  CASE WHEN title = 'SOUNDTRACK' THEN artist ELSE title END AS title,
  CASE WHEN title = 'SOUNDTRACK' THEN 'Soundtrack' ELSE artist END AS artist FROM src),
ut AS (SELECT DISTINCT title AS t0, {sql_title_key('title')} AS k_t FROM us),
ua AS (SELECT DISTINCT artist AS a0, {sql_lead_artist('artist')} AS k_a FROM us),
s AS (SELECT us.*, k_t, k_a FROM us JOIN ut ON title = t0 JOIN ua ON artist = a0),
e AS (SELECT chart, date, rank, title, artist, k_t, k_a FROM albums
      JOIN (SELECT DISTINCT title AS t0, {sql_title_key('title')} AS k_t FROM albums) x ON title = t0
      JOIN (SELECT DISTINCT artist AS a0, {sql_lead_artist('artist')} AS k_a FROM albums) y ON artist = a0),
e1 AS (SELECT chart, date, k_t, k_a, max(rank) AS r1 FROM e GROUP BY 1, 2, 3, 4),
e2 AS (SELECT chart, date, k_t, max(rank) AS r2 FROM e GROUP BY 1, 2, 3 HAVING count(*) = 1),
k12 AS (SELECT s.*, coalesce(r1, r2) AS r12 FROM s LEFT JOIN e1 USING (chart, date, k_t, k_a) LEFT JOIN e2 USING (chart, date, k_t)),
e3 AS (SELECT o.chart, o.date, o.k_a, o.k_t, max(e.rank) AS r3 FROM (SELECT DISTINCT chart, date, k_a, k_t FROM k12 WHERE r12 IS NULL) o
       JOIN e ON e.chart = o.chart AND e.date = o.date AND e.k_a = o.k_a AND (contains(e.k_t, o.k_t) OR contains(o.k_t, e.k_t))
       GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
res AS (SELECT k12.*, coalesce(r12, r3) AS r FROM k12 LEFT JOIN e3 USING (chart, date, k_a, k_t)),
fin AS (SELECT *, CASE WHEN r IS NOT NULL AND src_rank = min(src_rank) OVER (PARTITION BY chart, date, r) THEN r END AS m FROM res)"""


@register("match_entities", with_sql(*_SRC, _UNSWAP_SQL) + """
SELECT chart, date, week, src_rank, k_t, k_a, m AS m_rank, albums.title AS m_title, albums.artist AS m_artist
FROM fin LEFT JOIN albums ON albums.chart = fin.chart AND albums.date = fin.date AND albums.rank = fin.m""".replace(
    "SELECT chart, date, week", "SELECT fin.chart, fin.date, week"))
def match_entities(spark, sf):
    lists, rows = both_sources(spark, sf)
    return matching.match_entities(dated(rows), lists, partitions=2 * fx.tasks(spark, sf)).select(
        "chart", "date", "week", "src_rank", "k_t", "k_a", "m_rank", "m_title", "m_artist")


# The longest common block of two keys, the first one in each: difflib's step.
_BLOCK = """list_filter(flatten(list_transform(range(least(length({a}), length({b})), 0, -1), lambda k: list_transform(
  range(1, length({a}) - k + 2), lambda i: {{'k': k, 'i': i}}))), lambda c: contains({b}, substr({a}, c.i, c.k)))[1]"""
_FUZZY_SQL = f"""
mt AS (SELECT *, row_number() OVER (PARTITION BY chart, date ORDER BY src_rank, title, artist) AS no FROM fin),
fr AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM fin WHERE fin.chart = e.chart AND fin.date = e.date AND fin.m = e.rank)),
pr AS (SELECT o.chart, o.date, o.no, o.k_t, o.k_a, f.rank AS f_rank, f.k_t AS f_t, f.k_a AS f_a,
         length(o.k_t) >= 4 AND length(f.k_t) >= 4 AND (starts_with(f.k_t, o.k_t) OR starts_with(o.k_t, f.k_t)) AS prefix
       FROM mt o JOIN fr f ON f.chart = o.chart AND f.date = o.date WHERE o.m IS NULL),
both_ AS (SELECT k_t AS a, f_t AS b FROM pr UNION SELECT k_a, f_a FROM pr),
seg AS (
  SELECT a AS a0, b AS b0, a, b, {_BLOCK.format(a="a", b="b")} AS blk FROM both_ WHERE a <> '' AND 40 * least(length(a), length(b)) >= 17 * (length(a) + length(b))
  UNION ALL
  SELECT a0, b0, x.a, x.b, {_BLOCK.format(a="x.a", b="x.b")}
  FROM (SELECT a0, b0, unnest([
          {{'a': substr(a, 1, blk.i - 1), 'b': substr(b, 1, instr(b, substr(a, blk.i, blk.k)) - 1)}},
          {{'a': substr(a, blk.i + blk.k), 'b': substr(b, instr(b, substr(a, blk.i, blk.k)) + blk.k)}}]) AS x
        FROM seg WHERE blk IS NOT NULL) WHERE x.a <> '' AND x.b <> ''),
alike AS (SELECT a0, b0 FROM seg GROUP BY 1, 2 HAVING 40 * coalesce(sum(blk.k), 0) >= 17 * (length(a0) + length(b0))),
cd AS (SELECT pr.*, t.a0 IS NOT NULL AS near, n.a0 IS NOT NULL AS same FROM pr LEFT JOIN alike t ON t.a0 = k_t AND t.b0 = f_t
       LEFT JOIN alike n ON n.a0 = k_a AND n.b0 = f_a),
cl AS (SELECT chart, date, no, row_number() OVER (PARTITION BY chart, date ORDER BY no) AS turn,
         list({{'rank': f_rank, 'prefix': prefix, 'alike': near AND k_a = f_a, 'close': near AND same AND f_t <> ''}}) AS c
       FROM cd WHERE prefix OR near GROUP BY 1, 2, 3),
st AS (
  SELECT DISTINCT chart, date, 0::BIGINT AS turn, []::INT[] AS used, NULL::BIGINT AS no, NULL::INT AS won FROM cl
  UNION ALL
  SELECT chart, date, turn, CASE WHEN won IS NULL THEN used ELSE list_append(used, won) END, no, won FROM (
    SELECT *, CASE WHEN len(list_filter(c, lambda x: x.prefix)) = 1 THEN list_filter(c, lambda x: x.prefix)[1].rank
                   WHEN len(list_filter(c, lambda x: x.alike)) = 1 THEN list_filter(c, lambda x: x.alike)[1].rank
                   WHEN len(list_filter(c, lambda x: x.close)) = 1 THEN list_filter(c, lambda x: x.close)[1].rank END AS won
    FROM (SELECT cl.chart, cl.date, cl.turn, st.used, cl.no, list_filter(cl.c, lambda x: NOT list_contains(st.used, x.rank)) AS c
          FROM st JOIN cl ON cl.chart = st.chart AND cl.date = st.date AND cl.turn = st.turn + 1))),
fz AS (SELECT mt.chart, mt.date, week, src_rank, coalesce(m, won) AS m_rank FROM mt
       LEFT JOIN st ON st.chart = mt.chart AND st.date = mt.date AND st.no = mt.no)"""
_FUZZY = with_sql(*_SRC, _UNSWAP_SQL, _FUZZY_SQL).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT fz.chart, fz.date, week, src_rank, m_rank, albums.title AS m_title, albums.artist AS m_artist
FROM fz LEFT JOIN albums ON albums.chart = fz.chart AND albums.date = fz.date AND albums.rank = m_rank"""


@register("match_fuzzy", _FUZZY)
def match_fuzzy(spark, sf):
    lists, rows = both_sources(spark, sf)
    tasks = 2 * fx.tasks(spark, sf)
    matched = matching.match_entities(dated(rows), lists, partitions=tasks)
    return matching.match_fuzzy(matched, lists, partitions=tasks).select(
        "chart", "date", "week", "src_rank", "m_rank", "m_title", "m_artist")


@register("match_rows", _FUZZY)
def match_rows(spark, sf):
    lists, rows = both_sources(spark, sf)
    return matching.match_rows(dated(rows), lists, partitions=2 * fx.tasks(spark, sf)).select("chart", "date", "week", "src_rank", "m_rank", "m_title", "m_artist")


_OFFICIAL_SQL = """
figs AS (SELECT chart, date, CASE extract(month FROM date) % 4 WHEN 0 THEN title WHEN 1 THEN replace(upper(title), 'S', '$') || ' Deluxe'
           WHEN 2 THEN 'Something else' ELSE 'Other' END AS title,
         CASE WHEN extract(month FROM date) % 4 = 3 THEN 'Nobody' ELSE artist END AS artist, metric AS units FROM albums WHERE rank = 1)"""


def figures(lists):
    return lists.filter("rank = 1").select(
        "chart", "date", F.expr("CASE month(date) % 4 WHEN 0 THEN title WHEN 1 THEN concat(replace(upper(title), 'S', '$'), ' Deluxe') "
                                "WHEN 2 THEN 'Something else' ELSE 'Other' END").alias("title"),
        F.expr("CASE WHEN month(date) % 4 = 3 THEN 'Nobody' ELSE artist END").alias("artist"),
        F.col("metric").alias("units"))


@register("pin_official", with_sql(ENTRIES_SQL, ALBUMS_SQL, _OFFICIAL_SQL) + """
SELECT f.chart, f.date, f.title, f.artist, units, a.title AS s_title, a.artist AS s_artist,
       CASE WHEN extract(month FROM f.date) % 4 = 3 THEN 'stored No. 1 is ' || a.title || ' by ' || a.artist END AS reason
FROM figs f JOIN albums a ON a.chart = f.chart AND a.date = f.date AND a.rank = 1""")
def pin_official(spark, sf):
    return matching.pin_official(figures(fx.albums(spark, sf)), fx.albums(spark, sf))


_UNITS = """CASE WHEN rank % 5 = 0 THEN NULL ELSE metric + seq END"""


def unit_rows(spark, sf):
    e = fx.entries(spark, sf).select("chart", "date", "title", "artist", "rank", "metric")
    return (e.withColumn("seq", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
            .withColumn("units", F.expr(_UNITS))
            .withColumn("source", F.expr("CASE WHEN rank % 3 = 0 AND seq < 3 THEN 'official' ELSE 'other' END")))


_UNITS_SQL = f"""
urows AS (SELECT chart, date, trim(title) AS title, trim(artist) AS artist, rank, seq, {_UNITS} AS units,
            CASE WHEN rank % 3 = 0 AND seq < 3 THEN 'official' ELSE 'other' END AS source
          FROM entries, (SELECT unnest([1, 2, 3]) AS seq) q),
uone AS (SELECT chart, date, title, artist, units, source FROM (
  SELECT *, row_number() OVER (PARTITION BY chart, date, title, artist
    ORDER BY source = 'official' DESC, CASE WHEN source = 'official' THEN seq ELSE -seq END) AS n
  FROM urows WHERE units IS NOT NULL) t WHERE n = 1)"""


@register("source_precedence", with_sql(ENTRIES_SQL, _UNITS_SQL) + "SELECT chart, date, title, artist, units, source FROM uone")
def source_precedence(spark, sf):
    return ingest.source_precedence(unit_rows(spark, sf), "official").select("chart", "date", "title", "artist", "units", "source")


@register("units_join", with_sql(ENTRIES_SQL, _UNITS_SQL) + """
SELECT e.chart, e.date, e.rank, u.units, u.source AS units_source FROM entries e LEFT JOIN uone u
  ON u.chart = e.chart AND u.date = e.date AND u.title = trim(e.title) AND u.artist = trim(e.artist)""")
def units_join(spark, sf):
    units = ingest.source_precedence(unit_rows(spark, sf), "official")
    return ingest.units_join(fx.entries(spark, sf), units).select("chart", "date", "rank", "units", "units_source")


@register("override_join", """
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 AND p_partkey % 20 = 0 THEN 'Fixed' WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END AS title,
       CASE WHEN p_partkey % 20 = 0 THEN p_brand WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS artist FROM part""")
def override_join(spark, sf):
    raw = F.expr("CASE WHEN p_partkey % 10 = 0 THEN concat(p_name, '- ', p_brand) ELSE concat(p_name, ' - ', p_brand) END")
    p = fx.table(spark, sf, "part")
    rows = p.select("p_partkey", raw.alias("text")).withColumn("s", text.split_pair(F.col("text"))).select(
        "p_partkey", "text", "s.title", "s.artist")
    fixes = p.filter("p_partkey % 10 = 0").select(
        "p_partkey", F.expr("CASE WHEN p_partkey % 20 = 0 THEN concat(p_name, '- ', p_brand) ELSE 'changed' END").alias("source_text"),
        F.lit("Fixed").alias("new_title"), F.col("p_brand").alias("new_artist"))
    return ingest.override_join(rows, fixes, ["p_partkey"]).drop("text")


# Everything that leads to units: copies go first, then weeks are placed. One
# list's dates belong to another source; two captures of each week came too soon
# or too late.
_LEDGER_SQL = f"""
owned AS (SELECT DISTINCT chart, date FROM albums WHERE chart = 'list_0' AND extract(month FROM date) = 5),
copy AS (SELECT chart, nw AS week FROM pairs WHERE l = nl UNION SELECT chart, week FROM pairs WHERE l = nl),
src AS (SELECT * FROM src0 WHERE (chart, week) NOT IN (SELECT (chart, week) FROM copy))"""
_PLACED_SQL = """
placed AS (SELECT chart, week, date FROM pl p WHERE NOT EXISTS (
  SELECT 1 FROM pl q WHERE q.chart = p.chart AND q.date = p.date AND q.week <> p.week AND (q.exact, q.overlap) >= (p.exact, p.overlap))),
ready AS (SELECT * FROM placed WHERE (chart, date) NOT IN (SELECT (chart, date) FROM owned))"""
_LEDGER = with_sql(
    ENTRIES_SQL, ALBUMS_SQL, SOURCE_SQL.replace("src AS", "src0 AS"), _OFFICIAL_SQL,
    "slist" + _COPY_SQL.split("slist", 1)[1].split(",\nown AS")[0].replace("FROM src ", "FROM src0 "),
    "pairs AS (SELECT *, lead(l) OVER w AS nl, lead(week) OVER w AS nw FROM slist WINDOW w AS (PARTITION BY chart ORDER BY week))",
    _LEDGER_SQL, _CAND_SQL, _FIT_SQL, _PLACE_SQL, _PLACED_SQL,
    _UNSWAP_SQL.replace("CAST(week + 9 AS DATE) AS date", "date").replace("FROM src),", "FROM src JOIN ready USING (chart, week)),"),
    _FUZZY_SQL, """
off AS (SELECT f.chart, f.date, units, a.title AS s_title, a.artist AS s_artist, extract(month FROM f.date) % 4 <> 3 AS good
        FROM figs f JOIN albums a ON a.chart = f.chart AND a.date = f.date AND a.rank = 1),
led AS (
  SELECT s.chart, s.week, s.src_rank, p.date, fz.m_rank, CAST(replace(s.units, ',', '') AS BIGINT) AS units, 'source' AS source,
    CASE WHEN c.week IS NOT NULL THEN 'copied' WHEN p.date IS NULL THEN 'unplaced' WHEN r.date IS NULL THEN 'owned'
         WHEN fz.m_rank IS NULL THEN 'unmatched' END AS status
  FROM src0 s LEFT JOIN copy c ON c.chart = s.chart AND c.week = s.week LEFT JOIN placed p ON p.chart = s.chart AND p.week = s.week
  LEFT JOIN ready r ON r.chart = s.chart AND r.week = s.week
  LEFT JOIN fz ON fz.chart = s.chart AND fz.week = s.week AND fz.src_rank = s.src_rank
  UNION ALL SELECT chart, date, 1, date, 1, units, 'official', CASE WHEN NOT good THEN 'rejected' END FROM off
  UNION ALL SELECT chart, week, src_rank, NULL, NULL, CAST(replace(units, ',', '') AS BIGINT), 'source', 'superseded' FROM src0 WHERE src_rank <= 2)""").replace("WITH", "WITH RECURSIVE", 1)
_STATUS_SQL = """
fate AS (SELECT chart, week, src_rank, CASE WHEN status IS NULL OR status = 'unmatched' THEN date END AS date,
           CASE WHEN status IS NULL THEN m_rank END AS m_rank, units, source, coalesce(status, CASE WHEN row_number() OVER (
             PARTITION BY chart, date, m_rank, status ORDER BY source = 'official' DESC, -src_rank, week DESC) > 1 THEN 'outranked' ELSE 'used' END) AS status
         FROM led)"""


def ledger(spark, sf):
    lists, rows = both_sources(spark, sf)
    named = rows.withColumn("capture_id", F.concat_ws("/", "chart", "week", F.lit("b")))
    early = rows.filter("src_rank <= 2").withColumn("capture_id", F.concat_ws("/", "chart", "week", F.lit("a")))
    owned = lists.filter("chart = 'list_0' AND month(date) = 5")
    return matching.units_ledger(captures(rows), named.unionByName(early), lists, figures(lists), owned, partitions=2 * fx.tasks(spark, sf))


@register("units_ledger", _LEDGER.rstrip() + "," + _STATUS_SQL + "SELECT * FROM fate")
def units_ledger(spark, sf):
    return ledger(spark, sf).select("chart", "week", "src_rank", "date", "m_rank", "units", "source", "status")


@register("units_ledger_counts", _LEDGER.rstrip() + "," + _STATUS_SQL + "SELECT status, source, count(*) AS n FROM fate GROUP BY 1, 2")
def units_ledger_counts(spark, sf):
    return ledger(spark, sf).groupBy("status", "source").agg(F.count("*").alias("n"))


@register("build_units", _LEDGER.rstrip() + "," + _STATUS_SQL + """
SELECT f.chart, f.date, trim(a.title) AS title, trim(a.artist) AS artist, f.m_rank AS rank, f.units, f.source, f.week AS source_week,
       f.src_rank AS source_rank
FROM fate f JOIN albums a ON a.chart = f.chart AND a.date = f.date AND a.rank = f.m_rank WHERE status = 'used'""")
def build_units(spark, sf):
    lists, rows = both_sources(spark, sf)
    named = rows.withColumn("capture_id", F.concat_ws("/", "chart", "week", F.lit("b")))
    owned = lists.filter("chart = 'list_0' AND month(date) = 5")
    return matching.build_units(captures(rows), named, lists, figures(lists), owned=owned, partitions=2 * fx.tasks(spark, sf)).drop("album_sales", "tea", "sea")


_PLACEMENT_SQL = """
won AS (SELECT chart, week, date FROM pl p WHERE NOT EXISTS (
  SELECT 1 FROM pl q WHERE q.chart = p.chart AND q.date = p.date AND q.week <> p.week AND (q.exact, q.overlap) >= (p.exact, p.overlap)))"""


@register("placements", with_sql(*_SRC, _CAND_SQL, _FIT_SQL, _PLACE_SQL, _PLACEMENT_SQL) + """
SELECT r.chart, r.week, won.date, CASE WHEN won.date IS NOT NULL THEN NULL WHEN r.overlap < 7 THEN 'best fit' WHEN r.tied THEN 'fit tied'
  WHEN pl.week IS NULL THEN 'lag' ELSE 'rival' END AS kind
FROM (SELECT chart, week, overlap, coalesce(tied, false) AS tied FROM r WHERE n = 1) r LEFT JOIN pl ON pl.chart = r.chart AND pl.week = r.week
LEFT JOIN won ON won.chart = r.chart AND won.week = r.week""")
def placements(spark, sf):
    placed = matching.placements(fits(spark, sf))
    return placed.select("chart", "week", "date", F.expr(
        "CASE WHEN reason LIKE 'best fit%' THEN 'best fit' WHEN reason LIKE 'fit tied%' THEN 'fit tied' WHEN reason LIKE 'lag%' THEN 'lag' "
        "WHEN reason IS NOT NULL THEN 'rival' END").alias("kind"))


def captures(rows):
    """Three captures of every source week: still building, final, too late."""
    kinds = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(d).alias("d"), F.lit(s).alias("status"))
                      for i, d, s in (("a", 3, "Building"), ("b", 10, "Final"), ("c", 60, "Final"))])
    weeks = rows.select("chart", "week").distinct().withColumn("k", F.explode(kinds))
    return weeks.select("chart", "week", F.expr("date_add(week, k.d)").alias("taken"), F.col("k.status").alias("status"),
                        F.concat_ws("/", "chart", "week", "k.id").alias("capture_id"))


@register("latest_capture", with_sql(*_SRC) + """
SELECT DISTINCT chart, week, chart || '/' || week || '/b' AS capture_id, CAST(week + 10 AS DATE) AS taken FROM src""")
def latest_capture(spark, sf):
    return matching.latest_capture(captures(source(spark, sf)))


# --- exports ----------------------------------------------------------------

_RED = "red AS (SELECT * FROM named WHERE name = 'red 0')"


def red(spark, sf):
    return stats.artist_rows(fx.entries(spark, sf), ["red 0"])


_HEADS_SQL = f"""
pa AS (SELECT artist AS a0, {sql_primary_artist('artist')} AS k_artist, {sql_primary_credit('artist')} AS pc
       FROM (SELECT DISTINCT artist FROM entries) d),
nk AS (SELECT named.*, k_artist FROM named JOIN pa ON artist = a0),
pairs AS (SELECT name, title, k_artist, min(date) AS debut, arg_max(artist, (date, artist)) AS credit FROM nk GROUP BY 1, 2, 3),
heads AS (SELECT name, title, k_artist, debut, credit, CASE WHEN pc <> credit OR count(*) OVER (PARTITION BY name, title) > 1
            THEN title || ' (' || credit || ')' ELSE title END AS header FROM pairs JOIN pa ON credit = a0)
"""
_HEADS = with_sql(ENTRIES_SQL, named_sql(), _HEADS_SQL.replace("JOIN pa ON credit = a0", "JOIN (SELECT a0, pc FROM pa) p ON credit = a0"))


@register("export_header", _HEADS + "SELECT name, title, k_artist, debut, credit, header FROM heads")
def export_header(spark, sf):
    return reshape.title_columns(stats.artist_rows(fx.entries(spark, sf), NAMES), ["name"]).drop("image_url")


@register("rank_long", with_sql(ENTRIES_SQL, KEYED_SQL) + "SELECT chart, date, title, k_artist, min(rank) AS rank FROM keyed GROUP BY 1, 2, 3, 4")
def rank_long(spark, sf):
    return reshape.rank_long(fx.entries(spark, sf), ["chart"])


def _melt(frame):
    """A pivot read back as (date, header, rank), for comparison."""
    names = [c for c in frame.columns if c != "date"]
    quoted = [f"`{n}`" for n in names]
    return frame.unpivot(["date"], quoted, "header", "rank").filter("rank IS NOT NULL")


@register("rank_pivot", _HEADS.rstrip() + """
SELECT date, header, min(rank) AS rank FROM nk JOIN heads USING (name, title, k_artist) WHERE name = 'red 0' GROUP BY 1, 2""")
def rank_pivot(spark, sf):
    return _melt(reshape.rank_pivot(red(spark, sf)))


_INITCAP = "upper(substr(trim(title), 1, 1)) || lower(substr(trim(title), 2))"


@register("rank_pivot_weekly_grid", with_sql(ENTRIES_SQL, named_sql(), f"""
cells AS (SELECT date, {_INITCAP} AS header, arg_min(rank, (rank, artist)) AS rank FROM named WHERE name = 'red 0' GROUP BY 1, 2),
grid AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date FROM cells)""")
          + "SELECT date, header, rank FROM cells WHERE date IN (SELECT date FROM grid)")
def rank_pivot_weekly_grid(spark, sf):
    return _melt(reshape.rank_pivot_weekly_grid(red(spark, sf)))


@register("weekly_grid_long", with_sql(ENTRIES_SQL, fx.KEYED_SQL, """
cells AS (SELECT chart, k_artist, date, array_to_string(list_transform(string_split(k_title, ' '),
            lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title, min(rank) AS rank
          FROM keyed GROUP BY 1, 2, 3, 4),
grid AS (SELECT chart, k_artist, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS date
         FROM (SELECT chart, k_artist, min(date) AS a, max(date) AS b FROM cells GROUP BY 1, 2) m)""")
          + "SELECT chart, k_artist, date, title, rank FROM grid LEFT JOIN cells USING (chart, k_artist, date)")
def weekly_grid_long(spark, sf):
    rows = history.with_keys(fx.keyed_entries(spark, sf))
    return reshape.weekly_grid_long(rows, ["chart", "k_artist"])


_LABELS = reshape.SCORECARD_ROWS
_TXT = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '') AS \"{v}\"" for k, v in _LABELS.items())


@register("versus_scorecard", _VERSUS_SQL.rstrip() + f""",
txt AS (SELECT name, {_TXT} FROM versus),
long AS (UNPIVOT txt ON {", ".join(f'"{v}"' for v in _LABELS.values())} INTO NAME stat VALUE value)
SELECT stat, """ + ", ".join(f"max(CASE WHEN name = '{n}' THEN value END) AS \"{n}\"" for n in NAMES)
          + " FROM long GROUP BY stat")
def versus_scorecard(spark, sf):
    return reshape.versus_scorecard(stats.versus(fx.entries(spark, sf), "list_0", NAMES), NAMES)


@register("versus_weekly", _HEADS.rstrip() + """
SELECT date, name || ': ' || header AS header, min(rank) AS rank FROM nk JOIN heads USING (name, title, k_artist) GROUP BY 1, 2""")
def versus_weekly(spark, sf):
    return reshape.versus_weekly_cells(stats.artist_rows(fx.keyed_entries(spark, sf), NAMES))


@register("versus_weekly_long", _HEADS.rstrip() + """
SELECT name, date, title, k_artist, header, min(rank) AS rank FROM nk JOIN heads USING (name, title, k_artist) GROUP BY 1, 2, 3, 4, 5""")
def versus_weekly_long(spark, sf):
    return reshape.versus_weekly_long(stats.artist_rows(fx.keyed_entries(spark, sf), NAMES))


_EXPORT = _HEADS.rstrip() + f""",
img AS (SELECT lower(trim(title)) AS kt, k_artist, arg_min(image_url, (chart, date, rank)) AS image_url
        FROM entries JOIN pa ON artist = a0 WHERE starts_with(image_url, 'http') GROUP BY 1, 2),
own AS (SELECT name, title, k_artist, arg_min(image_url, (date, rank, image_url)) AS own_url FROM nk
        WHERE starts_with(image_url, 'http') GROUP BY 1, 2, 3),
body AS (SELECT nk.name, date, false AS is_gap, header, coalesce(own_url, img.image_url, '') AS image_url, min(rank) AS rank
         FROM nk JOIN heads USING (name, title, k_artist) LEFT JOIN img ON img.kt = lower(trim(nk.title)) AND img.k_artist = nk.k_artist
         LEFT JOIN own ON own.name = nk.name AND own.title = nk.title AND own.k_artist = nk.k_artist
         GROUP BY nk.name, date, nk.title, nk.k_artist, header, own_url, img.image_url),
days AS (SELECT name, date, lead(date) OVER (PARTITION BY name ORDER BY date) AS nxt FROM (SELECT DISTINCT name, date FROM body) d),
export AS (SELECT * FROM body UNION ALL SELECT name, date, true, NULL, NULL, NULL FROM days WHERE nxt - date > 7)
"""


@register("artist_history_export", _EXPORT + "SELECT date, is_gap, header, image_url, rank FROM export WHERE name = 'red 0'")
def artist_history_export(spark, sf):
    e = fx.keyed_entries(spark, sf)
    return reshape.artist_history_export(stats.artist_rows(e, ["red 0"]), titles.image_index(e), ["name"]).drop("name")


@register("artist_history_exports", _EXPORT + "SELECT * FROM export")
def artist_history_exports(spark, sf):
    e = fx.keyed_entries(spark, sf)
    return reshape.artist_history_export(stats.artist_rows(e, NAMES), titles.image_index(e), ["name"])


# --- visits -----------------------------------------------------------------

@register("outer_day_join", with_sql(VISITS_SQL) + """
SELECT day, count(*) AS views, count(DISTINCT visitor) AS uniques FROM visits GROUP BY 1""")
def outer_day_join(spark, sf):
    return visits.daily(fx.visits(spark, sf))


@register("union_days", with_sql(VISITS_SQL) + """
SELECT day, count(*) AS views, count(DISTINCT CASE WHEN starts_with(path, '/click') THEN visitor END) AS uniques
FROM visits GROUP BY 1""")
def union_days(spark, sf):
    v = fx.visits(spark, sf)
    views = v.groupBy("day").agg(F.count("*").alias("views"))
    seen = visits.visitor_days(v.filter(F.startswith("path", F.lit("/click")))).groupBy("day").agg(
        F.count("*").alias("uniques"))
    return visits.views_and_uniques(views, seen, "day")


@register("top_paths", with_sql(VISITS_SQL) + "SELECT path, count(*) AS views FROM visits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_paths(spark, sf):
    return visits.top_paths(fx.visits(spark, sf))


@register("visit_summary", with_sql(VISITS_SQL) + """
SELECT 'lifetime' AS section, NULL AS period, count(*) AS views, count(DISTINCT visitor) AS uniques FROM visits
UNION ALL SELECT 'today', '2024-01-30', count(*), count(DISTINCT visitor) FROM visits WHERE day = DATE '2024-01-30'
UNION ALL SELECT 'recent', CAST(day AS VARCHAR), count(*), count(DISTINCT visitor) FROM visits
  WHERE day >= DATE '2024-01-30' - 9 GROUP BY day
UNION ALL SELECT 'monthly', strftime(day, '%Y-%m'), count(*), count(DISTINCT visitor) FROM visits GROUP BY 2""")
def visit_summary(spark, sf):
    return visits.visit_summary(fx.visits(spark, sf), "2024-01-30", 10)


# --- streams ----------------------------------------------------------------

def _arrived():
    return F.expr("unix_timestamp(ts) + event_id % 5 * 3600")


def _deliveries(spark, sf):
    """The events in four deliveries by time; some rows arrive up to four hours late."""
    events = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = events.agg(F.min(_arrived()).alias("lo"), F.max(_arrived()).alias("hi")).first()
    if bounds.lo is None:
        return [events, events]
    part = F.floor((_arrived() - bounds.lo) * 4 / (bounds.hi - bounds.lo + 1))
    return [events.where(part == i) for i in range(4)]


def _drain(spark, sf, count, keys, mode="update"):
    """Runs `count` over the deliveries one after the other, each in files as it
    comes; the query stops after each and starts again with the next."""
    path = scratch(spark, "stream")
    for i, part in enumerate(_deliveries(spark, sf)):
        part.write.parquet(f"{path}/in/{i}")
        raw = spark.readStream.schema(part.schema).options(recursiveFileLookup=True).parquet(f"{path}/in")
        seen = raw.select("ts", F.concat(F.lit("/"), "event_type", F.lit("/"), F.expr("event_id % 7")).alias("path"),
                          F.col("user_id").cast("string").alias("visitor"), _arrived().alias("arrived"))
        sinks.run_available(count(seen), f"{path}/out", f"{path}/checkpoint", mode, keys if mode == "update" else None, every=2)
    return sinks.latest_by_key(spark, f"{path}/out", keys) if mode == "update" else sinks.stored_rows(spark, f"{path}/out")


@register("stream_page_views", with_sql(VISITS_SQL) + "SELECT day, path, count(*) AS views FROM visits GROUP BY 1, 2")
def stream_page_views(spark, sf):
    return _drain(spark, sf, stream_visits.page_views, ["day", "path"])


@register("stream_visitor_days", with_sql(VISITS_SQL) + "SELECT DISTINCT visitor, day FROM visits")
def stream_visitor_days(spark, sf):
    return _drain(spark, sf, stream_visits.visitor_days, ["visitor", "day"], "append")


@register("stream_visitors", """
WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS visitor, CAST(ts AS DATE) AS day,
                     CAST(floor(epoch(ts)) AS BIGINT) + event_id % 5 * 3600 AS arrived FROM events WHERE user_id IS NOT NULL)
SELECT visitor, arg_min(day, (arrived, day)) AS first_seen, arg_max(day, (arrived, day)) AS last_seen, count(*) AS visits
FROM seen GROUP BY 1""")
def stream_visitors(spark, sf):
    return _drain(spark, sf, stream_visits.visitors, ["visitor"])


@register("stream_visitors_by_day", with_sql(VISITS_SQL) + """
SELECT visitor, min(day) AS first_seen, max(day) AS last_seen, count(*) AS visits FROM visits GROUP BY 1""")
def stream_visitors_by_day(spark, sf):
    return _drain(spark, sf, stream_visits.visitors_by_day, ["visitor"])


@register("stream_week_ingest", with_sql(ENTRIES_SQL, GAPPED_SQL, """
arrived AS (SELECT chart, date, rank, title, artist FROM gapped WHERE NOT (metric % 97 = 0 AND CAST(substr(chart, 6) AS INT) % 2 = 1)),
whole AS (SELECT chart, date, string_agg(rank || '|' || lower(trim(title)), chr(10) ORDER BY rank) AS l FROM arrived GROUP BY 1, 2
          HAVING min(rank) = 1 AND max(rank) = count(*)),
good AS (SELECT chart, date FROM (SELECT *, lag(l) OVER (PARTITION BY chart ORDER BY date) AS pl FROM whole) t
         WHERE l IS DISTINCT FROM pl)""") + "SELECT * FROM arrived WHERE (chart, date) IN (SELECT (chart, date) FROM good)")
def stream_week_ingest(spark, sf):
    path = scratch(spark, "weeks")
    arrived = gapped(spark, sf).filter("NOT (metric % 97 = 0 AND cast(substr(chart, 6) AS int) % 2 = 1)").select(
        "chart", "date", "rank", "title", "artist")
    # Three deliveries: earlier years, later years, and the later ones again.
    for i, part in enumerate((arrived.filter("date < date'1998-06-01'"), arrived.filter("date >= date'1998-06-01'"),
                              arrived.filter("date >= date'1998-06-01'"))):
        part.write.mode("overwrite").parquet(f"{path}/in/{i}")
        stream = spark.readStream.schema(arrived.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        stream_weeks.ingest_weeks(stream, f"{path}/out", f"{path}/checkpoint")
    return stream_weeks.stored_weeks(spark, f"{path}/out")
