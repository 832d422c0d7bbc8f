"""Registered queries: scans, sinks, projections and filters."""
from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlore.functions.credits import DELIM_PATTERN, artist_pattern
from chartlore.functions.dates import plausible_capture, served_date
from chartlore.operators import calendar, history, ingest, quality, stats, visits, yearend
from chartlore.plans import fixtures as fx
from chartlore.plans.fixtures import ENTRIES_SQL, GAPPED_SQL, REGISTRY_SQL, VISITS_SQL, YEAREND_SQL, with_sql
from chartlore.session import scratch
from chartlore.sources import lists, pages

NAMES = ["red 0", "Small 1", "Guest", "blue 2", "nobody"]
FILE_COLUMNS = ["date", "rank", "title", "artist", "last_week", "peak_position", "weeks_on_chart",
                "image_url"]
_FILE = ", ".join(FILE_COLUMNS)

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@register("scan_chart_csv", with_sql(ENTRIES_SQL) + f"SELECT {_FILE} FROM entries")
def scan_chart_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "list")
    lists.csv_sink(fx.entries(spark, sf).select("chart", *FILE_COLUMNS), path, partition=False)
    return lists.scan_chart_csv(spark, path, "all").select(*FILE_COLUMNS)


@register("scan_all_charts", with_sql(ENTRIES_SQL, REGISTRY_SQL)
          + f"SELECT chart, {_FILE} FROM entries WHERE chart IN (SELECT chart FROM registry WHERE kind <> 'album')")
def scan_all_charts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "lists")
    lists.csv_sink(fx.entries(spark, sf).select("chart", *FILE_COLUMNS), path)
    registered = fx.registry(spark, sf).filter("kind <> 'album'")
    return lists.scan_all_charts(spark, path, registered).select("chart", *FILE_COLUMNS)


def odd_files(spark: SparkSession, sf: str) -> str:
    """List files of three kinds: some without a title column, some with a column
    under its other name, the rest as usual."""
    path, mode = scratch(spark, "odd-lists"), F.expr("cast(substr(chart, 6) AS int) % 4")
    cells = {"Date": F.date_format("date", "M/d/yyyy"), "Rank": F.col("rank"), "Song": F.col("title"), "Artist": F.col("artist"),
             "Weeks on Chart": F.col("weeks_on_chart")}
    for kind, names in ((mode == 1, ("Rank", "Date", "Artist", "Weeks on Chart")), (mode == 2, ("Date", "Song", "Rank", "Artist", "Weeks in Charts")),
                        (~mode.isin(1, 2), tuple(cells))):
        columns = [cells.get(n, F.col("weeks_on_chart")).cast("string").alias(n) for n in names]
        (fx.entries(spark, sf).filter(kind).select("chart", *columns).write.mode("append").partitionBy("chart")
         .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    return path


@register("list_catalogue", with_sql(ENTRIES_SQL) + """
SELECT DISTINCT chart, CASE WHEN CAST(substr(chart, 6) AS INT) % 4 = 1 THEN 'no column for title' END AS defect,
       CASE CAST(substr(chart, 6) AS INT) % 4 WHEN 1 THEN 'rank,date,artist,weeks_on_chart' WHEN 2 THEN 'date,title,rank,artist,weeks_on_chart'
         ELSE 'date,rank,title,artist,weeks_on_chart' END AS columns FROM entries""")
def list_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    found = lists.catalogue(spark, odd_files(spark, sf), partitioned=True)
    return found.select("chart", "defect", F.array_join("columns", ",").alias("columns")).distinct()


@register("scan_catalogued", with_sql(ENTRIES_SQL) + """
SELECT chart, date, rank, title, artist, weeks_on_chart FROM entries WHERE CAST(substr(chart, 6) AS INT) % 4 <> 1""")
def scan_catalogued(spark: SparkSession, sf: str) -> DataFrame:
    found = lists.catalogue(spark, odd_files(spark, sf), partitioned=True)
    return lists.scan_catalogued(spark, found).select("chart", "date", "rank", "title", "artist", "weeks_on_chart")


@register("csv_sink", with_sql(ENTRIES_SQL) + """
SELECT chart, strftime(date, '%-m/%-d/%Y') AS "Date", CAST(rank AS VARCHAR) AS "Rank", title AS "Song",
       artist AS "Artist", image_url AS "Image URL" FROM entries""")
def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "sink")
    lists.csv_sink(fx.entries(spark, sf).select("chart", *FILE_COLUMNS), path)
    back = "Date string, Rank string, Song string, Artist string, `Last Week` string, " \
           "`Peak Position` string, `Weeks on Chart` string, `Image URL` string, chart string"
    return spark.read.schema(back).options(header=True, quote='"', escape='"').csv(path).select(
        "chart", "Date", "Rank", "Song", "Artist", "Image URL")


@register("chart_dates", with_sql(ENTRIES_SQL) + "SELECT DISTINCT chart, date FROM entries")
def chart_dates(spark, sf):
    return lists.chart_dates(fx.entries(spark, sf))




@register("scan_yearend", with_sql(YEAREND_SQL, REGISTRY_SQL) + """
SELECT chart, year, rank, title, artist, image_url FROM yearend
WHERE rank % 17 <> 0 AND rank <> 19 AND chart IN (SELECT chart FROM registry)""")
def scan_yearend(spark, sf):
    raw = fx.yearend(spark, sf).selectExpr(*[
        c.strip() for c in ("CASE WHEN rank = 19 THEN 'ghost' ELSE chart END AS chart;"
                            "CASE WHEN rank % 17 = 0 THEN 'n/a' ELSE CAST(year AS STRING) END AS year;"
                            "CASE WHEN rank % 5 = 0 THEN concat(rank, '.0') ELSE CAST(rank AS STRING) END AS rank;"
                            "title;artist;image_url").split(";")])
    return yearend.scan_yearend(raw, fx.registry(spark, sf))


@register("normalize_columns", with_sql(ENTRIES_SQL) + """
SELECT chart, date, rank, title, artist, NULLIF(last_week, 3) AS last_week, peak_position, weeks_on_chart,
       CAST(NULL AS VARCHAR) AS image_url FROM entries""")
def normalize_columns(spark, sf):
    raw = fx.entries(spark, sf).select(
        "chart", F.date_format("date", "MMMM d, yyyy").alias("Date"), F.col("rank").cast("string").alias("Rank"),
        F.col("title").alias("album"), F.col("artist").alias("Artist"),
        F.expr("CASE WHEN last_week = 3 THEN '-' ELSE cast(last_week AS string) END").alias("Last Week"),
        F.col("peak_position").alias("Peak Position"), F.col("weeks_on_chart").alias("Weeks in Charts"))
    return lists.normalize_columns(raw)


def _old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = fx.entries(spark, sf).select("chart", "date", "rank", "title", "artist")
    old = e.filter(F.weekofyear("date") % 3 != 0)
    return old, e.filter(F.weekofyear("date") % 2 == 0).withColumn("title", F.concat("title", F.lit(" v2")))


_OLD_NEW_SQL = """
old AS (SELECT chart, date, rank, title, artist FROM entries WHERE extract(week FROM date) % 3 <> 0),
new AS (SELECT chart, date, rank, title || ' v2' AS title, artist FROM entries
        WHERE extract(week FROM date) % 2 = 0)"""


@register("merge_upsert", with_sql(ENTRIES_SQL, _OLD_NEW_SQL) + """
SELECT * FROM new UNION ALL
SELECT * FROM old o WHERE NOT EXISTS (
  SELECT 1 FROM new n WHERE n.chart = o.chart AND n.date = o.date AND n.rank = o.rank)""")
def merge_upsert(spark, sf):
    return ingest.merge_upsert(*_old_new(spark, sf))


@register("keep_first_dedup", with_sql(ENTRIES_SQL, _OLD_NEW_SQL) + """
SELECT * FROM old UNION ALL
SELECT * FROM new n WHERE NOT EXISTS (
  SELECT 1 FROM old o WHERE n.chart = o.chart AND n.date = o.date AND n.rank = o.rank)""")
def keep_first_dedup(spark, sf):
    old, new = _old_new(spark, sf)
    both = old.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2)))
    return ingest.keep_first(both, "seq").drop("seq")


@register("append_only_weeks", with_sql(ENTRIES_SQL, _OLD_NEW_SQL) + """
SELECT * FROM new WHERE (chart, date) NOT IN (SELECT (chart, date) FROM old)""")
def append_only_weeks(spark, sf):
    return ingest.append_only_weeks(*_old_new(spark, sf))


@register("yearend_upsert", with_sql(YEAREND_SQL) + """
SELECT chart, year, rank, CASE WHEN rank % 2 = 0 THEN title || ' new' ELSE title END AS title, artist FROM yearend""")
def yearend_upsert(spark, sf):
    y = fx.yearend(spark, sf).select("chart", "year", "rank", "title", "artist")
    fresh = y.filter("rank % 2 = 0").withColumn("title", F.concat("title", F.lit(" new")))
    return yearend.yearend_upsert(
        y.withColumn("seq", F.lit(1)).unionByName(fresh.withColumn("seq", F.lit(2)))).drop("seq")


def _text_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', '', 'g')"
    # The entities that the pages hold.
    for name in ("lt", "gt", "quot", "#39", "nbsp", "amp"):
        char = html.unescape(f"&{name};").replace("\u00a0", " ").replace("'", "''")
        out = f"replace({out}, '&{name};', '{char}')"
    return f"trim({out})"


_ITEMS_SQL = f"""
items AS (
  SELECT page_id, i AS rank, {_text_sql('x[i]')} AS text, regexp_extract(x[i], 'href="/([^"]*)"', 1) AS link
  FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS x FROM pages) p,
       generate_series(1, len(x)) g(i))"""


def _items(spark, sf):
    return pages.extract_ranked_rows(fx.table(spark, sf, "pages"), "<li>(.*?)</li>", {"link": 'href="/([^"]*)"'})


@register("extract_ranked_rows", with_sql(_ITEMS_SQL) + f"""
SELECT page_id, CAST(rank AS INT) AS rank, text, {_text_sql('link')} AS link FROM items""")
def extract_ranked_rows(spark, sf):
    return _items(spark, sf)


@register("join_references", """
SELECT user_id AS page_id, event_id AS rank, CAST(json_extract(props, '$.k') AS INT) AS k FROM events
WHERE event_id % 5 <> 0 OR event_id % 2 = 0""")
def join_references(spark, sf):
    e = fx.table(spark, sf, "events")
    rows = e.select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("rank"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN props END").alias("inline"),
        F.expr("CASE WHEN event_id % 2 = 1 THEN hex(event_id) END").alias("ref"))
    lines = e.filter("event_id % 2 = 1 AND event_id % 5 <> 0").select(
        F.col("user_id").alias("page_id"), F.expr("hex(event_id)").alias("ref"), F.col("props").alias("line"))
    return pages.join_references(rows, lines, "k int").select("page_id", "rank", F.col("data.k").alias("k"))


@register("ffill_merged_cells", with_sql(_ITEMS_SQL, """
cells AS (SELECT page_id, rank, CASE WHEN rank % 3 = 1 THEN text END AS artist,
                 CASE WHEN rank % 3 = 1 OR rank = 6 THEN rank * 10 END AS units FROM items),
grouped AS (SELECT *, count(artist) OVER w AS ga, count(units) OVER w AS gu FROM cells
            WINDOW w AS (PARTITION BY page_id ORDER BY rank ROWS UNBOUNDED PRECEDING))""") + """
SELECT page_id, CAST(rank AS INT) AS rank, max(artist) OVER (PARTITION BY page_id, ga) AS artist,
       CAST(CASE WHEN count(*) OVER (PARTITION BY page_id, gu) = 1
            THEN max(units) OVER (PARTITION BY page_id, gu) END AS INT) AS units FROM grouped""")
def ffill_merged_cells(spark, sf):
    cells = _items(spark, sf).select(
        "page_id", "rank", F.expr("CASE WHEN rank % 3 = 1 THEN text END").alias("artist"),
        F.expr("CASE WHEN rank % 3 = 1 OR rank = 6 THEN rank * 10 END").alias("units"))
    named = pages.ffill_merged_cells(cells, "page_id", "rank", "artist")
    return pages.ffill_merged_cells(named, "page_id", "rank", "units", numeric=True)


@register("clean_entries", with_sql(ENTRIES_SQL) + """
SELECT chart, date, rank, min(t) AS title, artist FROM (
  SELECT chart, date, rank, title AS t, artist FROM entries WHERE metric % 13 <> 0 AND metric % 7 <> 0
  UNION ALL SELECT chart, date, rank, title || '*', artist FROM entries WHERE metric % 7 <> 0) x
GROUP BY chart, date, rank, artist""")
def clean_entries(spark, sf):
    e = fx.entries(spark, sf)
    raw = e.select(
        "chart", F.expr("CASE WHEN metric % 7 <> 0 THEN date END").alias("date"),
        F.expr("CASE WHEN metric % 13 = 0 THEN '-' ELSE cast(rank AS string) END").alias("rank"),
        "title", "artist")
    copies = e.select("chart", F.expr("CASE WHEN metric % 7 <> 0 THEN date END").alias("date"),
                      F.col("rank").cast("string").alias("rank"),
                      F.concat("title", F.lit("*")).alias("title"), "artist")
    return ingest.clean_entries(raw.unionByName(copies))


@register("entries_on", with_sql(ENTRIES_SQL) + """
SELECT chart, date, rank, title, artist FROM entries
WHERE chart = 'list_0' AND date = DATE '1998-01-05'""")
def entries_on(spark, sf):
    return ingest.entries_on(fx.entries(spark, sf), "list_0", "1998-01-05").select(
        "chart", "date", "rank", "title", "artist")




@register("entries_on_nearest", with_sql(ENTRIES_SQL, GAPPED_SQL, """
days AS (SELECT DISTINCT chart, date FROM gapped),
asked AS (SELECT DISTINCT chart, CAST(date + 4 AS DATE) AS asked FROM entries),
near AS (SELECT chart, asked, arg_min(date, (abs(date - asked), -epoch(date))) AS date
         FROM asked JOIN days USING (chart) GROUP BY 1, 2)""") + """
SELECT chart, asked, date, rank, title FROM near JOIN gapped USING (chart, date)""")
def entries_on_nearest(spark, sf):
    e = fx.entries(spark, sf)
    held = fx.gapped(e)
    asked = e.select("chart", F.date_add("date", 4).alias("asked")).distinct()
    near = calendar.nearest_date(held, asked)
    return near.join(held, ["chart", "date"]).select("chart", "asked", "date", "rank", "title")


@register("floor_filter", with_sql(ENTRIES_SQL) + """
SELECT chart, date, rank, title FROM entries WHERE date >= DATE '1998-01-01'""")
def floor_filter(spark, sf):
    return ingest.floor_filter(fx.entries(spark, sf), "1998-01-01").select("chart", "date", "rank", "title")


def named_sql(names=NAMES) -> str:
    """CTE `named`: rows naming each asked artist."""
    hits = []
    for n in names:
        p = artist_pattern(n).replace("'", "''")
        hits.append(
            f"SELECT *, '{n}' AS name FROM entries WHERE regexp_matches(lower(trim(artist)), '{p}') OR "
            rf"regexp_matches(regexp_extract(lower(trim(artist)), '^the\s+(.+?)\s+band$', 1), '{p}')")
    return "named AS (" + "\nUNION ALL ".join(hits) + ")"


@register("artist_rows", with_sql(ENTRIES_SQL, named_sql()) + """
SELECT name, chart, date, rank, title, artist FROM named""")
def artist_rows(spark, sf):
    return stats.artist_rows(fx.entries(spark, sf), NAMES).select(
        "name", "chart", "date", "rank", "title", "artist")


# Every act that a list names alone, and some that need care: looked up in all credits.
_ASKED_SQL = r"""
asked AS (SELECT DISTINCT act AS name FROM entries UNION SELECT unnest(['guest', 'Other', 'new', 'band', '/', 'Guest & Other', 'red 0, guest'])),
shown AS (SELECT DISTINCT artist, lower(trim(artist)) AS c FROM entries),
patterned AS (SELECT name, lower(trim(name)) AS n,
    '(?:^|{delim})' || regexp_replace(lower(trim(name)), '([^\w\s])', '\\\1', 'g') || '(?:{delim}|$)' AS p FROM asked),
named_in AS (SELECT artist, name FROM shown JOIN patterned ON contains(c, n)
             WHERE regexp_matches(c, p) OR regexp_matches(regexp_extract(c, '^the\s+(.+?)\s+band$', 1), p))""".replace("{delim}", DELIM_PATTERN)


@register("artist_rows_of", with_sql(ENTRIES_SQL, _ASKED_SQL) + """
SELECT name, chart, date, rank, title, artist FROM entries JOIN named_in USING (artist)""")
def artist_rows_of(spark, sf):
    entries = fx.entries(spark, sf)
    more = spark.createDataFrame([(n,) for n in ("guest", "Other", "new", "band", "/", "Guest & Other", "red 0, guest")], "name string")
    names = entries.select(F.col("act").alias("name")).distinct().union(more)
    return stats.artist_rows_of(entries, names).select("name", "chart", "date", "rank", "title", "artist")


@register("title_rows", with_sql(ENTRIES_SQL, fx.KEYED_SQL) + """
SELECT chart, date, rank, title, artist FROM keyed WHERE k_title = 'ring' AND k_artist = 'red 0'""")
def title_rows(spark, sf):
    return history.title_rows(fx.entries(spark, sf), " Ring", "RED 0 Featuring Guest").select(
        "chart", "date", "rank", "title", "artist")


@register("exact_credit_rows", with_sql(ENTRIES_SQL) + """
SELECT chart, date, rank, title, artist FROM entries
WHERE lower(trim(title)) = 'ring' AND lower(trim(artist)) = 'red 0 & guest'""")
def exact_credit_rows(spark, sf):
    return history.exact_credit_rows(fx.entries(spark, sf), "Ring", "Red 0 & Guest").select(
        "chart", "date", "rank", "title", "artist")


@register("countable_visits", with_sql(VISITS_SQL) + """
SELECT ts, path, visitor FROM visits WHERE method = 'GET' AND NOT starts_with(path, '/error') AND path <> '/view/3'""")
def countable_visits(spark, sf):
    return visits.countable_visits(fx.visits(spark, sf), ("/error",), ("/view/3",)).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "path", "visitor")


@register("plausible_capture", """
SELECT event_id, CAST(ts AS DATE) AS week, CAST(ts AS DATE) + CAST(event_id % 90 - 20 AS INT) AS taken FROM events
WHERE event_id % 90 - 20 BETWEEN 1 AND 45""")
def plausible_capture_query(spark, sf):
    c = fx.table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("week"),
        F.date_add(F.to_date("ts"), F.expr("cast(event_id % 90 - 20 AS int)")).alias("taken"))
    return c.filter(plausible_capture(F.col("week"), F.col("taken")))


@register("served_week_guard", """
SELECT o_orderkey AS page_id, CAST(o_orderdate AS DATE) AS asked FROM orders
WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""")
def served_week_guard(spark, sf):
    html = F.when(F.col("o_orderkey") % 5 == 0, F.lit("<h2>no date</h2>")).otherwise(
        F.concat(F.lit("<h2>Week of "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</h2>")))
    served = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), html.alias("html"),
        F.expr("cast(o_orderdate AS date) + CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END").alias("asked"))
    return pages.served_week_guard(served, served_date(F.col("html"))).select("page_id", "asked")


@register("refuse_incomplete_ranks", with_sql(ENTRIES_SQL, """
rows AS (SELECT * FROM entries WHERE NOT (metric % 97 = 0 AND CAST(substr(chart, 6) AS INT) % 2 = 1)),
good AS (SELECT chart, date FROM rows GROUP BY 1, 2
         HAVING min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*)
            AND bool_and(metric % 89 <> 0))""") + """
SELECT chart, date, rank, title FROM rows WHERE (chart, date) IN (SELECT (chart, date) FROM good)""")
def refuse_incomplete_ranks(spark, sf):
    rows = fx.entries(spark, sf).filter("NOT (metric % 97 = 0 AND cast(substr(chart, 6) AS int) % 2 = 1)")
    return quality.refuse_incomplete_ranks(rows, ["chart", "date"], F.col("metric") % 89 != 0).select(
        "chart", "date", "rank", "title")


@register("min_depth_gate", with_sql(ENTRIES_SQL, REGISTRY_SQL) + """
SELECT chart, date, rank, title FROM entries WHERE (chart, date) IN (
  SELECT (chart, date) FROM entries LEFT JOIN (SELECT chart, depth - 6 AS floor FROM registry WHERE ord % 2 = 0) f
    USING (chart) GROUP BY chart, date, floor HAVING count(*) >= coalesce(floor, 20))""")
def min_depth_gate(spark, sf):
    floors = fx.registry(spark, sf).filter("ord % 2 = 0").select("chart", F.expr("depth - 6").alias("floor"))
    return quality.min_depth_gate(fx.entries(spark, sf), floors).select("chart", "date", "rank", "title")


@register("is_stale", with_sql(ENTRIES_SQL) + """
SELECT chart, max(date) AS latest, DATE '2001-11-12' - max(date) > 14 AS stale FROM entries GROUP BY chart""")
def is_stale(spark, sf):
    return quality.is_stale(fx.entries(spark, sf), "2001-11-12", 14)


_FROZEN_SQL = "frozen AS (SELECT chart, DATE '2001-10-29' AS until FROM registry WHERE grp = 'g0')"


def frozen(spark, sf):
    return fx.registry(spark, sf).filter("grp = 'g0'").select(
        "chart", F.lit("2001-10-29").cast("date").alias("until"))


@register("frozen_lists", with_sql(ENTRIES_SQL, REGISTRY_SQL, _FROZEN_SQL) + """
SELECT chart, until, latest, latest = until AS ok
FROM frozen JOIN (SELECT chart, max(date) AS latest FROM entries GROUP BY 1) m USING (chart)""")
def frozen_lists(spark, sf):
    return quality.frozen_lists(fx.entries(spark, sf), frozen(spark, sf))


@register("frozen_and_fresh_report", with_sql(ENTRIES_SQL, REGISTRY_SQL, _FROZEN_SQL) + """
SELECT chart, latest, CASE WHEN until IS NOT NULL THEN 'frozen' WHEN latest >= DATE '2001-10-29' THEN 'current'
       ELSE 'stale' END AS status
FROM (SELECT chart, max(date) AS latest FROM entries GROUP BY 1) m LEFT JOIN frozen USING (chart)""")
def frozen_and_fresh_report(spark, sf):
    return quality.freshness_report(fx.entries(spark, sf), frozen(spark, sf), "2001-10-29")
