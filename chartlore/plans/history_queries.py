"""Registered queries: history windows, statistics, lookups, comparisons."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlore.operators import calendar, compare, history, ingest, predict, quality, stats, titles
from chartlore.plans import fixtures as fx
from chartlore.plans.fixtures import (
    CALENDAR_SQL, ENTRIES_SQL, GAPPED_SQL, KEYED_SQL, REGISTRY_SQL, sql_primary_artist, sql_primary_credit, with_sql)
from chartlore.plans.ingest_queries import NAMES, named_sql
from chartlore.session import scratch, staged

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# --- the list page ----------------------------------------------------------

_PAGE_SQL = """
k AS (SELECT keyed.*, week_idx FROM keyed JOIN cal USING (chart, date)),
w1 AS (
  SELECT *, min(rank) OVER (run RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS last_wk,
         min(rank) OVER (run RANGE UNBOUNDED PRECEDING) AS peak,
         min(rank) OVER (run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_best,
         count(*) OVER (run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before,
         week_idx - dense_rank() OVER run AS island,
         dense_rank() OVER (PARTITION BY chart, k_title, k_artist, k_credit ORDER BY week_idx) AS exact_weeks
  FROM k WINDOW run AS (PARTITION BY chart, k_title, k_artist ORDER BY week_idx)),
w2 AS (
  SELECT *, exact_weeks + week_idx - min(week_idx) OVER (PARTITION BY chart, k_title, k_artist, island) + 1
         - dense_rank() OVER (PARTITION BY chart, k_title, k_artist, k_credit, island ORDER BY week_idx) AS weeks
  FROM w1),
page AS (
  SELECT chart, date, rank, trim(title) AS title, trim(artist) AS artist, last_wk AS last_week, peak,
         CAST(weeks AS INT) AS weeks,
         CASE WHEN last_wk IS NULL THEN CASE WHEN n_before > 0 THEN 're-entry' ELSE 'new' END
              WHEN rank < last_wk THEN 'up' WHEN rank > last_wk THEN 'down' ELSE 'same' END AS change,
         coalesce(abs(last_wk - rank), 0) AS change_amount,
         coalesce(rank < prior_best, false) AS new_peak
  FROM w2)"""
_PAGE = with_sql(ENTRIES_SQL, KEYED_SQL, CALENDAR_SQL, _PAGE_SQL)


@register("chart_page", _PAGE + """
SELECT *, concat_ws(' ', CASE WHEN change IN ('new', 're-entry') THEN change END,
                    CASE WHEN new_peak THEN 'peak' END) AS tags FROM page""")
def chart_page(spark, sf):
    return history.chart_page(fx.keyed_entries(spark, sf), partitions=fx.tasks(spark, sf)).withColumn("tags", F.array_join("tags", " "))


@register("cumulative_weeks", _PAGE + "SELECT chart, date, rank, weeks FROM page")
def cumulative_weeks(spark, sf):
    return history.chart_page(fx.keyed_entries(spark, sf), partitions=fx.tasks(spark, sf)).select("chart", "date", "rank", "weeks")


@register("chart_page_growers", _PAGE + """
SELECT chart, date, rank, title, last_week FROM page JOIN (
  SELECT chart, date, ceil(count(*) * 0.05) AS need FROM entries GROUP BY 1, 2) d USING (chart, date)
WHERE last_week - rank >= need""")
def chart_page_growers(spark, sf):
    return (history.chart_page(fx.keyed_entries(spark, sf), grower=True, partitions=fx.tasks(spark, sf)).filter("grower")
            .select("chart", "date", "rank", "title", "last_week"))


@register("chart_history_restricted", with_sql(ENTRIES_SQL, KEYED_SQL) + """
SELECT chart, date, rank, k_title, k_artist FROM keyed WHERE (chart, k_title, k_artist) IN (
  SELECT (chart, k_title, k_artist) FROM keyed
  WHERE (chart, date) IN (SELECT (chart, max(date)) FROM entries GROUP BY chart))""")
def chart_history_restricted(spark, sf):
    keyed = history.with_keys(fx.keyed_entries(spark, sf)).select("chart", "date", "rank", "k_title", "k_artist")
    last = keyed.groupBy("chart").agg(F.max("date").alias("date"))
    return ingest.restrict_history(keyed, keyed.join(last, ["chart", "date"], "left_semi"))


_HISTORY_SQL = """
SELECT chart, k_title, {artist} AS k_artist, date, rank,
       CAST(row_number() OVER (PARTITION BY chart, k_title, {artist} ORDER BY date, rank) AS INT) AS week_no,
       min(rank) OVER (PARTITION BY chart, k_title, {artist}) AS peak,
       CAST(count(*) OVER (PARTITION BY chart, k_title, {artist}) AS INT) AS total_weeks
FROM keyed"""


@register("song_history", with_sql(ENTRIES_SQL, KEYED_SQL) + _HISTORY_SQL.format(artist="k_artist"))
def song_history(spark, sf):
    return history.song_history(fx.keyed_entries(spark, sf))


@register("album_history", with_sql(ENTRIES_SQL, KEYED_SQL) + _HISTORY_SQL.format(artist="k_credit"))
def album_history(spark, sf):
    return history.song_history(fx.keyed_entries(spark, sf), exact_credit=True)


_TIMELINE_SQL = """
timeline AS (
  SELECT chart, k_artist AS artist_key, date, min(rank) AS rank, trim(arg_min(title, rank)) AS title
  FROM keyed GROUP BY 1, 2, 3)"""


@register("artist_timeline", with_sql(ENTRIES_SQL, KEYED_SQL, _TIMELINE_SQL) + "SELECT * FROM timeline")
def artist_timeline(spark, sf):
    return history.artist_timeline(fx.entries(spark, sf))


@register("gap_segments", with_sql(ENTRIES_SQL, KEYED_SQL, _TIMELINE_SQL, """
seg AS (SELECT *, sum(opens) OVER (PARTITION BY chart, artist_key ORDER BY date) AS segment FROM (
  SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY chart, artist_key ORDER BY date) <= 10 THEN 0 ELSE 1 END
         AS opens FROM timeline) t)""") + """
SELECT chart, artist_key, date, rank, CAST(segment AS INT) AS segment,
       count(*) OVER (PARTITION BY chart, artist_key, segment) = 1 AS isolated FROM seg""")
def gap_segments(spark, sf):
    points = history.artist_timeline(fx.entries(spark, sf)).drop("title")
    return history.gap_segments(points, ["chart", "artist_key"])


@register("gap_markers", with_sql(ENTRIES_SQL, KEYED_SQL, """
days AS (SELECT DISTINCT chart, k_artist, date FROM keyed),
step AS (SELECT *, lead(date) OVER (PARTITION BY chart, k_artist ORDER BY date) AS nxt FROM days)""") + """
SELECT chart, k_artist, date, false AS is_gap FROM step
UNION ALL SELECT chart, k_artist, date, true FROM step WHERE nxt - date > 7""")
def gap_markers(spark, sf):
    days = history.with_keys(fx.keyed_entries(spark, sf)).select("chart", "k_artist", "date").distinct()
    return history.gap_markers(days, ["chart", "k_artist"])


def _reign_sql(broken: str) -> str:
    return with_sql(ENTRIES_SQL, CALENDAR_SQL, f"""
ones AS (SELECT chart, date, trim(title) AS title, trim(artist) AS artist, week_idx FROM entries
         JOIN cal USING (chart, date) WHERE rank = 1),
marked AS (SELECT *, CASE WHEN {broken} THEN 1 ELSE 0 END AS broken FROM (
  SELECT *, lag(title) OVER w AS lt, lag(artist) OVER w AS la, lag(week_idx) OVER w AS li FROM ones
  WINDOW w AS (PARTITION BY chart ORDER BY date DESC)) t),
runs AS (SELECT *, sum(broken) OVER (PARTITION BY chart ORDER BY date DESC) AS run FROM marked)""") + """
SELECT chart, max(title) AS title, max(artist) AS artist, CAST(count(*) AS INT) AS weeks, min(date) AS since
FROM runs WHERE run = 0 GROUP BY chart"""


@register("reign", _reign_sql("lt <> title OR la <> artist"))
def reign(spark, sf):
    return history.reign(fx.entries(spark, sf), weeks=fx.weeks(spark, sf))


@register("reign_stop_at_gap", _reign_sql("lt <> title OR la <> artist OR li - week_idx > 1"))
def reign_stop_at_gap(spark, sf):
    return history.reign(fx.entries(spark, sf), stop_at_gap=True, weeks=fx.weeks(spark, sf))


# --- statistics -------------------------------------------------------------

def stats_sql(source: str, by: str) -> str:
    """CTE `stats` over a keyed relation with a kind column."""
    return f"""
pt AS (SELECT chart, {by}, kind, k_title, k_artist AS ka, min(rank) AS peak, count(*) AS weeks,
              count(*) FILTER (rank = 1) AS at1, min(date) AS f, max(date) AS l,
              arg_min(title, (date, rank, title)) AS title
       FROM {source} GROUP BY ALL),
stats AS (SELECT chart, {by}, kind,
  CASE WHEN kind <> 'artist' THEN CAST(count(*) AS INT) END AS entries,
  CASE WHEN kind <> 'artist' THEN CAST(count(*) FILTER (peak = 1) AS INT) END AS number_ones,
  CAST(sum(at1) AS INT) AS weeks_at_1,
  CASE WHEN kind <> 'artist' THEN CAST(count(*) FILTER (peak <= 10) AS INT) END AS top_10s,
  CASE WHEN kind <> 'artist' THEN CAST(count(*) FILTER (peak <= 40) AS INT) END AS top_40s,
  min(peak) AS best_peak,
  (SELECT CAST(count(DISTINCT date) AS INT) FROM {source} s WHERE s.chart = pt.chart AND s.{by} = pt.{by})
    AS total_weeks_charted,
  min(f) AS first_entry, max(l) AS last_entry,
  CASE WHEN kind <> 'artist' THEN trim(arg_min(title, (peak, -weeks, title))) END AS biggest_hit
  FROM pt GROUP BY chart, {by}, kind)"""


_KINDED_SQL = "kinded AS (SELECT k.*, kind FROM keyed k JOIN registry USING (chart))"
_NAMED_KEYED_SQL = f"""
nkeyed AS (SELECT named.*, lower(trim(title)) AS k_title, pa AS k_artist, kind FROM named
  JOIN (SELECT artist AS a0, {sql_primary_artist('artist')} AS pa
        FROM (SELECT DISTINCT artist FROM entries) d) c ON artist = a0
  JOIN registry USING (chart))"""
_STATS_LIST = ("entries, number_ones, weeks_at_1, top_10s, top_40s, best_peak, total_weeks_charted, first_entry, "
               "last_entry, biggest_hit")


def kinded(spark, sf):
    return fx.keyed_entries(spark, sf).join(fx.registry(spark, sf).select("chart", "kind"), "chart")


@register("artist_stats", with_sql(ENTRIES_SQL, REGISTRY_SQL, KEYED_SQL, _KINDED_SQL, stats_sql("kinded", "k_artist"))
          + f"SELECT chart, k_artist, kind, {_STATS_LIST} FROM stats")
def artist_stats(spark, sf):
    return stats.artist_stats(kinded(spark, sf))


_COVERAGE = with_sql(ENTRIES_SQL, REGISTRY_SQL, named_sql(), _NAMED_KEYED_SQL, stats_sql("nkeyed", "name"), f"""
coverage AS (SELECT name, chart, label, grp, depth, ord, stats.kind AS kind, {_STATS_LIST},
  CAST((SELECT count(*) FROM registry) - count(*) OVER (PARTITION BY name) AS INT) AS hidden
  FROM stats JOIN registry USING (chart))""")


@register("artist_coverage", _COVERAGE + "SELECT * FROM coverage")
def artist_coverage(spark, sf):
    return stats.artist_coverage(fx.entries(spark, sf), fx.registry(spark, sf), NAMES)


@register("default_chart", _COVERAGE + """
SELECT name, arg_max(chart, (total_weeks_charted, coalesce(entries, 0), -ord)) AS chart FROM coverage GROUP BY name""")
def default_chart(spark, sf):
    return stats.default_chart(stats.artist_coverage(fx.entries(spark, sf), fx.registry(spark, sf), NAMES))


_SHOWN = (f"shown AS (SELECT name, arg_max(pc, (n, k)) AS shown FROM ("
          f"SELECT name, pc, count(*) AS n, -row_number() OVER (PARTITION BY name ORDER BY pc) AS k FROM ("
          f"SELECT name, {sql_primary_credit('artist')} AS pc FROM nkeyed WHERE k_artist = lower(name)) t "
          f"GROUP BY name, pc) u GROUP BY name)")


@register("display_name", with_sql(ENTRIES_SQL, REGISTRY_SQL, named_sql(), _NAMED_KEYED_SQL, _SHOWN)
          + "SELECT name, shown FROM shown")
def display_name(spark, sf):
    return stats.display_names(stats.artist_rows(fx.entries(spark, sf), NAMES))


_VERSUS_SQL = with_sql(
    ENTRIES_SQL, REGISTRY_SQL, named_sql(),
    _NAMED_KEYED_SQL.replace("FROM named", "FROM (SELECT * FROM named WHERE chart = 'list_0') named"),
    stats_sql("nkeyed", "name"), _SHOWN,
    "asked AS (SELECT unnest(" + str(NAMES) + ") AS name, unnest([0, 1, 2, 3, 4]) AS pos)",
    """versus AS (SELECT name, CAST(pos AS INT) AS pos, coalesce(shown, name) AS display_name,
       coalesce(entries, 0) AS entries, coalesce(number_ones, 0) AS number_ones, coalesce(weeks_at_1, 0) AS weeks_at_1,
       coalesce(top_10s, 0) AS top_10s, coalesce(top_40s, 0) AS top_40s, best_peak,
       coalesce(total_weeks_charted, 0) AS total_weeks_charted, first_entry, last_entry, biggest_hit
  FROM asked LEFT JOIN stats USING (name) LEFT JOIN shown USING (name))""")


@register("versus", _VERSUS_SQL + "SELECT * FROM versus")
def versus(spark, sf):
    return stats.versus(fx.entries(spark, sf), "list_0", NAMES)


_CELLS_SQL = """cells AS (UNPIVOT (SELECT name, CAST(entries AS DOUBLE) AS entries, CAST(number_ones AS DOUBLE) AS number_ones,
  CAST(weeks_at_1 AS DOUBLE) AS weeks_at_1, CAST(best_peak AS DOUBLE) AS best_peak FROM versus)
  ON entries, number_ones, weeks_at_1, best_peak INTO NAME stat VALUE value)"""


@register("scorecard_best", _VERSUS_SQL.rstrip() + ",\n" + _CELLS_SQL + """
SELECT stat, name, value, value = CASE WHEN stat = 'best_peak' THEN min(value) OVER (PARTITION BY stat)
       ELSE max(value) OVER (PARTITION BY stat) END AS best FROM cells""")
def scorecard_best(spark, sf):
    cols = ["entries", "number_ones", "weeks_at_1", "best_peak"]
    cells = (stats.versus(fx.entries(spark, sf), "list_0", NAMES)
             .select("name", *[F.col(c).cast("double").alias(c) for c in cols])
             .unpivot(["name"], cols, "stat", "value").filter("value IS NOT NULL"))
    return stats.scorecard_best(cells, {"best_peak": "low", **{c: "high" for c in cols[:3]}})


@register("report_titles", with_sql(ENTRIES_SQL, REGISTRY_SQL, named_sql(), """
t AS (SELECT name, chart, lower(trim(title)) AS k, trim(title) AS title, artist, date, rank FROM named),
mt AS (SELECT name, chart, k, title FROM (SELECT name, chart, k, title,
  row_number() OVER (PARTITION BY name, chart, k ORDER BY count(*) DESC, title) AS n FROM t GROUP BY name, chart, k, title) x WHERE n = 1),
ma AS (SELECT name, chart, k, artist FROM (SELECT name, chart, k, artist,
  row_number() OVER (PARTITION BY name, chart, k ORDER BY count(*) DESC, artist) AS n FROM t GROUP BY name, chart, k, artist) x WHERE n = 1)""")
          + """
SELECT name, chart, mt.title AS title, ma.artist AS artist, first_date, weeks, peak, peak = 1 AS is_number_one
FROM (SELECT name, chart, k, min(date) AS first_date, CAST(count(DISTINCT date) AS INT) AS weeks, min(rank) AS peak
      FROM t GROUP BY ALL) a JOIN mt USING (name, chart, k) JOIN ma USING (name, chart, k)""")
def report_titles(spark, sf):
    return stats.report_titles(stats.artist_rows(fx.entries(spark, sf), NAMES), ["name", "chart"])


@register("series_map", with_sql(ENTRIES_SQL, KEYED_SQL) + """
SELECT chart, k_artist, lower(trim(title)) AS k_title,
       string_agg(p, ',' ORDER BY date, rank) AS points
FROM (SELECT DISTINCT chart, k_artist, title, date, rank, date || ' ' || rank AS p FROM keyed) k GROUP BY ALL""")
def series_map(spark, sf):
    s = stats.series_map(history.with_keys(fx.keyed_entries(spark, sf)), ["chart", "k_artist"])
    return s.select("chart", "k_artist", F.explode("series").alias("t", "p")).select(
        "chart", "k_artist", F.lower("t").alias("k_title"), F.array_join(
            F.transform("p", lambda x: F.concat_ws(" ", x["date"], x["rank"])), ",").alias("points"))


@register("modern_artist_summary", with_sql(ENTRIES_SQL, """
pt AS (SELECT chart, lower(trim(artist)) AS k_credit, title, min(rank) AS peak, count(*) AS n, min(date) AS f, max(date) AS l
       FROM entries WHERE date >= DATE '1998-01-01' GROUP BY ALL),
s AS (SELECT chart, k_credit, CAST(count(*) AS INT) AS total_songs, CAST(sum(n) AS INT) AS total_weeks, min(peak) AS peak,
             CAST(count(*) FILTER (peak = 1) AS INT) AS number_ones, CAST(count(*) FILTER (peak <= 10) AS INT) AS top_10s,
             strftime(min(f), '%B %Y') AS first_month, strftime(max(l), '%B %Y') AS last_month FROM pt GROUP BY ALL)""") + """
SELECT *, concat_ws(' • ',
  CASE WHEN number_ones > 0 THEN 'Top List chart-topper with ' || number_ones || ' #1 hit' ||
            CASE WHEN number_ones > 1 THEN 's' ELSE '' END
       WHEN top_10s >= 5 THEN 'Top List artist with ' || top_10s || ' top 10 hits' ELSE 'Top List charting artist' END,
  total_songs || ' songs charted for ' || total_weeks || ' total weeks',
  CASE WHEN first_month <> last_month THEN 'Charting from ' || first_month || ' to ' || last_month
       ELSE 'First charted in ' || first_month END) AS description FROM s""")
def modern_artist_summary(spark, sf):
    return stats.modern_artist_summary(fx.entries(spark, sf), "1998-01-01", "Top List")


_SOLO = " AND ".join(f"NOT contains(lower(artist), '{m}')" for m in
                     (" featuring ", " feat. ", " feat ", " with ", " x ", " & ", " + ", " duet ", " / "))


@register("artist_pool", with_sql(ENTRIES_SQL) + f"""
SELECT DISTINCT chart, trim(artist) AS artist FROM entries WHERE {_SOLO}""")
def artist_pool(spark, sf):
    return stats.artist_pool(fx.entries(spark, sf), ["chart"])


@register("all_artists", with_sql(ENTRIES_SQL) + f"SELECT DISTINCT trim(artist) AS artist FROM entries WHERE {_SOLO}")
def all_artists(spark, sf):
    return stats.artist_pool(fx.entries(spark, sf))


@register("modern_artists", with_sql(ENTRIES_SQL) + f"""
SELECT DISTINCT trim(artist) AS artist FROM entries WHERE date >= DATE '1998-01-01' AND {_SOLO}""")
def modern_artists(spark, sf):
    return stats.artist_pool(fx.entries(spark, sf), floor="1998-01-01")


@register("artist_prefix", with_sql(ENTRIES_SQL) + f"""
SELECT DISTINCT trim(artist) AS artist FROM entries WHERE {_SOLO} AND starts_with(lower(trim(artist)), 'r')
ORDER BY 1 LIMIT 50""")
def artist_prefix(spark, sf):
    return stats.artist_prefix(stats.artist_pool(fx.entries(spark, sf), ["chart"]), "R")


@register("top_artists", with_sql(ENTRIES_SQL) + """
SELECT artist, CAST(sum(metric) AS BIGINT) AS listeners FROM entries GROUP BY artist ORDER BY 2 DESC, 1 LIMIT 50""")
def top_artists(spark, sf):
    ranked = fx.entries(spark, sf).groupBy("artist").agg(F.sum("metric").alias("listeners"))
    return stats.top_artists(ranked, 99)


def _number_one_sql(extra: str) -> str:
    return with_sql(ENTRIES_SQL) + f"""
SELECT t.chart, t.date, trim(t.title) AS title, trim(t.artist) AS artist,
       CAST((SELECT count(*) FROM entries e WHERE e.chart = t.chart AND trim(e.title) = trim(t.title)
             AND trim(e.artist) = trim(t.artist) {extra}) AS INT) AS weeks
FROM entries t WHERE rank = 1 AND date = (SELECT max(date) FROM entries m WHERE m.chart = t.chart)"""


@register("current_number_one", _number_one_sql(""))
def current_number_one(spark, sf):
    return stats.current_number_one(fx.entries(spark, sf))


@register("current_number_one_weeks_at_1", _number_one_sql("AND e.rank = 1"))
def current_number_one_weeks_at_1(spark, sf):
    return stats.current_number_one(fx.entries(spark, sf), weeks_at_1=True)


@register("version_rollup", """
WITH s AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) || ' (Remix)' WHEN 1 THEN p_name || ' [feat. X]'
  ELSE p_name END AS title, CAST(l_quantity AS BIGINT) AS streams,
  CASE WHEN l_linenumber % 4 <> 3 THEN l_orderkey % 10 END AS daily FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT trim(regexp_replace(lower(trim(title)), '\\s*[\\(\\[].*?[\\)\\]]\\s*', ' ', 'g')) AS base,
       CAST(sum(streams) AS BIGINT) AS streams, CAST(sum(daily) AS BIGINT) AS daily FROM s GROUP BY 1""")
def version_rollup(spark, sf):
    s = fx.table(spark, sf, "lineitem").join(
        fx.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").selectExpr(
        "CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) || ' (Remix)' WHEN 1 THEN p_name || ' [feat. X]' "
        "ELSE p_name END AS title", "CAST(l_quantity AS BIGINT) AS streams",
        "CASE WHEN l_linenumber % 4 <> 3 THEN l_orderkey % 10 END AS daily")
    return stats.version_rollup(s)


# --- the title index --------------------------------------------------------

_INDEX_SQL = """
tindex AS (SELECT k_title, k_artist, trim(arg_min(title, (date, rank, title, artist))) AS display,
  trim(arg_min(artist, (date, rank, title, artist))) AS credit, min(rank) AS peak,
  CAST(count(DISTINCT date) AS INT) AS weeks, min(date) AS debut, chart, label, kind
  FROM keyed JOIN registry USING (chart) WHERE kind <> 'artist' GROUP BY k_title, k_artist, chart, label, kind)"""
_INDEX = with_sql(ENTRIES_SQL, REGISTRY_SQL, KEYED_SQL, _INDEX_SQL)


def index(spark, sf):
    return titles.title_index(fx.keyed_entries(spark, sf), fx.registry(spark, sf))


_VERSIONS: dict[tuple[str, str], str] = {}


def stored_index(spark, sf):
    """The saved index of the stored history, built if that version has none. The
    history doesn't change within a session, so its version is worked out once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VERSIONS:
        _VERSIONS[key] = titles.history_version(fx.entries(spark, sf))
    found = titles.stored_title_index(spark, "titles", _VERSIONS[key])
    if found is None:
        titles.save_title_index(index(spark, sf), "titles", _VERSIONS[key], scratch(spark, "title-index"), 8)
        found = titles.stored_title_index(spark, "titles", _VERSIONS[key])
    return found


@register("title_index", _INDEX + "SELECT * FROM tindex")
def title_index(spark, sf):
    return index(spark, sf)


@register("crossovers", _INDEX.rstrip() + """,
org AS (SELECT k_title, k_artist, kind, arg_min(chart, (debut, chart)) AS origin, min(debut) AS origin_debut
        FROM tindex GROUP BY 1, 2, 3)
SELECT k_title, k_artist, kind, origin, chart, label, debut, peak, weeks, debut > origin_debut AS later
FROM org JOIN tindex USING (k_title, k_artist, kind) WHERE chart <> origin""")
def crossovers(spark, sf):
    return titles.all_crossovers(stored_index(spark, sf).by_title)


# The first list of every 'gear' title asks for the others.
@register("crossovers_asked", _INDEX.rstrip() + """,
org AS (SELECT k_title, k_artist, kind, arg_min(chart, (debut, chart)) AS origin, min(debut) AS origin_debut
        FROM tindex WHERE starts_with(k_title, 'ge') GROUP BY 1, 2, 3)
SELECT k_title, k_artist, kind, origin, chart, label, debut, peak, weeks, debut > origin_debut AS later
FROM org JOIN tindex USING (k_title, k_artist, kind) WHERE chart <> origin""")
def crossovers_asked(spark, sf):
    idx = stored_index(spark, sf)
    asked = titles.origins(idx.by_letter.filter("letter = 'g' AND startswith(k_title, 'ge')"))
    return titles.crossovers(idx.by_title, asked)


@register("title_lookup", _INDEX + """
SELECT chart, label, debut, peak, weeks, debut > DATE '1995-06-05' AS later FROM tindex
WHERE k_title = 'gear' AND k_artist = 'red 0' AND kind = 'song' AND chart <> 'list_0'""")
def title_lookup(spark, sf):
    return titles.lookup(stored_index(spark, sf).by_title, " Gear", "RED 0 feat. Guest", "song", "list_0", "1995-06-05")


@register("title_pool", _INDEX + """
SELECT DISTINCT display FROM tindex WHERE kind = 'song' AND starts_with(k_title, 'r') ORDER BY 1 LIMIT 50""")
def title_pool(spark, sf):
    return titles.title_pool(stored_index(spark, sf).by_letter, "song", "R")


@register("suggest", _INDEX + """
SELECT arg_min(display, (debut, chart)) AS title, arg_min(credit, (debut, chart)) AS credit, k_artist AS artist,
       CAST(count(*) AS INT) AS charts
FROM tindex WHERE kind = 'song' AND starts_with(k_title, 'g') GROUP BY k_title, k_artist
ORDER BY charts DESC, k_title, k_artist LIMIT 20""")
def suggest(spark, sf):
    return titles.suggest(stored_index(spark, sf).by_letter, "song", "g")


@register("fill_image", with_sql(ENTRIES_SQL, KEYED_SQL, """
img AS (SELECT k_title, k_artist, arg_min(image_url, (chart, date, rank)) AS found FROM keyed
        WHERE starts_with(image_url, 'http') GROUP BY 1, 2)""") + """
SELECT chart, date, rank, CASE WHEN starts_with(image_url, 'http') THEN image_url ELSE coalesce(found, '') END AS image_url
FROM keyed LEFT JOIN img USING (k_title, k_artist)""")
def fill_image(spark, sf):
    e = fx.keyed_entries(spark, sf)
    return titles.fill_image(e, titles.image_index(e)).select("chart", "date", "rank", "image_url")


# --- week against week ------------------------------------------------------

_DROP_SQL = """
dk AS (SELECT e.*, kind, lower(trim(title)) AS kt, CASE WHEN kind <> 'artist' THEN lower(trim(artist)) ELSE '' END AS kc,
              next_date FROM entries e JOIN registry USING (chart) JOIN cal USING (chart, date)),
there AS (SELECT DISTINCT chart, date, kt, kc FROM dk),
dropped AS (SELECT a.chart, next_date AS current_week, a.date AS previous_week, title,
  CASE WHEN kind <> 'artist' THEN artist END AS artist, rank, weeks_on_chart AS weeks
  FROM dk a LEFT JOIN there b ON b.chart = a.chart AND b.date = a.next_date AND b.kt = a.kt AND b.kc = a.kc
  WHERE next_date IS NOT NULL AND b.chart IS NULL)"""
_DROP = with_sql(ENTRIES_SQL, REGISTRY_SQL, CALENDAR_SQL, _DROP_SQL)


@register("dropouts", _DROP + "SELECT * FROM dropped")
def dropouts(spark, sf):
    return compare.dropouts(fx.entries(spark, sf), fx.registry(spark, sf), fx.weeks(spark, sf))


@register("dropouts_on", _DROP + """
SELECT * FROM dropped WHERE chart = 'list_0' AND current_week = (SELECT max(date) FROM entries WHERE chart = 'list_0')""")
def dropouts_on(spark, sf):
    return compare.dropouts_on(fx.entries(spark, sf), fx.registry(spark, sf), "list_0")


@register("recurrents", _DROP + "SELECT * FROM dropped WHERE weeks >= 20 AND rank > 25")
def recurrents(spark, sf):
    return compare.recurrents(compare.dropouts(fx.entries(spark, sf), fx.registry(spark, sf), fx.weeks(spark, sf)))


_WOW_SQL = """
wow AS (SELECT a.chart, a.date, trim(a.title) AS title, trim(a.artist) AS artist, a.rank, b.rank AS was
        FROM entries a JOIN cal USING (chart, date) LEFT JOIN entries b ON b.chart = a.chart AND b.date = cal.prev_date
             AND trim(b.title) = trim(a.title) AND trim(b.artist) = trim(a.artist))"""


@register("week_over_week", with_sql(ENTRIES_SQL, CALENDAR_SQL, _WOW_SQL)
          + "SELECT chart, date, title, artist, rank, min(was) AS was, min(was) - rank AS gain "
          "FROM wow GROUP BY chart, date, title, artist, rank")
def week_over_week(spark, sf):
    return compare.week_over_week(fx.entries(spark, sf), fx.weeks(spark, sf))


LEADS = ["list_4", "list_2"]
_NEWS_SQL = """
latest AS (SELECT max(date) AS d FROM entries),
now AS (SELECT w.chart, label, kind, ord, w.date AS week, title, artist, min(rank) AS rank, min(was) AS was, prev_date
        FROM wow w JOIN cal USING (chart, date) JOIN registry USING (chart)
        WHERE w.date = (SELECT d FROM latest) AND prev_date IS NOT NULL GROUP BY ALL),
before AS (SELECT n.chart, trim(e.title) AS was_title, trim(e.artist) AS was_artist
           FROM (SELECT DISTINCT chart, prev_date FROM now) n JOIN entries e ON e.chart = n.chart AND e.date = n.prev_date
           WHERE e.rank = 1),
news AS (
  SELECT 'new_one' AS section, week, chart, label, kind, title, artist, rank, was, was_title, was_artist,
         row_number() OVER (ORDER BY CASE chart WHEN 'list_4' THEN 0 WHEN 'list_2' THEN 1 ELSE 2 END, label, ord, title) AS place
  FROM now JOIN before USING (chart) WHERE rank = 1 AND (title <> was_title OR artist <> was_artist)
  UNION ALL
  SELECT 'climb', week, chart, label, kind, title, artist, rank, was, NULL, NULL,
         row_number() OVER (ORDER BY rank - was, ord, title || '|' || artist) FROM now WHERE was - rank >= 5
  UNION ALL
  SELECT 'entry', week, chart, label, kind, title, artist, rank, was, NULL, NULL,
         row_number() OVER (ORDER BY rank, ord, title || '|' || artist) FROM now WHERE was IS NULL)"""
_NEWS = with_sql(ENTRIES_SQL, REGISTRY_SQL, CALENDAR_SQL, _WOW_SQL, _NEWS_SQL)


@register("weekly_news", _NEWS + """
SELECT section, week, chart, label, kind, title, artist, rank, was, was_title, was_artist, CAST(place AS INT) AS place,
       CAST(total AS INT) AS total
FROM news JOIN (SELECT section, count(*) AS total FROM news GROUP BY 1) t USING (section) WHERE place <= 6""")
def weekly_news(spark, sf):
    return compare.weekly_news(fx.entries(spark, sf), fx.registry(spark, sf), LEADS, min_climb=5,
                               weeks=fx.weeks(spark, sf))


@register("news_cuts", with_sql(ENTRIES_SQL) + """
SELECT chart AS section, date, rank, title, CAST(place AS INT) AS place, CAST(total AS INT) AS total FROM (
  SELECT chart, date, rank, title, row_number() OVER (PARTITION BY chart ORDER BY metric DESC, date, rank) AS place,
         count(*) OVER (PARTITION BY chart) AS total FROM entries) t WHERE place <= 6""")
def news_cuts(spark, sf):
    rows = fx.entries(spark, sf).select(
        F.col("chart").alias("section"), "date", "rank", "title",
        F.struct((-F.col("metric")).alias("a"), F.col("date").alias("b"), F.col("rank").alias("c")).alias("pos"))
    return compare.news_cuts(rows)


@register("charts_covered", with_sql(ENTRIES_SQL) + """
SELECT date, CAST(count(*) AS INT) AS charts_covered FROM (SELECT chart, max(date) AS date FROM entries GROUP BY 1) m
GROUP BY date ORDER BY date DESC LIMIT 1""")
def charts_covered(spark, sf):
    return compare.charts_covered(fx.entries(spark, sf))


_GCAL_SQL = """
gcal AS (SELECT chart, date, lag(date) OVER (PARTITION BY chart ORDER BY date) AS prev_date
         FROM (SELECT DISTINCT chart, date FROM gapped) d),
gw AS (SELECT chart, date, title, artist, max(weeks_on_chart) AS n FROM gapped GROUP BY ALL),
deltas AS (SELECT a.chart, prev_date, a.date, a.title, a.artist, a.n - b.n AS delta
           FROM gw a JOIN gcal USING (chart, date)
           JOIN gw b ON b.chart = a.chart AND b.date = gcal.prev_date AND b.title = a.title AND b.artist = a.artist),
gaps AS (SELECT chart, prev_date, date, elapsed FROM (
  SELECT chart, prev_date, date, delta AS elapsed, sum(count(*)) OVER (PARTITION BY chart, date) AS shared,
         row_number() OVER (PARTITION BY chart, date ORDER BY count(*) DESC, delta) AS n
  FROM deltas GROUP BY chart, prev_date, date, delta) t WHERE n = 1 AND shared >= 3 AND elapsed <> 1)"""
_GAPS = with_sql(ENTRIES_SQL, GAPPED_SQL, _GCAL_SQL)


@register("shared_titles_delta", _GAPS + "SELECT * FROM deltas")
def shared_titles_delta(spark, sf):
    return compare.shared_title_deltas(fx.gapped(fx.entries(spark, sf)))


@register("shared_keys", _GAPS + "SELECT chart, prev_date, date, CAST(count(*) AS INT) AS shared FROM deltas GROUP BY 1, 2, 3")
def shared_keys(spark, sf):
    d = compare.shared_title_deltas(fx.gapped(fx.entries(spark, sf)))
    return d.groupBy("chart", "prev_date", "date").agg(F.count("*").cast("int").alias("shared"))


@register("week_gaps", _GAPS + "SELECT * FROM gaps")
def week_gaps(spark, sf):
    return quality.week_gaps(fx.gapped(fx.entries(spark, sf)), 3)


@register("date_defects", _GAPS + """
SELECT *, date - prev_date AS days FROM gaps WHERE (date - prev_date) / 7.0 <> elapsed""")
def date_defects(spark, sf):
    return quality.date_defects(fx.gapped(fx.entries(spark, sf)), 3)


@register("missing_weeks", with_sql(ENTRIES_SQL, GAPPED_SQL, """
seg AS (SELECT chart, min(date) AS first, max(date) AS last FROM entries GROUP BY 1),
expected AS (SELECT chart, CAST(unnest(generate_series(first, last, INTERVAL 7 DAY)) AS DATE) AS date FROM seg)""") + """
SELECT chart, date FROM expected
WHERE NOT (date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') AND (chart, date) NOT IN (SELECT (chart, date) FROM gapped)
UNION SELECT chart, DATE '1994-07-04' FROM seg""")
def missing_weeks(spark, sf):
    e = fx.entries(spark, sf)
    seg = e.groupBy("chart").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    day = lambda s: F.lit(s).cast("date")
    gaps = seg.select("chart", day("1997-01-01").alias("first"), day("1997-06-30").alias("last"))
    extra = seg.select("chart", day("1994-07-04").alias("date"))
    return calendar.missing_weeks(fx.gapped(e), seg, gaps, extra)


@register("calendar_minus_have", with_sql(ENTRIES_SQL, GAPPED_SQL) + """
SELECT DISTINCT chart, date FROM entries EXCEPT SELECT chart, date FROM gapped""")
def calendar_minus_have(spark, sf):
    e = fx.entries(spark, sf)
    return e.select("chart", "date").subtract(fx.gapped(e).select("chart", "date"))


@register("weeks_list", with_sql(ENTRIES_SQL, CALENDAR_SQL) + "SELECT chart, date FROM cal WHERE prev_date IS NOT NULL")
def weeks_list(spark, sf):
    return calendar.weeks_list(fx.entries(spark, sf))


@register("union_dates", with_sql(ENTRIES_SQL, named_sql()) + "SELECT DISTINCT date FROM named")
def union_dates(spark, sf):
    return calendar.union_dates(stats.artist_rows(fx.entries(spark, sf), NAMES))


# --- the next number one ------------------------------------------------------

_NEXT_SQL = """
nk AS (SELECT keyed.chart, keyed.date, rank, k_title, k_artist, week_idx FROM keyed JOIN cal USING (chart, date)),
nw AS (
  SELECT *, min(rank) OVER (run RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS here, min(rank) OVER (run RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b1,
         min(rank) OVER (run RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS b2, min(rank) OVER (run RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS b3,
         min(rank) OVER (run RANGE UNBOUNDED PRECEDING) AS peak, min(rank) OVER (run RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS nxt,
         CAST(dense_rank() OVER run AS INT) AS weeks
  FROM nk WINDOW run AS (PARTITION BY chart, k_title, k_artist ORDER BY week_idx)),
no AS (SELECT *, CASE WHEN rank = 1 AND coalesce(b1, 0) <> 1 THEN week_idx END AS opens FROM nw WHERE rank = here),
ns AS (SELECT *, max(opens) OVER (PARTITION BY chart, k_title, k_artist ORDER BY week_idx) AS start FROM no),
nf AS (
  SELECT chart, date, k_title, k_artist, rank, round(ln(rank), 9) AS log_rank, coalesce(b1 - rank, 0) AS rise_1, coalesce(b2 - rank, 0) AS rise_2,
         coalesce(b3 - rank, 0) AS rise_3, CAST(b1 IS NULL AS INT) AS absent_1, weeks, peak, CAST(weeks = 1 AS INT) AS is_debut,
         CAST(rank = 1 AS INT) AS is_incumbent, CASE WHEN rank = 1 THEN week_idx - start + 1 ELSE 0 END AS held,
         CASE WHEN week_idx < max(week_idx) OVER (PARTITION BY chart) THEN CAST(coalesce(nxt, 0) = 1 AS INT) END AS label
  FROM ns WHERE rank <= 20)"""


@register("next_week_candidates", with_sql(ENTRIES_SQL, KEYED_SQL, CALENDAR_SQL, _NEXT_SQL) + """
SELECT chart, date, k_title, k_artist, rank, log_rank, rise_1, rise_2, rise_3, absent_1, weeks, peak, is_debut, is_incumbent, CAST(held AS INT) AS held,
       coalesce(max(CASE WHEN rank = 1 THEN rise_1 END) OVER (PARTITION BY chart, date), 0) AS incumbent_rise, label FROM nf""")
def next_week_candidates(spark, sf):
    return predict.next_week_candidates(fx.keyed_entries(spark, sf), partitions=fx.tasks(spark, sf))


@register("next_number_one")
def next_number_one(spark, sf):
    found = staged(next_week_candidates(spark, sf), "candidates")
    model = predict.fit_next_number_one(found, "1997-01-01")
    return predict.predicted(model, found).select("chart", "date", "k_title", "k_artist", F.round("probability", 6).alias("probability"))
