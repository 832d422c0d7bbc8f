"""Artist statistics, in two levels: per title, then per artist.

Both levels aggregate map-side, so an artist or title holding a large share of
the rows costs its distinct titles and weeks, not its rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.credits import (
    credit_words, is_solo_name, names_artist, names_artist_col, primary_artist, primary_credit, word_runs)
from chartlore.functions.text import match_key, version_base
from chartlore.operators.history import with_keys

STAT_COLUMNS = ["entries", "number_ones", "weeks_at_1", "top_10s", "top_40s", "best_peak",
                "total_weeks_charted", "first_entry", "last_entry", "biggest_hit"]
# On artist lists these would only ever read 0 or 1.
ARTIST_KIND_NULLS = ["entries", "biggest_hit", "number_ones", "top_10s", "top_40s"]
ZERO_STATS = ["entries", "number_ones", "weeks_at_1", "top_10s", "top_40s", "total_weeks_charted"]


FEW_NAMES = 16


def named_credits(credits: DataFrame, names: DataFrame) -> DataFrame:
    """(artist, name) for every distinct credit and every name in it.

    Credits and names meet on runs of words, an equi-join whose plan is the same
    for any number of names; the pattern then checks the few that meet. A name
    without words meets every credit, by the empty run.
    """
    asked = names.select("name").distinct().withColumn("_words", credit_words(F.col("name")))
    longest = asked.agg(F.max(F.size("_words"))).first()[0] or 1
    asked = asked.select("name", F.array_join("_words", " ").alias("_run"))
    shown = credits.select("artist").distinct().filter("artist IS NOT NULL")
    runs = shown.withColumn("_run", F.explode(word_runs(credit_words(F.col("artist")), max(1, longest))))
    return runs.join(asked, "_run").filter(names_artist_col(F.col("artist"), F.col("name"))).select("artist", "name")


def artist_rows_of(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Rows naming any of the artists in `names` (name), however many these are,
    once per artist named. Names are looked up once per distinct credit."""
    found = named_credits(entries, names).groupBy("artist").agg(F.collect_list("name").alias("_names"))
    return entries.join(found, "artist").withColumn("name", F.explode("_names")).select(*entries.columns, "name")


def artist_rows(entries: DataFrame, names: list[str]) -> DataFrame:
    """Rows naming any of the artists, once per artist named (column `name`). A
    few names are tested on each row as it is read; more are joined."""
    if len(names) > FEW_NAMES:
        return artist_rows_of(entries, names_table(entries.sparkSession, list(dict.fromkeys(names))))
    named = F.array_compact(F.array(*[
        F.when(names_artist(F.col("artist"), n), F.lit(n)) for n in names]))
    return entries.withColumn("name", F.explode(named))


def artist_stats(entries: DataFrame, by: str = "k_artist", kind: str | None = "kind") -> DataFrame:
    """Statistics per (chart, `by`). Entries should be cleaned; `kind` names the
    column telling artist lists from the rest, None when there is none."""
    keyed = with_keys(entries).filter("rank IS NOT NULL AND date IS NOT NULL")
    kinds = [kind] if kind else []
    title_keys = dict.fromkeys(["chart", by, "k_title", "k_artist", *kinds])
    per_title = keyed.groupBy(*title_keys).agg(
        F.min("rank").alias("peak"), F.count("*").alias("weeks"),
        F.count_if(F.col("rank") == 1).alias("at_1"),
        F.min("date").alias("first"), F.max("date").alias("last"), F.collect_set("date").alias("dates"),
        F.min_by("title", F.struct("date", "rank", "title")).alias("title"))
    i = "int"
    stats = per_title.groupBy("chart", by, *kinds).agg(
        F.count("*").cast(i).alias("entries"),
        F.count_if(F.col("peak") == 1).cast(i).alias("number_ones"),
        F.sum("at_1").cast(i).alias("weeks_at_1"),
        F.count_if(F.col("peak") <= 10).cast(i).alias("top_10s"),
        F.count_if(F.col("peak") <= 40).cast(i).alias("top_40s"),
        F.min("peak").alias("best_peak"),
        F.min("first").alias("first_entry"), F.max("last").alias("last_entry"),
        F.trim(F.min_by("title", F.struct("peak", -F.col("weeks"), "title"))).alias("biggest_hit"),
        # A title's weeks on a list are bounded by its calendar.
        F.size(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("total_weeks_charted"))
    if kind:
        for c in ARTIST_KIND_NULLS:
            stats = stats.withColumn(c, F.when(F.col(kind) != "artist", F.col(c)))
    return stats.select("chart", by, *kinds, *STAT_COLUMNS)


def names_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """The asked names, in order."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos int")


def display_names(rows: DataFrame) -> DataFrame:
    """Modal leading credit per asked name, over rows whose primary artist is
    that name; the smallest spelling on a tie."""
    return (
        rows.filter(primary_artist(F.col("artist")) == primary_artist(F.col("name")))
        .groupBy("name").agg(F.mode(primary_credit(F.col("artist")), True).alias("shown")))


def versus(entries: DataFrame, chart: str, names: list[str], kind: str = "song") -> DataFrame:
    """Statistics of several artists on one list, in the order asked; an artist
    without rows keeps zero or null statistics."""
    rows = artist_rows(entries.filter(F.col("chart") == chart), names)
    stats = artist_stats(rows.withColumn("kind", F.lit(kind)), by="name").drop("chart", "kind")
    out = (
        names_table(entries.sparkSession, names)
        .join(stats, "name", "left").join(display_names(rows), "name", "left")
        .withColumn("display_name", F.coalesce("shown", "name")).drop("shown"))
    zeroed = [c for c in ZERO_STATS if kind != "artist" or c not in ARTIST_KIND_NULLS]
    return out.fillna(0, zeroed).select("name", "pos", "display_name", *STAT_COLUMNS).orderBy("pos")


def artist_coverage(entries: DataFrame, registry: DataFrame, names: list[str]) -> DataFrame:
    """Statistics of the artists on every list they reached, in registry order,
    with the number of lists they did not reach."""
    lists = registry.select("chart", "label", "grp", "depth", "kind", "ord")
    rows = artist_rows(entries, names).join(lists.select("chart", "kind"), "chart")
    stats = artist_stats(rows, by="name")
    n_lists = registry.agg(F.count("*")).scalar()
    reached = F.count("*").over(W.partitionBy("name"))
    return (stats.join(lists.drop("kind"), "chart")
            .withColumn("hidden", (n_lists - reached).cast("int")).orderBy("name", "ord"))


def default_chart(coverage: DataFrame) -> DataFrame:
    """Per artist the list with most weeks, then entries, then registry order."""
    best = F.struct("total_weeks_charted", F.coalesce("entries", F.lit(0)), -F.col("ord"))
    return coverage.groupBy("name").agg(F.max_by("chart", best).alias("chart"))


def report_titles(entries: DataFrame, by: list[str]) -> DataFrame:
    """Per title of each group: modal spelling and credit, first week, distinct
    weeks, peak; most weeks first."""
    rows = (
        entries.filter("date IS NOT NULL AND rank IS NOT NULL")
        .withColumn("t", F.trim("title")).withColumn("k_title", match_key(F.col("title"))))
    # A list's dates are bounded by its calendar, so the set stays small and one
    # shuffle serves all aggregates.
    return (
        rows.groupBy(*by, "k_title").agg(
            F.mode("t", True).alias("title"), F.mode("artist", True).alias("artist"),
            F.min("date").alias("first_date"),
            F.size(F.collect_set("date")).alias("weeks"), F.min("rank").alias("peak"))
        .withColumn("is_number_one", F.col("peak") == 1).drop("k_title")
        .orderBy(*by, F.desc("weeks"), "peak", "title"))


def series_map(entries: DataFrame, by: list[str]) -> DataFrame:
    """title -> ordered (date, rank) points, one map per group and title. A
    title's points are bounded by its list's calendar."""
    return (
        entries.filter("date IS NOT NULL AND rank IS NOT NULL")
        .groupBy(*by, match_key(F.col("title")).alias("k_title"))
        .agg(F.mode(F.trim("title"), True).alias("title"),
             F.array_sort(F.collect_set(F.struct("date", "rank"))).alias("points"))
        .select(*by, F.map_from_arrays(F.array("title"), F.array("points")).alias("series")))


def modern_artist_summary(entries: DataFrame, floor: str = "1990-01-01",
                          list_name: str = "List") -> DataFrame:
    """Per (chart, exact credit) since `floor`: titles, rows, peak, number ones,
    top tens, first and last month, and a sentence made of them."""
    rows = entries.filter(F.col("date") >= F.lit(floor).cast("date")).withColumn(
        "k_credit", match_key(F.col("artist")))
    per_title = rows.groupBy("chart", "k_credit", "title").agg(
        F.min("rank").alias("peak"), F.count("*").alias("n"),
        F.min("date").alias("first"), F.max("date").alias("last"))
    s = per_title.groupBy("chart", "k_credit").agg(
        F.count("title").cast("int").alias("total_songs"), F.sum("n").cast("int").alias("total_weeks"),
        F.coalesce(F.min("peak"), F.lit(0)).alias("peak"),
        F.count_if(F.col("peak") == 1).cast("int").alias("number_ones"),
        F.count_if(F.col("peak") <= 10).cast("int").alias("top_10s"),
        F.date_format(F.min("first"), "MMMM yyyy").alias("first_month"),
        F.date_format(F.max("last"), "MMMM yyyy").alias("last_month"))
    n1, name = F.col("number_ones"), F.lit(list_name)
    head = (
        F.when(n1 > 0, F.concat(name, F.lit(" chart-topper with "), n1, F.lit(" #1 hit"),
                                F.when(n1 > 1, "s").otherwise("")))
        .when(F.col("top_10s") >= 5, F.concat(name, F.lit(" artist with "), "top_10s",
                                              F.lit(" top 10 hits")))
        .otherwise(F.concat(name, F.lit(" charting artist"))))
    span = F.when(
        F.col("first_month") != F.col("last_month"),
        F.concat(F.lit("Charting from "), "first_month", F.lit(" to "), "last_month")
    ).otherwise(F.concat(F.lit("First charted in "), "first_month"))
    body = F.concat("total_songs", F.lit(" songs charted for "), "total_weeks", F.lit(" total weeks"))
    return s.withColumn("description", F.concat_ws(" • ", head, body, span))


def artist_pool(entries: DataFrame, by: list[str] | None = None, floor: str | None = None) -> DataFrame:
    """Distinct solo names, per list or over all, sorted, for a search box."""
    rows = entries if floor is None else entries.filter(F.col("date") >= F.lit(floor).cast("date"))
    by = by or []
    return (
        rows.select(*by, F.trim("artist").alias("artist"))
        .filter((F.col("artist") != "") & is_solo_name(F.col("artist"))).distinct().orderBy(*by, "artist"))


def artist_prefix(pool: DataFrame, prefix: str = "", limit: int = 50) -> DataFrame:
    """First names of a pool by lower-case prefix."""
    return (pool.select("artist").filter(F.startswith(F.lower("artist"), F.lit(prefix.lower())))
            .distinct().orderBy("artist").limit(limit))


def top_artists(ranked: DataFrame, n: int = 10) -> DataFrame:
    """First n of a ranked (artist, listeners) table, n held to 1..50."""
    return ranked.orderBy(F.desc("listeners"), "artist").limit(max(1, min(n, 50)))


def current_number_one(entries: DataFrame, weeks_at_1: bool = False) -> DataFrame:
    """Top entry of each list's latest week with its rows on the list, or only
    those at rank 1."""
    rows = entries.filter("date IS NOT NULL AND rank IS NOT NULL").select(
        "chart", "date", "rank", F.trim("title").alias("title"), F.trim("artist").alias("artist"))
    latest = rows.groupBy("chart").agg(F.max("date").alias("date"))
    top = (rows.filter("rank = 1").join(latest, ["chart", "date"])
           .groupBy("chart", "date").agg(F.min(F.struct("title", "artist")).alias("top"))
           .select("chart", "date", "top.title", "top.artist"))
    counted = rows.filter("rank = 1") if weeks_at_1 else rows
    # One title per list is counted, not every title.
    counted = counted.join(top.select("chart", "title", "artist"), ["chart", "title", "artist"], "left_semi")
    n = counted.groupBy("chart", "title", "artist").agg(F.count("*").cast("int").alias("weeks"))
    return top.join(n, ["chart", "title", "artist"])


def version_rollup(streams: DataFrame) -> DataFrame:
    """(title, streams, daily) summed over all versions of a title."""
    return streams.groupBy(version_base(F.col("title")).alias("base")).agg(
        F.sum("streams").alias("streams"), F.sum("daily").alias("daily"))


def scorecard_best(cells: DataFrame, better: dict[str, str]) -> DataFrame:
    """Marks the best value per statistic in (stat, name, value) cells; ties are
    all marked, statistics without a direction never."""
    direction = F.lit(None)
    for stat, way in better.items():
        direction = F.when(F.col("stat") == stat, F.lit(way)).otherwise(direction)
    best = cells.groupBy("stat").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    target = F.when(direction == "high", F.col("hi")).when(direction == "low", F.col("lo"))
    return (cells.join(best, "stat")
            .withColumn("best", F.coalesce(F.col("value") == target, F.lit(False)))
            .drop("hi", "lo"))
