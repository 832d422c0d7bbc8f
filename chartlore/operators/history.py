"""Rank-history windows: movement, peaks, runs.

All of these recompute from ranks; the stored last-week and peak columns are
never read. Windows are keyed by (chart, title key, artist key). On cleaned
entries, where a (chart, date, rank) occurs once, such a group is bounded by
the list's calendar times its depth, not by the size of the history.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.credits import primary_artist
from chartlore.functions.text import match_key
from chartlore.operators.calendar import published_weeks, with_week_index


def with_keys(entries: DataFrame) -> DataFrame:
    """Adds k_title and k_artist, the keys a title's history is grouped by. Keys
    that entries bring along, as a stored history does, are taken as they are;
    whoever changes titles or credits drops them first (`without_keys`)."""
    if {"k_title", "k_artist"} <= set(entries.columns):
        return entries
    return entries.withColumn("k_title", match_key(F.col("title"))).withColumn(
        "k_artist", primary_artist(F.col("artist")))


def with_all_keys(entries: DataFrame) -> DataFrame:
    """`with_keys` and k_credit, the whole credit's key: what a history stores."""
    return with_keys(entries) if "k_credit" in entries.columns else with_keys(entries).withColumn("k_credit", match_key(F.col("artist")))


def without_keys(entries: DataFrame) -> DataFrame:
    return entries.drop("k_title", "k_artist", "k_credit")


def chart_page(entries: DataFrame, weeks: DataFrame | None = None, grower: bool = False,
               partitions: int | None = None) -> DataFrame:
    """Every list page of every week in one pass.

    last_week is the rank on the previous published week, peak and weeks run up
    to the row's week, change is up/down/same/new/re-entry, new_peak needs an
    earlier week that the rank strictly beats. One shuffle by list (with `weeks`
    by history key) serves every window: the finer windows are satisfied by it.
    `partitions` is how many tasks share it.
    """
    keyed = with_week_index(with_all_keys(entries), weeks, partitions)
    key = ["chart", "k_title", "k_artist"]
    run = W.partitionBy(*key).orderBy("week_idx")
    week_before = run.rangeBetween(-1, -1)
    until_now = run.rangeBetween(W.unboundedPreceding, 0)
    before = run.rangeBetween(W.unboundedPreceding, -1)
    page = (
        keyed
        .withColumn("last_week", F.min("rank").over(week_before))
        .withColumn("peak", F.min("rank").over(until_now))
        .withColumn("prior_best", F.min("rank").over(before))
        .withColumn("charted_before", F.count("*").over(before) > 0)
        # A contiguous run is known by the week it starts with.
        .withColumn("opens", F.when(F.count("*").over(week_before) == 0, F.col("week_idx")))
        .withColumn("start", F.max("opens").over(until_now)))
    # Starts grow with the weeks, so ordering a credit's weeks by start first
    # changes nothing and lets both windows share one sort.
    credit = W.partitionBy(*key, "k_credit").orderBy("start", "week_idx")
    in_run = W.partitionBy(*key, "k_credit", "start").orderBy("week_idx")
    # All weeks under the exact credit, plus credit-variant weeks only inside
    # the contiguous run that ends here.
    total = (F.dense_rank().over(credit) + F.col("week_idx") - F.col("start") + 1
             - F.dense_rank().over(in_run))
    moved = F.col("last_week") - F.col("rank")
    change = (
        F.when(F.col("last_week").isNull(),
               F.when(F.col("charted_before"), "re-entry").otherwise("new"))
        .when(moved > 0, "up").when(moved < 0, "down").otherwise("same"))
    page = page.withColumn("weeks", total.cast("int")).withColumn("change", change)
    out = [
        "chart", "date", "rank", F.trim("title").alias("title"), F.trim("artist").alias("artist"),
        "last_week", "peak", "weeks", "change",
        F.coalesce(F.abs(moved), F.lit(0)).alias("change_amount"),
        F.coalesce(F.col("rank") < F.col("prior_best"), F.lit(False)).alias("new_peak"),
    ]
    page = page.filter(F.col("rank").isNotNull())
    if grower:
        # A climb of at least five per cent of the depth served that week.
        depth = entries.filter("rank IS NOT NULL").groupBy("chart", "date").agg(
            F.ceil(F.count("*") * F.lit(0.05)).alias("need"))
        page = page.join(depth, ["chart", "date"])
        out.append(F.coalesce(moved >= F.col("need"), F.lit(False)).alias("grower"))
    return page.select(*out).withColumn("tags", F.array_compact(F.array(
        F.when(F.col("change").isin("new", "re-entry"), F.col("change")),
        F.when(F.col("new_peak"), F.lit("peak")))))


def song_history(entries: DataFrame, exact_credit: bool = False) -> DataFrame:
    """Ordered points of every title with a running week number, its peak and
    its total rows. Unranked rows are no points but count in the total.
    `exact_credit` keys on the full credit, as album histories do."""
    keyed = with_keys(entries.filter(F.col("date").isNotNull()))
    if exact_credit:
        keyed = keyed.withColumn("k_artist", F.col("k_credit") if "k_credit" in keyed.columns else match_key(F.col("artist")))
    run = W.partitionBy("chart", "k_title", "k_artist")
    ordered = run.orderBy("date", F.asc_nulls_last("rank")).rowsBetween(W.unboundedPreceding, 0)
    return (
        keyed
        .withColumn("week_no", F.count("rank").over(ordered).cast("int"))
        .withColumn("peak", F.min("rank").over(run))
        .withColumn("total_weeks", F.count("*").over(run).cast("int"))
        .filter(F.col("rank").isNotNull())
        .select("chart", "k_title", "k_artist", "date", "rank", "week_no", "peak", "total_weeks"))


def title_rows(entries: DataFrame, title: str, artist: str) -> DataFrame:
    """Rows of one title by one primary artist."""
    return entries.filter(
        (match_key(F.col("title")) == F.lower(F.trim(F.lit(title))))
        & (primary_artist(F.col("artist")) == primary_artist(F.lit(artist))))


def exact_credit_rows(entries: DataFrame, title: str, artist: str) -> DataFrame:
    """Rows of one title under one exact credit, whatever the case."""
    return entries.filter(
        (match_key(F.col("title")) == match_key(F.lit(title))) & (match_key(F.col("artist")) == match_key(F.lit(artist))))


def artist_timeline(entries: DataFrame, artist: Column | str = "k_artist") -> DataFrame:
    """Each week's best rank of an artist and the title that reached it."""
    return (
        with_keys(entries).withColumn("artist_key", F.col(artist) if isinstance(artist, str) else artist)
        .filter("rank IS NOT NULL AND date IS NOT NULL")
        .groupBy("chart", "artist_key", "date")
        .agg(F.min("rank").alias("rank"),
             F.trim(F.min_by("title", F.struct("rank", "title", "artist"))).alias("title")))


def reign(entries: DataFrame, stop_at_gap: bool = False, weeks: DataFrame | None = None) -> DataFrame:
    """Consecutive weeks the current number one has held, and since when.

    A missing week does not end a run unless `stop_at_gap`.
    """
    pair = F.struct(F.trim("title").alias("title"), F.trim("artist").alias("artist"))
    weeks = (published_weeks(entries) if weeks is None else weeks).select("chart", "date", "week_idx")
    # One row per list and week before any window: bounded by the calendar.
    ones = (
        entries.filter("rank = 1 AND date IS NOT NULL")
        .groupBy("chart", "date").agg(F.min(pair).alias("top"))
        .join(weeks, ["chart", "date"]))
    back = W.partitionBy("chart").orderBy(F.desc("date"))
    later_top, later_idx = F.lag("top").over(back), F.lag("week_idx").over(back)
    broken = later_top.isNotNull() & (later_top != F.col("top"))
    if stop_at_gap:
        broken = broken | F.coalesce(later_idx - F.col("week_idx") > 1, F.lit(False))
    return (
        ones.withColumn("broken", broken.cast("int"))
        .withColumn("runs", F.sum("broken").over(back.rowsBetween(W.unboundedPreceding, 0)))
        .filter("runs = 0").groupBy("chart")
        .agg(F.first("top.title").alias("title"), F.first("top.artist").alias("artist"),
             F.count("*").cast("int").alias("weeks"), F.min("date").alias("since")))


def gap_segments(points: DataFrame, keys: list[str], days: int = 10) -> DataFrame:
    """Splits (keys, date) timelines where the step exceeds `days`; a segment of
    one point is flagged as isolated. Needs one row per key and date."""
    w = W.partitionBy(*keys).orderBy("date")
    opens = F.coalesce(F.datediff("date", F.lag("date").over(w)) > days, F.lit(True)).cast("int")
    segment = F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return (
        points.withColumn("opens", opens).withColumn("segment", segment)
        .withColumn("isolated", F.count("*").over(W.partitionBy(*keys, "segment")) == 1)
        .drop("opens"))


def gap_markers(dates: DataFrame, keys: list[str]) -> DataFrame:
    """The (keys, date) rows plus one marker row (is_gap) wherever the step to
    the next date is longer than a week; a marker sorts after its date."""
    w = W.partitionBy(*keys).orderBy("date")
    step = dates.withColumn("next", F.lead("date").over(w))
    rows = F.when(F.datediff("next", "date") > 7, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False)))
    return step.select(*keys, "date", F.explode(rows).alias("is_gap"))
