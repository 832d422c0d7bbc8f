"""The published calendar of each list.

"Previous week" always means the previous *published* week of that list. The
calendar holds one row per list and date, found by a map-side distinct, so a
window over it is bounded by the number of dates however many rows the history
has.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def published_weeks(entries: DataFrame, floor_year: int | None = None) -> DataFrame:
    """chart, date, week_idx, prev_date, next_date."""
    days = entries.select("chart", "date").filter(F.col("date").isNotNull())
    if floor_year is not None:
        days = days.filter(F.col("date") >= F.lit(f"{floor_year}-01-01").cast("date"))
    w = W.partitionBy("chart").orderBy("date")
    return days.distinct().select(
        "chart", "date", F.row_number().over(w).alias("week_idx"),
        F.lag("date").over(w).alias("prev_date"), F.lead("date").over(w).alias("next_date"))


def with_week_index(entries: DataFrame, weeks: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Entries with their list's week number; undated rows are dropped.

    Without `weeks` the number is the date's rank among the list's own dates,
    read off the rows placed by list, so nothing is joined, and windows on the
    list and more need no other placement. A calendar passed as `weeks` is
    joined. It compresses so well that Spark may take one of millions of weeks
    for small and broadcast it. `partitions` holds what a task sorts to a share
    of a known history; left open, tasks grow to what Spark joins into one.
    """
    if weeks is not None:
        return entries.join(weeks.select("chart", "date", "week_idx"), ["chart", "date"])
    dated = entries.filter("chart IS NOT NULL AND date IS NOT NULL")
    dated = dated.repartition(partitions, "chart") if partitions else dated.repartition("chart")
    return dated.withColumn("week_idx", F.dense_rank().over(W.partitionBy("chart").orderBy("date")))


def weeks_list(entries: DataFrame) -> DataFrame:
    """Weeks that can be reported on, newest first: all but each list's first."""
    return (published_weeks(entries).filter("prev_date IS NOT NULL")
            .select("chart", "date").orderBy("chart", F.desc("date")))


def union_dates(entries: DataFrame) -> DataFrame:
    """Every week any of the given rows charted."""
    return entries.select("date").filter("date IS NOT NULL").distinct()


def expected_weeks(segments: DataFrame, gaps: DataFrame | None = None,
                   extra: DataFrame | None = None) -> DataFrame:
    """Dates a list should hold: every seven days of each (chart, first, last)
    segment, minus the (chart, first, last) gaps, plus the (chart, date) extras."""
    weeks = segments.select(
        "chart", F.explode(F.expr("sequence(first, last, interval 7 days)")).alias("date"))
    if gaps is not None:
        hidden = gaps.select(
            F.col("chart").alias("g_chart"), F.col("first").alias("g_first"),
            F.col("last").alias("g_last"))
        weeks = weeks.join(
            hidden, (F.col("chart") == F.col("g_chart"))
            & F.col("date").between(F.col("g_first"), F.col("g_last")), "left_anti")
    if extra is not None:
        weeks = weeks.unionByName(extra.select("chart", "date"))
    return weeks.distinct()


def missing_weeks(entries: DataFrame, segments: DataFrame, gaps: DataFrame | None = None,
                  extra: DataFrame | None = None) -> DataFrame:
    """Expected weeks that are not stored."""
    have = entries.select("chart", "date").distinct()
    return expected_weeks(segments, gaps, extra).join(have, ["chart", "date"], "left_anti")


def non_weekly_steps(entries: DataFrame) -> DataFrame:
    """Consecutive published dates that are not seven days apart."""
    return (
        published_weeks(entries)
        .withColumn("days", F.datediff("date", "prev_date"))
        .filter("days <> 7").select("chart", "prev_date", "date", "days"))


def nearest_date(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (chart, asked): the published date nearest to it, the
    newest on a tie.

    Asked and published dates are laid on one line per list, and each asked date
    reads the published ones just before and after it, so nothing is paired.
    """
    none = F.lit(None).cast("date")
    line = (
        published_weeks(entries).select("chart", F.col("date").alias("d"), F.col("date").alias("pub"),
                                        none.alias("asked"))
        .unionByName(wanted.select("chart", F.col("asked").alias("d"), none.alias("pub"), "asked").distinct()))
    up = W.partitionBy("chart").orderBy("d").rangeBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("chart").orderBy(F.desc("d")).rangeBetween(W.unboundedPreceding, W.currentRow)
    near = (
        line.withColumn("older", F.max("pub").over(up)).withColumn("newer", F.min("pub").over(down))
        .filter("asked IS NOT NULL"))
    pick = F.when(F.datediff("newer", "asked") <= F.datediff("asked", "older"), F.col("newer")).otherwise(
        F.coalesce("older", "newer"))
    return near.select("chart", "asked", pick.alias("date")).filter("date IS NOT NULL")
