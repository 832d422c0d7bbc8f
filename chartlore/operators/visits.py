"""Visit counting, in batch."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlore.session import staged


def countable_visits(visits: DataFrame, prefixes: tuple[str, ...] = ("/static", "/api"),
                     paths: tuple[str, ...] = ("/admin",)) -> DataFrame:
    """Page views only: GET, no excluded prefix or path."""
    out = visits.filter(F.col("method") == "GET")
    for p in prefixes:
        out = out.filter(~F.startswith("path", F.lit(p)))
    return out.filter(~F.col("path").isin(*paths)) if paths else out


def page_views(visits: DataFrame) -> DataFrame:
    return visits.groupBy("day", "path").agg(F.count("*").alias("views"))


def visitor_days(visits: DataFrame) -> DataFrame:
    return visits.select("visitor", "day").distinct()


def visitors(visits: DataFrame) -> DataFrame:
    return visits.groupBy("visitor").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("visits"))


def views_and_uniques(views: DataFrame, uniques: DataFrame, key: str) -> DataFrame:
    """Two aggregates joined by period, never before aggregation, so neither
    multiplies the other; a period in either is kept."""
    return views.join(uniques, key, "full").select(
        key, F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("uniques", F.lit(0)).alias("uniques"))


def daily(visits: DataFrame, since: str | None = None) -> DataFrame:
    rows = visits if since is None else visits.filter(F.col("day") >= F.lit(since).cast("date"))
    views = rows.groupBy("day").agg(F.count("*").alias("views"))
    return views_and_uniques(
        views, visitor_days(rows).groupBy("day").agg(F.count("*").alias("uniques")), "day")


def monthly(visits: DataFrame) -> DataFrame:
    rows = visits.withColumn("month", F.date_format("day", "yyyy-MM"))
    views = rows.groupBy("month").agg(F.count("*").alias("views"))
    people = rows.select("month", "visitor").distinct().groupBy("month").agg(F.count("*").alias("uniques"))
    return views_and_uniques(views, people, "month")


def top_paths(visits: DataFrame, top: int = 10) -> DataFrame:
    return (visits.groupBy("path").agg(F.count("*").alias("views"))
            .orderBy(F.desc("views"), "path").limit(top))


def visit_summary(visits: DataFrame, today: str, days: int = 30) -> DataFrame:
    """(section, period, views, uniques): lifetime, today, the last `days` days
    and every month."""
    def line(section: str, frame: DataFrame, period) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), period.alias("period"), "views", "uniques")

    # One reduction of the visits, written once; every section sums it up further.
    base = staged(visits.groupBy("day", "visitor").agg(F.count("*").alias("views")), "visitor-days")

    def summed(frame: DataFrame, *by: str) -> DataFrame:
        sums = [F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.count("visitor").alias("uniques")]
        return frame.groupBy(*by).agg(*sums) if by else frame.agg(*sums)

    people = base.groupBy("visitor").agg(F.sum("views").alias("views"))
    months = base.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "visitor").agg(F.sum("views").alias("views"))
    day = F.lit(today).cast("date")
    return (
        line("lifetime", summed(people), F.lit(None).cast("string"))
        .unionByName(line("today", summed(base.filter(F.col("day") == day)), F.lit(today)))
        .unionByName(line("recent", summed(base.filter(F.col("day") >= F.date_sub(day, days - 1)), "day"),
                          F.col("day").cast("string")))
        .unionByName(line("monthly", summed(months, "month"), F.col("month"))))
