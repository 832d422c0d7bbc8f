"""Week against week: drop-outs, movement, news."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.text import match_key, safe_int
from chartlore.operators.calendar import published_weeks, with_week_index
from chartlore.session import staged

# The retirement rule of recurrents, the least climb that is
# news, and the length of each news section.
RECURRENT_MIN_WEEKS, RECURRENT_RANK = 20, 25
MIN_CLIMB, TOP_N = 20, 6


def dropouts(entries: DataFrame, registry: DataFrame, weeks: DataFrame | None = None) -> DataFrame:
    """For every published week but the first: entries of the week before that
    are gone. Keys fold case; artist lists key on the title alone.

    A row drops out when its key has no row in the next published week, read
    off a window on the key, so the history is shuffled once and not joined to
    itself.
    """
    weeks = published_weeks(entries) if weeks is None else weeks
    kinds = registry.select("chart", "kind")
    keyed = (
        entries.join(weeks.select("chart", "date", "week_idx", "next_date"), ["chart", "date"]).join(kinds, "chart")
        .withColumn("k_title", match_key(F.col("title")))
        .withColumn("k_credit", F.when(F.col("kind") != "artist", match_key(F.col("artist")))))
    key = W.partitionBy("chart", "k_title", "k_credit").orderBy("week_idx")
    gone = keyed.withColumn("next_n", F.count("*").over(key.rangeBetween(1, 1))).filter(
        "next_n = 0 AND next_date IS NOT NULL")
    return (
        gone.select("chart", F.col("next_date").alias("current_week"), F.col("date").alias("previous_week"),
                "title", F.when(F.col("kind") != "artist", F.col("artist")).alias("artist"),
                safe_int(F.col("rank")).alias("rank"),
                safe_int(F.col("weeks_on_chart")).alias("weeks")))


def dropouts_on(entries: DataFrame, registry: DataFrame, chart: str, week: str | None = None) -> DataFrame:
    """Drop-outs of one list and week: the asked week if published, else the
    latest; the first week is reported as the second. Ordered by rank."""
    one = entries.filter(F.col("chart") == chart)
    days = published_weeks(one).select("date", "week_idx")
    # The list's calendar folds to one row: the asked week, else the newest.
    asked = F.max(F.when(F.col("date") == F.to_date(F.lit(week)), F.col("week_idx")))
    target = days.agg(F.greatest(F.coalesce(asked, F.max("week_idx")), F.lit(2)).alias("week_idx"))
    current = days.join(target, "week_idx").select(F.col("date").alias("current_week"))
    return dropouts(one, registry).join(current, "current_week", "left_semi").orderBy("rank")


def recurrents(gone: DataFrame) -> DataFrame:
    """Drop-outs under the retirement rule: long on the list, below the bar."""
    return gone.filter((F.coalesce("weeks", F.lit(0)) >= RECURRENT_MIN_WEEKS)
                       & (F.coalesce("rank", F.lit(0)) > RECURRENT_RANK))


def week_over_week(entries: DataFrame, weeks: DataFrame | None = None) -> DataFrame:
    """Each ranked row with its exact pair's rank on the previous published
    week; null where it was not on the list."""
    rows = with_week_index(entries.filter("rank IS NOT NULL"), weeks).withColumn(
        "title", F.trim("title")).withColumn("artist", F.trim("artist"))
    pair = W.partitionBy("chart", "title", "artist").orderBy("week_idx").rangeBetween(-1, -1)
    return (
        rows.withColumn("was", F.min("rank").over(pair))
        .select("chart", "date", "title", "artist", "rank", "was",
                (F.col("was") - F.col("rank")).alias("gain")))


def weekly_news(entries: DataFrame, registry: DataFrame, lead_charts: list[str] = (),
                min_climb: int = MIN_CLIMB, top_n: int = TOP_N, weeks: DataFrame | None = None) -> DataFrame:
    """News of the newest week any list carries, as rows of three sections:
    new number ones, climbs and new entries, each cut to `top_n` with its total.

    Lists without that week, or without an earlier one, are left out. Only the
    two weeks compared are read past the calendar.
    """
    rows = entries.join(registry.select("chart", "label", "kind", "ord"), "chart")
    days = published_weeks(rows) if weeks is None else weeks.join(registry.select("chart"), "chart", "left_semi")
    latest = days.agg(F.max("date")).scalar()
    # A week of unranked rows alone is nothing to compare with.
    ranked = rows.filter("rank IS NOT NULL").select("chart", F.col("date").alias("prev_date")).distinct()
    two = (
        days.filter(F.col("date") == latest).filter("prev_date IS NOT NULL")
        .join(ranked, ["chart", "prev_date"], "left_semi")
        .select("chart", F.explode(F.array("date", "prev_date")).alias("date"),
                F.col("date").alias("week")))
    pair = W.partitionBy("chart", "title", "artist").orderBy("date").rowsBetween(-1, -1)
    # One row per list, week and pair before the window.
    both = (
        rows.filter("rank IS NOT NULL").join(two, ["chart", "date"])
        .groupBy("chart", "label", "kind", "ord", "week", "date", F.trim("title").alias("title"),
                 F.trim("artist").alias("artist")).agg(F.min("rank").alias("rank"))
        .withColumn("was", F.min("rank").over(pair)))
    # Two weeks per list, read by every section.
    both = staged(both, "news")
    now = both.filter(F.col("date") == F.col("week"))
    before = (
        both.filter((F.col("date") < F.col("week")) & (F.col("rank") == 1))
        .groupBy("chart").agg(F.min(F.struct("title", "artist")).alias("b"))
        .select("chart", F.col("b.title").alias("was_title"), F.col("b.artist").alias("was_artist")))
    lead = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in lead_charts]).cast("array<string>"),
                                       F.col("chart")), F.lit(0))
    lead = F.when(lead > 0, lead - 1).otherwise(len(lead_charts))
    null = F.lit(None).cast("string")
    new_ones = (
        now.filter("rank = 1").join(before, "chart")
        .filter((F.col("title") != F.col("was_title")) | (F.col("artist") != F.col("was_artist")))
        .select(F.lit("new_one").alias("section"), "week", "chart", "label", "kind", "title", "artist",
                "rank", "was", "was_title", "was_artist",
                F.struct(lead.cast("int").alias("a"), F.col("label").alias("b"), F.col("ord").alias("c"),
                         F.col("title").alias("d")).alias("pos")))

    def plain(name: str, frame: DataFrame, first) -> DataFrame:
        return frame.select(
            F.lit(name).alias("section"), "week", "chart", "label", "kind", "title", "artist", "rank",
            "was", null.alias("was_title"), null.alias("was_artist"),
            F.struct(first.cast("int").alias("a"), F.lit("").alias("b"), F.col("ord").alias("c"),
                     F.concat("title", F.lit("|"), "artist").alias("d")).alias("pos"))

    news = (
        new_ones
        .unionByName(plain("climb", now.filter(F.col("was") - F.col("rank") >= min_climb),
                           F.col("rank") - F.col("was")))
        .unionByName(plain("entry", now.filter("was IS NULL"), F.col("rank"))))
    return news_cuts(news, top_n)


def news_cuts(news: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """First `top_n` rows of every section by `pos`, with the section's total.
    The cut runs before the shuffle as well, so no section is gathered whole."""
    totals = news.groupBy("section").agg(F.count("*").cast("int").alias("total"))
    w = W.partitionBy("section").orderBy("pos")
    return (
        news.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top_n)
        .join(totals, "section").drop("pos"))


def charts_covered(entries: DataFrame) -> DataFrame:
    """Newest week over all lists and the number of lists carrying it."""
    last = entries.filter("date IS NOT NULL AND rank IS NOT NULL").groupBy("chart").agg(
        F.max("date").alias("date"))
    return last.groupBy("date").agg(F.count("*").cast("int").alias("charts_covered")).orderBy(
        F.desc("date")).limit(1)


def shared_title_deltas(entries: DataFrame) -> DataFrame:
    """Titles shared by consecutive weeks with the change in their stored
    weeks-on-chart."""
    rows = entries.filter("weeks_on_chart IS NOT NULL AND date IS NOT NULL")
    per_week = rows.groupBy("chart", "title", "artist", "date").agg(F.max("weeks_on_chart").alias("n"))
    weeks = published_weeks(rows).select("chart", "date", "week_idx", "prev_date")
    w = W.partitionBy("chart", "title", "artist").orderBy("week_idx")
    return (
        per_week.join(weeks, ["chart", "date"])
        .withColumn("delta", F.when(F.lag("week_idx").over(w) == F.col("week_idx") - 1,
                                    F.col("n") - F.lag("n").over(w)))
        .filter("delta IS NOT NULL").select("chart", "prev_date", "date", "title", "artist", "delta"))
