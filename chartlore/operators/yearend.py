"""Year-end lists: genuine years, overlap with the weekly lists."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.text import artwork_url, match_key, normalise_title
from chartlore.operators.ingest import keep_last
from chartlore.operators.quality import ranking_signatures
from chartlore.session import staged

# Fixed values of the overlap rule.
MIN_WEEKS, MIN_OVERLAP, FULL_YEAR_WEEKS = 20, 60, 52
COLUMNS = ["chart", "year", "rank", "title", "artist", "image_url"]


def scan_yearend(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """Typed rows of registered lists; unreadable years and ranks are dropped."""
    return (
        raw.withColumn("year", F.col("year").try_cast("double").cast("int"))
        .withColumn("rank", F.col("rank").try_cast("double").cast("int"))
        .dropna(subset=["year", "rank"])
        .join(registry.select("chart"), "chart", "left_semi").select(*COLUMNS))


def yearend_upsert(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per (chart, year, rank), the last wins."""
    return keep_last(rows, seq, ["chart", "year", "rank"])


def real_years(yearend: DataFrame, weekly_sigs: DataFrame | None = None,
               excluded: DataFrame | None = None) -> DataFrame:
    """chart, year, genuine, duplicate_of. A year is genuine unless a later year
    carries the same ordering; years equal to the weekly list (chart, signature)
    are removed first, excluded (chart, year) last."""
    sigs = ranking_signatures(yearend, ["chart", "year"]).drop("n")
    if weekly_sigs is not None:
        weekly = weekly_sigs.select("chart", "signature").distinct().withColumn("weekly", F.lit(True))
        sigs = sigs.join(weekly, ["chart", "signature"], "left")
    else:
        sigs = sigs.withColumn("weekly", F.lit(None).cast("boolean"))
    sigs = sigs.withColumn("weekly", F.coalesce("weekly", F.lit(False)))
    if excluded is not None:
        sigs = sigs.join(excluded.select("chart", "year", F.lit(True).alias("named")), ["chart", "year"], "left")
    else:
        sigs = sigs.withColumn("named", F.lit(None).cast("boolean"))
    last = F.max(F.when(~F.col("weekly"), F.col("year"))).over(W.partitionBy("chart", "signature"))
    genuine = ~F.col("weekly") & (F.col("year") == last) & ~F.coalesce("named", F.lit(False))
    return sigs.withColumn("last", last).select(
        "chart", "year", genuine.alias("genuine"),
        F.when(~F.col("weekly") & (F.col("year") < F.col("last")), F.col("last")).alias("duplicate_of"))


def yearend_page(yearend: DataFrame, registry: DataFrame, year: int | None = None) -> DataFrame:
    """One genuine year of each list, the newest by default. Artist lists show
    the title as the artist."""
    years = real_years(yearend).filter("genuine").select("chart", "year")
    if year is None:
        years = years.groupBy("chart").agg(F.max("year").alias("year"))
    else:
        years = years.filter(F.col("year") == year)
    return (
        yearend.join(years, ["chart", "year"], "left_semi").join(registry.select("chart", "kind"), "chart")
        .select("chart", "year", "rank", F.trim("title").alias("title"),
                F.when(F.col("kind") == "artist", F.trim("title")).otherwise(F.trim("artist")).alias("artist"),
                artwork_url(F.col("image_url")).alias("image_url"),
                artwork_url(F.col("image_url"), "344x344").alias("image_url_lg")))


def yearend_charts(yearend: DataFrame, registry: DataFrame) -> DataFrame:
    """Lists with a year-end edition, in registry order."""
    return registry.join(yearend.select("chart").distinct(), "chart", "left_semi").orderBy("ord")


def available_charts(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Lists that hold data, by group and registry order."""
    return registry.join(entries.select("chart").distinct(), "chart", "left_semi").orderBy("grp", "ord")


def _titles(rows: DataFrame, key=normalise_title) -> DataFrame:
    return rows.select("chart", "year", key(F.col("title")).alias("t")).distinct()


def weekly_coverage(entries: DataFrame) -> DataFrame:
    """Weeks stored per list and year."""
    return (entries.filter("date IS NOT NULL").select("chart", F.year("date").alias("year"), "date")
            .distinct().groupBy("chart", "year").agg(F.count("*").cast("int").alias("weeks")))


def yearend_overlap(yearend: DataFrame, entries: DataFrame) -> DataFrame:
    """Per list and year: distinct year-end titles, how many of them the same
    year's weeks hold, and the weeks stored."""
    weekly = _titles(entries.filter("date IS NOT NULL").withColumn("year", F.year("date")), match_key)
    hits = _titles(yearend, match_key).join(weekly.withColumn("hit", F.lit(1)), ["chart", "year", "t"], "left")
    return (
        hits.groupBy("chart", "year")
        .agg(F.count("*").cast("int").alias("titles"), F.count("hit").cast("int").alias("matched"))
        .join(weekly_coverage(entries), ["chart", "year"], "left")
        .withColumn("weeks", F.coalesce("weeks", F.lit(0))))


def verify_yearend(yearend: DataFrame, entries: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """Overlap in whole per cent against a bar scaled by the weeks stored;
    years with too few weeks are untestable, or accepted if listed."""
    pct = F.floor(F.lit(100) * F.col("matched") / F.greatest("titles", F.lit(1))).cast("int")
    bar = F.lit(float(MIN_OVERLAP)) * F.least(F.lit(1.0), F.col("weeks") / FULL_YEAR_WEEKS)
    rows = yearend_overlap(yearend, entries).withColumn("pct", pct).withColumn("bar", bar)
    if accepted is not None:
        rows = rows.join(accepted.select("chart", "year", F.lit(True).alias("listed")), ["chart", "year"], "left")
    else:
        rows = rows.withColumn("listed", F.lit(None).cast("boolean"))
    thin = F.col("weeks") < MIN_WEEKS
    return rows.withColumn("status", F.when(thin & F.coalesce("listed", F.lit(False)), "accepted")
                           .when(thin, "untestable").when(F.col("pct") < F.col("bar"), "fail")
                           .otherwise("ok")).drop("listed")


def _listed(yearend: DataFrame) -> DataFrame:
    """Titles of each list and year with how many rows have them."""
    return yearend.select("chart", "year", normalise_title(F.col("title")).alias("t")).groupBy(
        "chart", "year", "t").agg(F.count("*").alias("n"))


def _best(listed: DataFrame, weekly: DataFrame, cover: DataFrame) -> DataFrame:
    weekly = weekly.join(cover.select("chart", "year"), ["chart", "year"], "left_semi").withColumnRenamed("year", "weekly_year")
    scores = listed.join(weekly, ["chart", "t"]).groupBy("chart", "year", "weekly_year").agg(
        F.sum("n").cast("int").alias("score"))
    return scores.groupBy("chart", "year").agg(
        F.max_by("weekly_year", F.struct("score", -F.col("weekly_year"))).alias("best_year"),
        F.max("score").alias("score"))


def _weekly(entries: DataFrame) -> DataFrame:
    return _titles(entries.filter("date IS NOT NULL").withColumn("year", F.year("date")))


def best_matching_year(yearend: DataFrame, entries: DataFrame) -> DataFrame:
    """For each year-end year the year of the list's weeks that holds most of
    its titles, the earliest on a tie; years with few stored weeks do not
    compete."""
    return _best(_listed(yearend), _weekly(entries), weekly_coverage(entries).filter(F.col("weeks") >= MIN_WEEKS))


def accept_yearend(yearend: DataFrame, entries: DataFrame) -> DataFrame:
    """chart, year, accepted: the share of rows found in the year's weeks
    reaches the scaled bar and no other year matches better.

    Distinct titles of both sides and the weeks stored serve both questions: they
    are written once, and neither input is worked out a second time.
    """
    listed, weekly = staged(_listed(yearend), "listed-titles"), staged(_weekly(entries), "weekly-titles")
    cover = staged(weekly_coverage(entries).filter(F.col("weeks") >= MIN_WEEKS), "coverage")
    rows = listed.join(weekly.withColumn("hit", F.lit(True)), ["chart", "year", "t"], "left")
    share = rows.groupBy("chart", "year").agg(
        (F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("share"))
    bar = F.lit(MIN_OVERLAP / 100) * F.least(F.lit(1.0), F.col("weeks") / FULL_YEAR_WEEKS)
    return (
        share.join(cover, ["chart", "year"], "left")
        .join(_best(listed, weekly, cover), ["chart", "year"], "left")
        .select("chart", "year", F.coalesce(
            F.col("weeks").isNotNull() & (F.col("share") >= bar)
            & (F.col("best_year") == F.col("year")), F.lit(False)).alias("accepted")))
