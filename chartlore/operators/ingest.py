"""Merging new list weeks into stored ones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITION = ["chart", "date", "rank"]


def _one_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark limits each group before the shuffle as well,
    so many copies of one key are not gathered."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str] = POSITION,
                 tie: tuple[str, ...] = ("title", "artist")) -> DataFrame:
    """Union with one row per key, the newer source winning; rows of one source
    repeating a key keep the greatest by `tie`."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return _one_per(both, keys, [F.desc("_src"), *[F.desc(t) for t in tie]]).drop("_src")


def keep_first(rows: DataFrame, seq: str, keys: list[str] = POSITION) -> DataFrame:
    """One row per key, the first by `seq`."""
    return _one_per(rows, keys, [F.asc(seq)])


def keep_last(rows: DataFrame, seq: str, keys: list[str] = POSITION) -> DataFrame:
    return _one_per(rows, keys, [F.desc(seq)])


def clean_entries(raw: DataFrame, tie: tuple[str, ...] = ("title", "artist")) -> DataFrame:
    """Numeric ranks only, no undated rows, one row per position."""
    ranked = raw.withColumn("rank", F.col("rank").try_cast("int")).dropna(subset=["rank", "date"])
    return _one_per(ranked, POSITION, [F.asc(t) for t in tie])


def append_only_weeks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows of weeks not stored yet."""
    have = stored.select("chart", "date").distinct()
    return incoming.join(have, ["chart", "date"], "left_anti")


def entries_on(entries: DataFrame, chart: str, date: str) -> DataFrame:
    return entries.filter((F.col("chart") == chart) & (F.col("date") == F.lit(date).cast("date"))
                          ).orderBy("rank")


def floor_filter(entries: DataFrame, floor: str = "1990-01-01") -> DataFrame:
    return entries.filter(F.col("date") >= F.lit(floor).cast("date"))


def override_join(rows: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Hand corrections (keys, source_text, new_title, new_artist), applied only
    where the row's text still is the one corrected."""
    fixes = overrides.select(*keys, F.col("source_text").alias("text"), "new_title", "new_artist")
    return (
        rows.join(fixes, [*keys, "text"], "left")
        .withColumn("title", F.coalesce("new_title", "title"))
        .withColumn("artist", F.coalesce("new_artist", "artist"))
        .drop("new_title", "new_artist"))


def source_precedence(units: DataFrame, official: str, seq: str = "seq",
                      keys: list[str] = ("chart", "date", "title", "artist")) -> DataFrame:
    """One figure per key: the official source beats others, its first row wins;
    without it the last row wins. Rows without a figure do not count."""
    rows = (units.filter("units IS NOT NULL")
            .withColumn("title", F.trim("title")).withColumn("artist", F.trim("artist")))
    is_official = F.col("source") == official
    return _one_per(rows, list(keys), [
        F.desc(is_official), F.when(is_official, F.col(seq)).otherwise(-F.col(seq))])


def units_join(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Entries with their week's units, matched on trimmed title and artist."""
    u = units.select("chart", "date", F.trim("title").alias("u_title"), F.trim("artist").alias("u_artist"),
                     "units", F.col("source").alias("units_source"))
    return entries.join(
        u, (entries.chart == u.chart) & (entries.date == u.date)
        & (F.trim(entries.title) == u.u_title) & (F.trim(entries.artist) == u.u_artist), "left"
    ).select(entries["*"], "units", "units_source")


def restrict_history(history: DataFrame, page: DataFrame) -> DataFrame:
    """History of the titles on the selected lists only; both sides keyed."""
    keys = page.select("chart", "k_title", "k_artist").distinct()
    return history.join(keys, ["chart", "k_title", "k_artist"], "left_semi")
