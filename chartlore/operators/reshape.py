"""Exports: weeks down, titles across. The long form is the scalable result;
the pivots name their columns, which Spark bounds by its pivot limit."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.credits import primary_artist, primary_credit
from chartlore.operators.stats import STAT_COLUMNS
from chartlore.operators.titles import fill_image

SCORECARD_ROWS = {   # fixed values: labels in the order shown
    "entries": "Entries", "number_ones": "Number ones", "weeks_at_1": "Weeks at #1",
    "top_10s": "Top 10s", "top_40s": "Top 40s", "best_peak": "Best peak",
    "total_weeks_charted": "Weeks charted", "first_entry": "First entry",
    "last_entry": "Last entry", "biggest_hit": "Biggest hit"}


def _with_artist(rows: DataFrame) -> DataFrame:
    """k_artist, taken as it is where rows bring it along, as a keyed history does."""
    return rows if "k_artist" in rows.columns else rows.withColumn("k_artist", primary_artist(F.col("artist")))


def title_columns(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """The columns of an export, per group: (title, primary artist) pairs in
    debut order with their header. The credit is shown when it says more than
    the leading act or when the title repeats."""
    by = list(by)
    pairs = (
        _with_artist(rows.filter("date IS NOT NULL"))
        .groupBy(*by, "title", "k_artist").agg(
            F.min("date").alias("debut"),
            F.max_by("artist", F.struct("date", "artist")).alias("credit"),
            *([F.min_by("image_url", F.when(F.startswith("image_url", F.lit("http")), F.struct("date", "rank", "image_url")))
               .alias("image_url")] if "image_url" in rows.columns else [])))
    repeats = pairs.groupBy(*by, "title").agg((F.count("*") > 1).alias("repeats"))
    more = (primary_credit(F.col("credit")) != F.col("credit")) | F.col("repeats")
    return pairs.join(repeats, [*by, "title"]).select(
        *by, "title", "k_artist", "debut", "credit", *(["image_url"] if "image_url" in rows.columns else []),
        F.when(more, F.concat("title", F.lit(" ("), "credit", F.lit(")"))).otherwise(
            F.col("title")).alias("header"))


def rank_long(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, date, title, k_artist, rank): the best rank per cell."""
    return (
        _with_artist(rows.filter("date IS NOT NULL"))
        .groupBy(*by, "date", "title", "k_artist").agg(F.min("rank").alias("rank"))
        .filter("rank IS NOT NULL"))


def _column_names(frame: DataFrame, column: str, order: list) -> list[str]:
    """Names of pivot columns, refused beyond Spark's pivot limit."""
    limit = int(frame.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = [r[0] for r in frame.orderBy(*order).select(column).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} columns; use the long form")
    return found


def _told_apart(heads: DataFrame, column: str) -> DataFrame:
    """Titles whose headers coincide keep a column each: later ones are numbered."""
    turn = F.row_number().over(W.partitionBy(column).orderBy("debut", "title", "k_artist"))
    return heads.withColumn("turn", turn).withColumn(column, F.when(
        F.col("turn") == 1, F.col(column)).otherwise(F.concat(column, F.lit(" #"), "turn"))).drop("turn")


def rank_pivot(rows: DataFrame) -> DataFrame:
    """One selection's weeks down and titles across, in debut order."""
    heads = _told_apart(title_columns(rows), "header")
    names = _column_names(heads, "header", ["debut", "title", "k_artist"])
    cells = rank_long(rows).join(heads.select("title", "k_artist", "header"), ["title", "k_artist"])
    return cells.groupBy("date").pivot("header", names).agg(F.min("rank")).orderBy("date")


def weekly_grid_long(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, date, title, rank) on a grid of every seven days from a group's
    first to last week; weeks without rows keep a null title. Weeks off the grid
    are dropped, as a reindex does."""
    clean = rows.filter("date IS NOT NULL").withColumn("title", F.initcap(F.trim("title")))
    cells = clean.groupBy(*by, "date", "title").agg(
        F.min_by("rank", F.struct("rank", "artist")).alias("rank"))
    grid = cells.groupBy(*by).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        *by, F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("date"))
    return grid.join(cells, [*by, "date"], "left")


def rank_pivot_weekly_grid(rows: DataFrame) -> DataFrame:
    """The grid of one selection with titles across, in debut order."""
    long = weekly_grid_long(rows.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    debut = rows.filter("date IS NOT NULL").groupBy(F.initcap(F.trim("title")).alias("title")).agg(
        F.min("date").alias("debut"))
    names = _column_names(debut, "title", ["debut", "title"])
    return long.groupBy("date").pivot("title", names).agg(F.first("rank", True)).orderBy("date")


def scorecard_long(stats: DataFrame) -> DataFrame:
    """(stat, label, name, value) cells of a comparison; values as text."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("stat"), F.lit(SCORECARD_ROWS[k]).alias("label"),
                 F.col(k).cast("string").alias("value"))
        for i, k in enumerate(STAT_COLUMNS)])
    return stats.select("name", F.explode(cells).alias("c")).select(
        F.col("c.ord").alias("ord"), F.col("c.stat").alias("stat"), F.col("c.label").alias("label"),
        "name", F.col("c.value").alias("value"))


def versus_scorecard(stats: DataFrame, names: list[str]) -> DataFrame:
    """Statistics down, artists across; blanks where a statistic is null."""
    return (
        scorecard_long(stats).groupBy("ord", "label").pivot("name", names).agg(F.max("value"))
        .fillna("", names).orderBy("ord").drop("ord").withColumnRenamed("label", "stat"))


def versus_weekly_long(rows: DataFrame) -> DataFrame:
    """(name, date, title, k_artist, header, rank) for rows tagged with the
    asked name. A collaboration shows under each artist it names."""
    heads = title_columns(rows, ["name"]).select("name", "title", "k_artist", "header")
    return rank_long(rows, ["name"]).join(heads, ["name", "title", "k_artist"])


def _versus_columns(rows: DataFrame) -> DataFrame:
    heads = title_columns(rows, ["name"]).withColumn("col", F.concat("name", F.lit(": "), "header"))
    return _told_apart(heads, "col")


def versus_weekly_cells(rows: DataFrame) -> DataFrame:
    """(date, header, rank): the cells of `versus_weekly`, for any number of
    columns."""
    heads = _versus_columns(rows).select("name", "title", "k_artist", F.col("col").alias("header"))
    return rank_long(rows, ["name"]).join(heads, ["name", "title", "k_artist"]).select("date", "header", "rank")


def versus_weekly(rows: DataFrame) -> DataFrame:
    """The comparison with one column per artist and title, blocks by artist.
    An artist named in many credits has more titles than a pivot has columns:
    `versus_weekly_cells` is that comparison whole."""
    names = _column_names(_versus_columns(rows), "col", ["name", "debut", "title", "k_artist"])
    return versus_weekly_cells(rows).groupBy("date").pivot("header", names).agg(F.min("rank")).orderBy("date")


def artist_history_export(rows: DataFrame, images: DataFrame, by: list[str] = ()) -> DataFrame:
    """The history of one artist, or of every group `by` (an artist's name), in
    long form: per cell the header, the artwork (the selection's own first, else
    any list's) and the rank, and a marker line (is_gap) after each break of over
    a week. Any number of artists share one plan."""
    by = list(by)
    heads = title_columns(rows, by)
    art = (
        fill_image(heads.select(*by, "title", F.col("credit").alias("artist"), "header", "image_url"), images)
        .select(*by, "title", primary_artist(F.col("artist")).alias("k_artist"), "header", "image_url"))
    cells = rank_long(rows, by)
    days = cells.select(*by, "date").distinct()
    # A selection's weeks: bounded by the calendar.
    gaps = days.withColumn("next", F.lead("date").over(W.partitionBy(*by).orderBy("date"))).filter(
        F.datediff("next", "date") > 7)
    body = cells.join(art, [*by, "title", "k_artist"]).select(
        *by, "date", F.lit(False).alias("is_gap"), "header", "image_url", "rank")
    marks = gaps.select(*by, "date", F.lit(True).alias("is_gap"), F.lit(None).cast("string").alias("header"),
                        F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("int").alias("rank"))
    return body.unionByName(marks)
