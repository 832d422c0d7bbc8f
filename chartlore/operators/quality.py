"""Checks over stored lists. Each folds the history to one row per list and
date before anything ordered happens, so the windows are bounded by calendars."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.text import match_key
from chartlore.operators.calendar import published_weeks
from chartlore.operators.compare import shared_title_deltas

DEFAULT_FLOOR = 20   # fixed value: least rows of a list without a measured floor
MIN_SHARED = 10      # fixed value: shared titles below which a mode says nothing
THIN_WEEK = 5


def list_signature(*parts: Column) -> list[Column]:
    """Aggregates that identify a list's full ordering.

    A list is the set of its (rank, title, ...) lines, since the rank is part
    of each line. So the signature adds up two 60-bit pieces of every line's
    MD5 and counts the lines: equal lists give equal sums, and the sums combine
    map-side where hashing a collected ordering would gather the whole list.
    """
    line = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))

    def piece(start: int) -> Column:
        return F.sum(F.conv(F.substring(line, start, 15), 16, 10).cast("decimal(20,0)"))

    return [F.concat_ws("-", F.count("*"), piece(1), piece(16)).alias("signature"),
            F.count("*").cast("int").alias("n")]


def ranking_signatures(entries: DataFrame, keys: list[str], fold: bool = False) -> DataFrame:
    """Signature of each list and period; `fold` compares rank and case-folded
    title only."""
    parts = [F.col("rank"), match_key(F.col("title"))] if fold else [
        F.col("rank"), F.col("title"), F.col("artist")]
    return entries.groupBy(*keys).agg(*list_signature(*parts))


def clamped_weeks(entries: DataFrame) -> DataFrame:
    """Weeks whose full ordering repeats the previous stored week's."""
    sigs = ranking_signatures(entries.filter("date IS NOT NULL"), ["chart", "date"], fold=True)
    w = W.partitionBy("chart").orderBy("date")
    return (
        sigs.withColumn("prev_sig", F.lag("signature").over(w))
        .withColumn("prev_date", F.lag("date").over(w))
        .filter("signature = prev_sig").select("chart", "prev_date", "date"))


def first_genuine_week(entries: DataFrame) -> DataFrame:
    """Per list the last date of its leading run of identical orderings."""
    sigs = ranking_signatures(entries.filter("date IS NOT NULL"), ["chart", "date"])
    w = W.partitionBy("chart").orderBy("date")
    changed = F.coalesce(F.lag("signature").over(w) != F.col("signature"), F.lit(False)).cast("int")
    return (
        sigs.withColumn("changed", changed)
        .withColumn("runs", F.sum("changed").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .filter("runs = 0").groupBy("chart").agg(F.max("date").alias("first_week")))


def list_depth(entries: DataFrame) -> DataFrame:
    """Rows per list and date, flagged when fewer than five."""
    return entries.filter("date IS NOT NULL").groupBy("chart", "date").agg(
        F.count("*").cast("int").alias("rows"), (F.count("*") < THIN_WEEK).alias("thin"))


def depth_floor(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Least depth over all published weeks, never above the registry's depth."""
    return (
        list_depth(entries).groupBy("chart")
        .agg(F.min("rows").alias("low"), F.max("rows").alias("high"))
        .join(registry.select("chart", "depth"), "chart")
        .select("chart", "low", "high", F.least("low", "depth").alias("floor")))


def min_depth_gate(entries: DataFrame, floors: DataFrame | None = None,
                   default: int = DEFAULT_FLOOR) -> DataFrame:
    """Whole lists no shorter than their measured floor."""
    n = entries.groupBy("chart", "date").agg(F.count("*").alias("n"))
    if floors is not None:
        n = n.join(floors.select("chart", "floor"), "chart", "left")
    else:
        n = n.withColumn("floor", F.lit(None).cast("int"))
    good = n.filter(F.col("n") >= F.coalesce("floor", F.lit(default)))
    return entries.join(good.select("chart", "date"), ["chart", "date"], "left_semi")


def refuse_incomplete_ranks(rows: DataFrame, keys: list[str], parsed: Column | None = None) -> DataFrame:
    """Whole lists whose ranks are exactly 1..N and whose rows all parsed."""
    ok = F.lit(True) if parsed is None else F.coalesce(parsed, F.lit(False))
    marks = rows.select(*keys, "rank", ok.alias("ok")).groupBy(*keys, "rank").agg(
        F.count("*").alias("n"), F.min("ok").alias("ok"))
    good = marks.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.count("rank").alias("ranks"), F.min("ok").alias("ok")
    ).filter("lo = 1 AND hi = n AND ranks = n AND ok")
    return rows.join(good.select(*keys), keys, "left_semi")


def duplicates(entries: DataFrame) -> DataFrame:
    """(chart, date, rank) positions stored more than once."""
    return (entries.filter("date IS NOT NULL").groupBy("chart", "date", "rank")
            .agg(F.count("*").cast("int").alias("copies")).filter("copies > 1"))


def is_stale(entries: DataFrame, asof: str, days: int = 7) -> DataFrame:
    """Per list its latest date and whether it is older than `days`."""
    return entries.groupBy("chart").agg(F.max("date").alias("latest")).withColumn(
        "stale", F.datediff(F.lit(asof).cast("date"), "latest") > days)


def frozen_lists(entries: DataFrame, frozen: DataFrame) -> DataFrame:
    """Discontinued lists (chart, until) and whether they end exactly there."""
    last = entries.groupBy("chart").agg(F.max("date").alias("latest"))
    return frozen.join(last, "chart", "left").withColumn(
        "ok", F.coalesce(F.col("latest") == F.col("until"), F.lit(False)))


def freshness_report(entries: DataFrame, frozen: DataFrame, target: str) -> DataFrame:
    """Per list current, stale or frozen, with its latest date."""
    last = entries.groupBy("chart").agg(F.max("date").alias("latest"))
    return last.join(frozen, "chart", "left").select(
        "chart", "latest",
        F.when(F.col("until").isNotNull(), "frozen")
        .when(F.col("latest") >= F.lit(target).cast("date"), "current").otherwise("stale").alias("status"))


def week_gaps(entries: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Consecutive weeks that did not advance by one: elapsed weeks are the
    modal change in weeks-on-chart over the shared titles, smallest on a tie."""
    return (
        shared_title_deltas(entries).groupBy("chart", "prev_date", "date")
        .agg(F.count("*").alias("shared"), F.mode("delta", True).alias("elapsed"))
        .filter((F.col("shared") >= min_shared) & (F.col("elapsed") != 1))
        .select("chart", "prev_date", "date", F.col("elapsed").cast("int").alias("elapsed")))


def date_defects(entries: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """Week gaps where the dates disagree with the weeks that elapsed."""
    days = F.datediff("date", "prev_date")
    return (week_gaps(entries, min_shared).withColumn("days", days)
            .filter(F.col("days") / 7 != F.col("elapsed")))


def baseline_ratchet(findings: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Findings not accepted yet ('new') and accepted ones no longer found
    ('stale'). `keys` identify a finding in both."""
    f, b = findings.select(*keys).distinct(), baseline.select(*keys).distinct()
    return (f.join(b, keys, "left_anti").withColumn("status", F.lit("new"))
            .unionByName(b.join(f, keys, "left_anti").withColumn("status", F.lit("stale"))))


def verify_lists(entries: DataFrame, known_clamped: DataFrame) -> DataFrame:
    """chart, severity, check, findings: hard failures (unreadable dates,
    duplicates, new clamped weeks) and warnings (steps, known clamped weeks,
    thin weeks). Two passes over the history: by week and by position."""
    w = W.partitionBy("chart").orderBy("date")
    known = known_clamped.select("chart", "date", F.lit(True).alias("known")).distinct()
    clamped, accepted = F.col("signature") == F.col("prev_sig"), F.col("known").isNotNull()
    by_week = (
        ranking_signatures(entries.filter("date IS NOT NULL"), ["chart", "date"], fold=True)
        .withColumn("prev_sig", F.lag("signature").over(w))
        .withColumn("days", F.datediff("date", F.lag("date").over(w)))
        .join(known, ["chart", "date"], "left").groupBy("chart").agg(
            F.count_if(clamped & ~accepted).alias("new clamped"),
            F.count_if(clamped & accepted).alias("known clamped"),
            F.count_if(F.col("days") != 7).alias("non-weekly steps"),
            F.count_if(F.col("n") < THIN_WEEK).alias("thin weeks")))
    by_position = entries.groupBy("chart", "date", "rank").agg(F.count("*").alias("n")).groupBy("chart").agg(
        F.sum(F.when(F.col("date").isNull(), F.col("n"))).alias("unreadable dates"),
        F.sum(F.when(F.col("date").isNotNull(), F.col("n") - 1)).alias("duplicates"))
    checks = [("fail", "unreadable dates"), ("fail", "duplicates"), ("fail", "new clamped"),
              ("warn", "non-weekly steps"), ("warn", "known clamped"), ("warn", "thin weeks")]
    lines = F.explode(F.array(*[
        F.struct(F.lit(s).alias("severity"), F.lit(c).alias("check"),
                 F.col(f"`{c}`").cast("int").alias("findings")) for s, c in checks]))
    return (by_position.join(by_week, "chart", "left").select("chart", lines.alias("l"))
            .select("chart", "l.*").filter("findings > 0"))


def prove_feed(stored: DataFrame, feeds: DataFrame) -> DataFrame:
    """(chart, feed, proven): whether a candidate feed's first five rows at a
    list's latest week equal the stored ones; under three rows prove nothing.

    `feeds` has chart, feed, date, rank, title.
    """
    last = stored.groupBy("chart").agg(F.max("date").alias("date"))

    def five(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("rank", "k_title")
        return (rows.join(last, ["chart", "date"], "left_semi")
                .select(*keys, "rank", match_key(F.col("title")).alias("k_title"))
                .withColumn("place", F.row_number().over(w)).filter("place <= 5"))

    mine = five(stored, ["chart"])
    theirs = five(feeds, ["chart", "feed"])
    n_mine = mine.groupBy("chart").agg(F.count("*").alias("n_mine"))
    same = theirs.join(
        mine.withColumn("hit", F.lit(1)), ["chart", "place", "rank", "k_title"], "left")
    return (
        same.groupBy("chart", "feed").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
        .join(n_mine, "chart")
        .select("chart", "feed", ((F.col("n_mine") >= 3) & (F.col("n") == F.col("n_mine"))
                                  & (F.col("hits") == F.col("n_mine"))).alias("proven")))
