"""Visit counting as Structured Streaming; same results as operators.visits.

Input streams have ts (TIMESTAMP), path, visitor; where the order of arrival
counts, also `arrived`, which orders the rows of one micro-batch.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY = "1 day"   # a day stays open this long for late views
VISITOR = "visitor string, first_seen date, last_seen date, visits bigint"
_SPAN = "visitor string, first_at bigint, first_day date, last_at bigint, last_day date, visits bigint"


def page_views(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Views per (day, path); update mode."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "path").agg(F.count("*").alias("views"))
        .select(F.to_date("w.start").alias("day"), "path", "views"))


def visitor_days(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row per (visitor, day); append mode. The delay is at least a day, so
    a visitor's state outlives the day it guards."""
    return (
        stream.withColumn("day", F.to_date("ts")).withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["visitor", "day"]).select("visitor", "day"))


def visitors_by_day(stream: DataFrame) -> DataFrame:
    """first_seen, last_seen and visits per visitor by event time, whatever the
    order of arrival; update mode."""
    return (
        stream.withColumn("day", F.to_date("ts")).groupBy("visitor").agg(
            F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
            F.count("*").alias("visits")))


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per visitor of a batch, so that a busy visitor's rows don't meet
    one by one in a task."""
    for rows in batches:
        rows = rows.sort_values(["arrived", "day"], kind="stable")
        of = rows.groupby("visitor", sort=False)
        yield pd.DataFrame({
            "visitor": list(of.groups), "first_at": of["arrived"].first().to_numpy(), "first_day": of["day"].first().to_numpy(),
            "last_at": of["arrived"].last().to_numpy(), "last_day": of["day"].last().to_numpy(), "visits": of.size().to_numpy()})


class _Visitors(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first_seen date, last_seen date, visits bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = pd.concat(list(rows))
        first = spans.sort_values(["first_at", "first_day"], kind="stable").first_day.iloc[0]
        last = spans.sort_values(["last_at", "last_day"], kind="stable").last_day.iloc[-1]
        visits = int(spans.visits.sum())
        if self.seen.exists():  # first_seen is written once
            first, _, before = self.seen.get()
            visits += before
        self.seen.update((first, last, visits))
        yield pd.DataFrame({"visitor": [key[0]], "first_seen": [first], "last_seen": [last], "visits": [visits]})

    def close(self) -> None:
        pass


def visitors(stream: DataFrame) -> DataFrame:
    """Per visitor the day of the first visit that arrived, of the last one that
    arrived, and the number of visits; update mode. A late visit of an earlier
    day leaves first_seen as it is and moves last_seen back. State is one small
    row per visitor, as lifetime counts need. Visits without a visitor are left
    out."""
    rows = stream.filter("visitor IS NOT NULL").select("visitor", F.to_date("ts").alias("day"), F.col("arrived").cast("bigint").alias("arrived"))
    return rows.mapInPandas(_spans, _SPAN).groupBy("visitor").transformWithStateInPandas(
        _Visitors(), outputStructType=VISITOR, outputMode="Update", timeMode="None")
