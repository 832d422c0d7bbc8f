"""New list weeks arriving as files, guarded and appended."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chartlore.functions.text import match_key
from chartlore.operators.ingest import append_only_weeks
from chartlore.operators.quality import ranking_signatures, refuse_incomplete_ranks
from chartlore.streaming import sinks


def new_genuine_weeks(incoming: DataFrame, stored_sigs: DataFrame) -> DataFrame:
    """Incoming rows worth storing: of complete lists (ranks 1..N), of weeks not
    stored yet, and not a repeat of the week before. Stored weeks are known by
    their signatures (chart, date, signature), so the history is not reread."""
    complete = refuse_incomplete_ranks(incoming, ["chart", "date"])
    fresh = append_only_weeks(stored_sigs, complete)
    sigs = ranking_signatures(fresh, ["chart", "date"], fold=True).select(
        "chart", "date", "signature", F.lit(True).alias("fresh"))
    known = stored_sigs.select("chart", "date", "signature", F.lit(False).alias("fresh"))
    w = W.partitionBy("chart").orderBy("date")
    genuine = (
        sigs.unionByName(known).withColumn("prev_sig", F.lag("signature").over(w))
        .filter(F.col("fresh") & ~F.col("signature").eqNullSafe(F.col("prev_sig"))))
    return fresh.join(genuine.select("chart", "date"), ["chart", "date"], "left_semi")


class _ListGuard(StatefulProcessor):
    """Keeps, per list, the stored weeks with their signatures, and lets through
    the rows of new genuine ones. A batch costs the weeks it brings and the
    calendar of the lists it touches, however many batches came before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getMapState("weeks", "date date", "signature string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        stored = {date: signature for (date,), (signature,) in self.weeks.iterator()}
        fresh = {}
        for date, week in arrived.groupby("date"):
            if date not in stored and sorted(week["rank"].tolist()) == list(range(1, len(week) + 1)):
                fresh[date] = hashlib.sha256("\n".join(sorted(week["line"])).encode()).hexdigest()
        known = sorted({**stored, **fresh}.items())
        good = [date for (_, before), (date, signature) in zip([(None, None), *known], known) if date in fresh and signature != before]
        for date in good:
            self.weeks.updateValue((date,), (fresh[date],))
        if good:
            yield arrived[arrived["date"].isin(good)].drop(columns="line")

    def close(self) -> None:
        pass


def genuine_weeks(stream: DataFrame) -> DataFrame:
    """The rows of arriving list weeks worth storing, by the rules of
    `new_genuine_weeks`; append mode. Rows without a list or date are left out."""
    lines = stream.filter("chart IS NOT NULL AND date IS NOT NULL").withColumn(
        "line", F.concat_ws("|", F.col("rank").cast("string"), match_key(F.col("title"))))
    return lines.groupBy("chart").transformWithStateInPandas(
        _ListGuard(), outputStructType=stream.schema, outputMode="Append", timeMode="None")


def ingest_weeks(stream: DataFrame, path: str, checkpoint: str, every: int = sinks.MERGE_EVERY) -> None:
    """Drains the weeks available now into the sink at `path`; `stored_weeks`
    reads it."""
    sinks.run_available(genuine_weeks(stream), path, checkpoint, "append", every=every)


def stored_weeks(spark: SparkSession, path: str) -> DataFrame:
    return sinks.stored_rows(spark, path)
