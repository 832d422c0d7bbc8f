"""Which title heads a list next week: features, model and a fair account.

Every title in a week's first `top` ranks is a candidate; its label is whether it
is number one in the next published week. Features look back only and come from
ranks: one placement by list serves all of them, as on the list page.
The split is by date, never by chance, since neighbouring weeks share most of
what they know. A model counts for what it adds to "no change".
"""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.operators.calendar import with_week_index
from chartlore.operators.history import with_keys

FEATURES = ["rank", "log_rank", "rise_1", "rise_2", "rise_3", "absent_1", "weeks", "peak", "is_debut", "is_incumbent", "held",
            "incumbent_rise"]


def next_week_candidates(entries: DataFrame, weeks: DataFrame | None = None, top: int = 20, partitions: int | None = None) -> DataFrame:
    """chart, date, k_title, k_artist, the FEATURES and `label` (1 if the title
    heads the next published week, null in a list's last week).

    A rise is the rank so many published weeks ago less the present one, 0 where
    the title was absent then. `held` counts the weeks at number one up to now.
    A title on two ranks of one week counts with the better one. Weeks are numbered,
    and the last one is found, on the placement by list that serves the features;
    `partitions` is how many tasks share it. A calendar passed as `weeks` is joined,
    which broadcasts it where its files are small.
    """
    rows = with_week_index(with_keys(entries.filter("chart IS NOT NULL AND date IS NOT NULL")), weeks, partitions)
    if weeks is None:
        rows = rows.withColumn("last", F.max("week_idx").over(W.partitionBy("chart")))
    else:
        rows = rows.join(weeks.groupBy("chart").agg(F.max("week_idx").alias("last")), "chart")
    rows = rows.filter("rank IS NOT NULL")
    title = W.partitionBy("chart", "k_title", "k_artist").orderBy("week_idx")

    def best(first: int, last: int):
        return F.min("rank").over(title.rangeBetween(first, last))

    until_now = title.rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({
        "here": best(0, 0), "before": best(-1, -1), "before_2": best(-2, -2), "before_3": best(-3, -3), "peak": best(W.unboundedPreceding, 0),
        "after": best(1, 1), "weeks": F.dense_rank().over(title)}).filter(F.col("rank") == F.col("here"))
    opens = F.when((F.col("rank") == 1) & ~F.coalesce(F.col("before") == 1, F.lit(False)), F.col("week_idx"))
    rows = rows.withColumn("opens", opens).withColumn("start", F.max("opens").over(until_now)).filter(F.col("rank") <= top)

    def rise(before: str):
        return F.coalesce(F.col(before) - F.col("rank"), F.lit(0))

    week = W.partitionBy("chart", "date")
    rows = rows.select(
        "chart", "date", "k_title", "k_artist", "rank", F.round(F.log(F.col("rank").cast("double")), 9).alias("log_rank"),
        rise("before").alias("rise_1"), rise("before_2").alias("rise_2"), rise("before_3").alias("rise_3"),
        F.col("before").isNull().cast("int").alias("absent_1"), "weeks", "peak", (F.col("weeks") == 1).cast("int").alias("is_debut"),
        (F.col("rank") == 1).cast("int").alias("is_incumbent"),
        F.when(F.col("rank") == 1, F.col("week_idx") - F.col("start") + 1).otherwise(0).cast("int").alias("held"),
        F.when(F.col("week_idx") < F.col("last"), F.coalesce((F.col("after") == 1).cast("int"), F.lit(0))).alias("label"))
    # The number one's own movement.
    rows = rows.withColumn("incumbent_rise", F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("rise_1"))).over(week), F.lit(0)))
    return rows.select("chart", "date", "k_title", "k_artist", *FEATURES, "label")


def fit_next_number_one(candidates: DataFrame, until: str) -> PipelineModel:
    """A logistic regression on the weeks before `until`. The label of the last of
    them may lie on `until` itself, so that week is left out too."""
    train = candidates.filter((F.col("date") < F.date_sub(F.lit(until).cast("date"), 7)) & F.col("label").isNotNull())
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="features"), LogisticRegression(maxIter=50, regParam=1e-4)]
    return Pipeline(stages=steps).fit(train)


def predicted(model: PipelineModel, candidates: DataFrame) -> DataFrame:
    """Per (chart, date) the likeliest next number one, with its probability,
    and whether it and whether the present number one came true."""
    scored = model.transform(candidates).withColumn("p", vector_to_array("probability")[1])
    pick = F.struct("p", -F.col("rank"), "k_title", "k_artist", "label", "rank")
    return scored.groupBy("chart", "date").agg(
        F.max(pick).alias("c"), F.max(F.when(F.col("is_incumbent") == 1, F.col("label"))).alias("holds"), F.max("label").alias("known")).select(
        "chart", "date", "c.k_title", "c.k_artist", F.col("c.p").alias("probability"), F.col("c.label").alias("hit"), "holds", "known")


def account(predictions: DataFrame, since: str) -> DataFrame:
    """On weeks from `since`: how many, how often the prediction, "no change" and
    any candidate were right, and the prediction where the number one changed."""
    held_out = predictions.filter((F.col("date") >= F.lit(since).cast("date")) & F.col("hit").isNotNull())
    changed = F.coalesce(F.col("holds"), F.lit(0)) == 0
    return held_out.agg(
        F.count("*").alias("weeks"), F.avg("hit").alias("right"), F.avg(F.coalesce("holds", F.lit(0))).alias("no_change"),
        F.avg("known").alias("reachable"), F.count_if(changed).alias("changes"), F.avg(F.when(changed, F.col("hit"))).alias("right_on_changes"))
