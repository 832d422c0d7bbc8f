"""The forest's box, trees and cut come from all labelled rows."""
import numpy as np
from pyspark.sql import functions as F

from chartlore.llm import quality_forest as forest


def test_all_labelled_rows_count(spark, monkeypatch):
    seen = []
    real = forest.grow_by
    monkeypatch.setattr(forest, "grow_by", lambda low, high, total, *rest: (seen.append(total), real(low, high, total, *rest))[1])
    junk = F.col("doc_id") % 1000 == 0
    word = F.when(junk, "##||##||").otherwise("w")
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), 60 + F.col("doc_id") % 40), lambda i: F.concat(word, i + F.col("doc_id"))))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id")).withColumn("text", text)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 1000 == 0, 0).otherwise(1).alias("quality"))
    judged = forest.judge_quality(docs, labels)
    assert seen == [29_970]
    assert judged.where("NOT kept AND doc_id % 1000 = 0").count() == 30
    assert judged.where("NOT kept AND doc_id % 1000 <> 0").count() <= 30


def test_kth_value_is_exact(spark):
    values = spark.range(5000).select((F.pmod(F.col("id") * 7919, F.lit(1000)) / 3).alias("v"), F.lit(1).alias("one"))
    want = np.sort([i * 7919 % 1000 / 3 for i in range(5000)])
    assert [forest.kth(values, "v", k) for k in (0, 17, 2500, 4999)] == [want[k] for k in (0, 17, 2500, 4999)]
    assert forest.kth(values, "one", 3) == 1
