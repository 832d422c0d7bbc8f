"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on rule statistics gives every document its evidence: the
log odds of being good beyond the prior it was trained at. Sites have priors of
their own. The corpus is grouped by host and by path under it; each group's mean
of soft labels (a label where there is one, else the classifier's probability)
is shrunk towards the level above, the more the fewer documents it has, with the
strength estimated from how much groups differ. The path's posterior odds and
the document's evidence multiply; documents below the cut are rejected.

Host and path are the columns `source` and `lang`; null counts as a site of its
own. Null and empty texts are judged by their (zero) statistics. Repeated rows
are judged alike. Without labels of both kinds, evidence is 0 and every document
is kept. The regression is fitted on at most `SAMPLE_ROWS` labelled rows chosen
by hash; groups are aggregated over all rows with partial sums, so a hot host
costs one row per task. The posteriors of all paths are written to the shared
folder and joined by their known size.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import bounded_rows, ship_package
from chartlore.llm.fitting import fit_logistic, probability
from chartlore.llm.text_rules import FIELDS, RATIOS, ratios, text_rules, with_rules
from chartlore.session import staged

SAMPLE_ROWS = 20_000
CUT = 0.3


@dataclass(frozen=True)
class Evidence:
    """Standardised logistic regression; `prior` is the trained share of good."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return probability(np.clip((x - self.mean) / self.spread, -8, 8), self.weights)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, sample_rows: int = SAMPLE_ROWS) -> Evidence:
    chosen = bounded_rows(_labels(labels, key), key, sample_rows, 4)
    rows = docs.select(key, F.col(text).alias("_text")).join(chosen, key).select(
        F.col("quality"), with_rules(F.col("_text")).alias("r")).select("quality", "r.*").toPandas()
    x, y = ratios(rows), rows.quality.to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Evidence(np.zeros(len(RATIOS)), np.ones(len(RATIOS)), np.zeros(len(RATIOS) + 1), 0.5)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    weights = fit_logistic(np.clip((x - mean) / spread, -8, 8), y)
    return Evidence(mean, spread, weights, float(y.mean()))


def _labels(labels: DataFrame, key: str) -> DataFrame:
    return labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(key).agg(
        F.max("quality").cast("int").alias("quality"))


def document_probability(text: Column, evidence: Evidence) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = pd.DataFrame([text_rules(t) for t in texts], columns=FIELDS)
            yield pd.Series(evidence.probability(ratios(rows)))

    return run(text)


def _strength(groups: DataFrame, n: str, mean: str, above: Column) -> float:
    """Prior size of a level, by moments: how far the groups' means lie from the
    level above, beyond what their sizes explain."""
    row = groups.agg(
        F.sum(F.col(n) * (F.col(mean) - above) ** 2).alias("between"), F.sum(n).alias("rows"), F.count("*").alias("groups"),
        F.sum(F.col(n) * above * (1 - above)).alias("within")).first()
    if not row.rows or not row.within:
        return 1.0
    noise = row.within / row.rows  # variance of one document's label
    extra = (row.between - row.groups * noise) / row.rows  # variance of the groups' true means
    return float(np.clip(noise / extra if extra > 0 else 1e4, 1.0, 1e4))


def path_posteriors(soft: DataFrame, host: str, path: str, p: str) -> DataFrame:
    """host, path and the shrunk share of good documents on each path, from one
    partial sum per path; hosts and the corpus are summed up from these."""
    paths = staged(soft.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(p).alias("good")), "path-sums")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    corpus = (whole.good or 0.0) / whole.n if whole.n else 0.5
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood")).withColumn(
        "hmean", F.col("hgood") / F.col("hn"))
    k_host = _strength(hosts, "hn", "hmean", F.lit(corpus))
    hosts = hosts.select(host, ((F.col("hgood") + k_host * corpus) / (F.col("hn") + k_host)).alias("host_share"))
    joined = paths.join(hosts, host).withColumn("mean", F.col("good") / F.col("n"))
    k_path = _strength(joined, "n", "mean", F.col("host_share"))
    return joined.select(host, path, "host_share", (
        (F.col("good") + k_path * F.col("host_share")) / (F.col("n") + k_path)).alias("path_share"))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  path: str = "lang", cut: float = CUT) -> DataFrame:
    """`docs` with `doc_share`, `host_share`, `path_share`, `quality_score` and
    `rejected`; these must be new names."""
    ship_package(docs.sparkSession)
    evidence = train(docs, labels, key, text)
    site = {"_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_path": F.coalesce(F.col(path).cast("string"), F.lit(""))}
    soft = docs.select(F.col(key), *(c.alias(n) for n, c in site.items()),
                       document_probability(F.col(text), evidence).alias("_p"))
    known = _labels(labels, key)
    soft = soft.join(known, key, "left").withColumn("_p", F.coalesce(F.col("quality").cast("double"), "_p"))
    shares = staged(path_posteriors(soft, "_host", "_path", "_p"), "site-shares")

    def odds(share: Column) -> Column:
        safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))
        return safe / (1 - safe)

    scored = docs.withColumns(site).withColumn("doc_share", document_probability(F.col(text), evidence))
    scored = scored.join(shares, ["_host", "_path"], "left").drop("_host", "_path")
    post = odds(F.col("doc_share")) / odds(F.lit(evidence.prior)) * odds(F.coalesce("path_share", F.lit(evidence.prior)))
    scored = scored.withColumn("quality_score", post / (1 + post))
    return scored.withColumn("rejected", F.col("quality_score") < cut)


def quality_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    scored = score_quality(docs.select(key, "text", "source", "lang"), labels, key)
    return scored.select(key, "doc_share", "host_share", "path_share", "quality_score", (~F.col("rejected")).alias("kept"))


def drop_rejected(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  path: str = "lang") -> DataFrame:
    """`docs` without the rows that the classifier rejects, columns as they are."""
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias(key), F.col(text).alias("text"),
                       F.col(host).alias("source"), F.col(path).alias("lang"))
    return score_quality(rows, labels, key).where(~F.col("rejected")).select("row.*")
