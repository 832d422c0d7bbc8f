"""Quality rules with an isolation forest on rule statistics.

Each text is counted once (words, symbols, repeated lines and windows, ...). The
base rules reject very short and very repetitive texts. For the others a forest
of random splits measures how soon a text stands alone: every tree cuts the box
of all labelled statistics at random features and places until a part holds no
more than 1 / `PER_TREE` of the labelled good rows. Texts that fall into an empty
part of the box have short paths and are anomalous. The cut on the path score is
calibrated on labelled rows.

Box, trees and cut come from all labelled rows: a tree grows a few levels at a
time, and Spark counts the good rows in its parts. A model's size depends on
`PER_TREE` and `DEPTH` alone. The counts of every text and the labelled rows are
written once to the shared folder. Null and empty texts have no words and fail the
base rules. Repeated rows are judged alike. Without labels of both kinds, the base
rules decide alone.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package
from chartlore.llm.text_rules import FIELDS, RATIOS, ratios, with_rules
from chartlore.session import staged

TREES = 100
PER_TREE = 256
DEPTH = 14
LEVELS = 3  # grown between two counts
BINS = 4096
LOST_GOOD = 0.001  # share of good labelled rows that the cut may reject


@dataclass(frozen=True)
class Forest:
    """Trees as arrays, one row per tree: feature (-1 at leaves), place of the
    cut, left child (the right one follows it) and path length at a leaf."""

    feature: np.ndarray
    place: np.ndarray
    child: np.ndarray
    length: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): towards 1 for anomalies."""
        total = np.zeros(len(x))
        for tree in range(len(self.feature)):
            total += self.length[tree][self.leaves(tree, x)]
        return 2.0 ** (-total / len(self.feature) / expected_path(PER_TREE))

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The leaf of a tree that each row falls into."""
        feature, place, child = self.feature[tree], self.place[tree], self.child[tree]
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(DEPTH + 1):
            f = feature[node]
            node = np.where(f < 0, node, child[node] + (x[rows, np.maximum(f, 0)] >= place[node]))
        return node

    def counts(self, x: np.ndarray) -> pd.DataFrame:
        """tree, node, n: how many rows each leaf has, where it has any."""
        found = []
        for tree in range(len(self.feature)):
            node, n = np.unique(self.leaves(tree, x), return_counts=True)
            found.append(pd.DataFrame({"tree": tree, "node": node, "n": n}))
        return pd.concat(found)


def expected_path(n: float) -> float:
    """Mean path of a failed search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _packed(trees: list[list[list]]) -> Forest:
    size = max(map(len, trees))
    table = np.array([t + [[-1, 0.0, 0, 0.0]] * (size - len(t)) for t in trees])
    return Forest(table[:, :, 0].astype(int), table[:, :, 1], table[:, :, 2].astype(int), table[:, :, 3])


def grow_by(low: np.ndarray, high: np.ndarray, total: int, counts: Callable[[Forest], pd.DataFrame], seed: int = 7) -> Forest:
    """Trees in the box from `low` to `high`. `counts` tells how many of the
    `total` good rows are in each leaf of the trees so far; a part with more than
    1 / PER_TREE of them is cut further."""
    rng = np.random.default_rng(seed)
    wide = np.flatnonzero(high > low)
    scale = min(PER_TREE, total) / total
    trees = [[[-1, 0.0, 0, 0.0]] for _ in range(TREES)]
    todo = [(tree, 0, low, high, 0, total) for tree in range(TREES)]
    while todo:
        grown, nexts = [], []
        for tree, at, lo, hi, depth, n in todo:
            nodes = trees[tree]
            if depth >= DEPTH or n * scale <= 1 or not len(wide):
                nodes[at][3] = depth + expected_path(n * scale)
                continue
            grown.append((tree, at, depth))
            level = [(at, lo, hi)]
            for deeper in range(min(LEVELS, DEPTH - depth)):
                below = []
                for node, lo, hi in level:
                    f = int(rng.choice(wide))
                    cut = float(rng.uniform(lo[f], hi[f]))
                    nodes[node][:3] = [f, cut, len(nodes)]
                    lo2, hi2 = lo.copy(), hi.copy()
                    hi2[f], lo2[f] = cut, cut
                    below += [(len(nodes), lo, hi2), (len(nodes) + 1, lo2, hi)]
                    nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                level = below
            nexts += [(tree, node, lo, hi, depth + min(LEVELS, DEPTH - depth)) for node, lo, hi in level]
        if not grown:
            break
        found = {(t, node): n for t, node, n in counts(_packed(trees)).itertuples(index=False)}

        def settle(tree: int, at: int, depth: int) -> int:
            """Rows below a node; a part with few of them is a leaf again."""
            node = trees[tree][at]
            if node[0] < 0:
                return found.get((tree, at), 0)
            n = settle(tree, node[2], depth + 1) + settle(tree, node[2] + 1, depth + 1)
            if n * scale <= 1:
                node[:] = [-1, 0.0, 0, depth + expected_path(n * scale)]
            return n

        for tree, at, depth in grown:
            settle(tree, at, depth)
        # What lies below a part that is a leaf again is no longer reached.
        reached = [set(_reached(nodes)) for nodes in trees]
        todo = [(tree, at, lo, hi, depth, found.get((tree, at), 0)) for tree, at, lo, hi, depth in nexts if at in reached[tree]]
    return _packed([_compact(nodes) for nodes in trees])


def _reached(nodes: list[list]) -> list[int]:
    order = [0]
    for at in order:
        if nodes[at][0] >= 0:
            order += [nodes[at][2], nodes[at][2] + 1]
    return order


def _compact(nodes: list[list]) -> list[list]:
    """The nodes that are reached; children follow each other as before."""
    order = _reached(nodes)
    place = {at: i for i, at in enumerate(order)}
    return [[f, cut, place[child] if f >= 0 else 0, length] for f, cut, child, length in (nodes[at] for at in order)]


def grow(good: np.ndarray, everything: np.ndarray, seed: int = 7) -> Forest:
    """`grow_by` on rows at hand."""
    return grow_by(everything.min(0), everything.max(0), len(good), lambda forest: forest.counts(good), seed)


def calibrate(scores: np.ndarray, good: np.ndarray, lost: float = LOST_GOOD) -> float:
    """The cut with the best balance of kept good and rejected bad rows among
    those that reject at most `lost` of the good ones; rows above it go."""
    ok = np.sort(scores[good])
    floor = ok[min(len(ok) - 1, int(np.ceil(len(ok) * (1 - lost))) - 1)]
    bad = np.sort(scores[~good])
    bad = bad[bad > floor]
    # Halfway between the good rows and the least anomalous bad row above them.
    return float(floor if not len(bad) else (floor + bad[0]) / 2)


def base_failed(rules: str) -> Column:
    n, repeated = F.col(f"{rules}.n_words"), F.col(f"{rules}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def _box(rows: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Numbers of good and bad rows, least and greatest ratios."""
    names = [f"{end}_{r}" for end in ("lo", "hi") for r in RATIOS]

    def of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, good = ratios(batch), int((batch.quality == 1).sum())
                yield pd.DataFrame([[good, len(batch) - good, *x.min(0), *x.max(0)]], columns=["good", "bad", *names])

    schema = "good bigint, bad bigint, " + ", ".join(f"{n} double" for n in names)
    ends = rows.mapInPandas(of_batch, schema).agg(
        F.sum("good"), F.sum("bad"), *(F.min(n) for n in names if n.startswith("lo_")), *(F.max(n) for n in names if n.startswith("hi_"))).first()
    if ends[0] is None:
        return 0, 0, np.zeros(0), np.zeros(0)
    return ends[0], ends[1], np.array(ends[2:2 + len(RATIOS)]), np.array(ends[2 + len(RATIOS):])


def _leaf_counts(good: DataFrame, forest: Forest) -> pd.DataFrame:
    """`Forest.counts` of all good rows: no more than the trees have leaves."""
    sent = good.sparkSession.sparkContext.broadcast(forest)

    def of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield sent.value.counts(ratios(batch))

    return good.mapInPandas(of_batch, "tree int, node int, n bigint").groupBy("tree", "node").agg(F.sum("n").alias("n")).toPandas()


def kth(values: DataFrame, column: str, k: int) -> float:
    """The k-th least value, from 0: ever finer counts in bins, none of them
    collected but its bounds and size."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        inside = values.where(F.col(column).between(lo, hi))
        bins = inside.groupBy(F.floor((F.col(column) - lo) / (hi - lo) * BINS).alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy("bin").collect()
        for b in bins:
            if k < b.n:
                lo, hi = b.lo, b.hi
                break
            k -= b.n
    return float(lo)


def calibrate_all(scored: DataFrame, n_good: int, lost: float = LOST_GOOD) -> float:
    """`calibrate` on all rows of (score, quality)."""
    floor = kth(scored.where("quality = 1"), "score", min(n_good - 1, int(np.ceil(n_good * (1 - lost))) - 1))
    bad = scored.where((F.col("quality") == 0) & (F.col("score") > floor)).agg(F.min("score")).first()[0]
    return floor if bad is None else (floor + bad) / 2


def _anomaly(forest: Forest, spark) -> Callable:
    sent = spark.sparkContext.broadcast(forest)  # TREES trees of bounded depth and size

    @F.pandas_udf("double")
    def anomaly(rules: pd.DataFrame) -> pd.Series:
        return pd.Series(sent.value.score(ratios(rules)))

    return anomaly


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts as struct `rules`, base_failed, anomaly and kept, one row
    per row of `docs`."""
    spark = docs.sparkSession
    ship_package(spark)
    counted = staged(docs.select(F.col(key), with_rules(F.col(text)).alias("rules")), "text-rules")
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(key).agg(
        F.max("quality").cast("int").alias("quality"))
    labelled = staged(counted.where(~base_failed("rules")).join(known, key).select("quality", "rules"), "labelled-rules")
    rows = labelled.select("quality", "rules.*")
    out = counted.withColumn("base_failed", base_failed("rules"))
    n_good, n_bad, low, high = _box(rows)
    if not n_good or not n_bad:
        return out.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    good = rows.where("quality = 1")
    anomaly = _anomaly(grow_by(low, high, n_good, lambda forest: _leaf_counts(good, forest)), spark)
    scored = staged(labelled.select("quality", anomaly("rules").alias("score")), "labelled-scores")
    cut = calibrate_all(scored, n_good)
    out = out.withColumn("anomaly", anomaly("rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= cut))


def quality_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    judged = judge_quality(docs, labels, key)
    return judged.select(key, *(f"rules.{f}" for f in FIELDS if f in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "anomaly")
