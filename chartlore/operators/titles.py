"""The cross-list title index and its lookups."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.functions.credits import primary_artist
from chartlore.functions.text import match_key
from chartlore.operators.history import with_keys

INDEXED_KINDS = ("song", "album")
REQUIRED = ("chart", "date", "rank", "title", "artist")


def missing_columns(frame: DataFrame) -> list[str]:
    """Required columns a source lacks, to be reported rather than skipped."""
    return [c for c in REQUIRED if c not in frame.columns]


def title_index(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per (title key, artist key, list): spelling and credit first
    seen, peak, distinct weeks, debut. Song and album lists only.

    The date set of a title on one list is bounded by that list's calendar, so
    counting it in place keeps the build to a single shuffle.
    """
    lacking = missing_columns(entries)
    if lacking:
        raise ValueError(f"title_index: source lacks columns {', '.join(lacking)}")
    lists = registry.filter(F.col("kind").isin(*INDEXED_KINDS)).select("chart", "label", "kind")
    first = F.struct("date", "rank", "title", "artist")
    rows = with_keys(entries.dropna(subset=["title", "artist", "rank", "date"]))
    return (
        rows.groupBy("chart", "k_title", "k_artist").agg(
            F.min(first).alias("f"), F.min("rank").alias("peak"),
            F.size(F.collect_set("date")).alias("weeks"))
        .join(lists, "chart")
        .select("k_title", "k_artist", F.trim("f.title").alias("display"),
                F.trim("f.artist").alias("credit"), "peak", "weeks",
                F.col("f.date").alias("debut"), "chart", "label", "kind"))


@dataclass(frozen=True)
class StoredIndex:
    """A saved title index: the same rows by title key and by its first letter."""

    by_title: DataFrame
    by_letter: DataFrame


def history_version(entries: DataFrame) -> str:
    """Names the rows an index is built from, whatever their order: their number
    and two sums over their hashes, from one scan with partial sums."""
    h = F.xxhash64(*[c for c in REQUIRED if c in entries.columns])
    row = entries.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("a"),
                      F.sum(F.xxhash64(h).cast("decimal(20,0)")).alias("b")).first()
    return hashlib.sha256(f"{row.n}/{row.a}/{row.b}".encode()).hexdigest()[:16]


def _index_names(name: str, version: str) -> tuple[str, str]:
    return f"{name}_{version}", f"{name}_{version}_letters"


def save_title_index(index: DataFrame, name: str, version: str, path: str, buckets: int) -> None:
    """Saves the index of one version of the history as two bucketed tables under
    `path`, each row twice. By title key, sorted by key: a lookup of a title reads
    one bucket, and what is grouped by title or by more needs no shuffle. By the
    key's first letter, dealt out and sorted by key: a lookup by prefix reads one
    bucket and skips files and row groups; a common letter is several files.
    Tables of other versions stay as they are, so readers of an older one are not
    disturbed."""
    by_title, by_letter = _index_names(name, version)
    (index.repartition(buckets, "k_title").write.mode("overwrite").option("path", f"{path}/{by_title}")
     .bucketBy(buckets, "k_title").sortBy("k_title", "k_artist").saveAsTable(by_title))
    (index.withColumn("letter", F.substring("k_title", 1, 1)).repartitionByRange("letter", "k_title").write.mode("overwrite")
     .option("path", f"{path}/{by_letter}").bucketBy(buckets, "letter").sortBy("letter", "k_title").saveAsTable(by_letter))


def stored_title_index(spark: SparkSession, name: str, version: str) -> StoredIndex | None:
    """The saved index of that version, or None: an index of another history is
    not used."""
    by_title, by_letter = _index_names(name, version)
    if not (spark.catalog.tableExists(by_title) and spark.catalog.tableExists(by_letter)):
        return None
    return StoredIndex(spark.table(by_title), spark.table(by_letter))


def lookup(index: DataFrame, title: str, credit: str, kind: str, exclude: str | None = None, origin_debut: str | None = None) -> DataFrame:
    """Every list of that kind a title reached, but for `exclude`: best peak, then
    most weeks, first. `later` is null without a debut to compare with. The key
    is a constant, so only its bucket is read."""
    found = index.filter((F.col("k_title") == match_key(F.lit(title))) & (F.col("k_artist") == primary_artist(F.lit(credit)))
                         & (F.col("kind") == kind))
    if exclude is not None:
        found = found.filter(F.col("chart") != exclude)
    return found.select("chart", "label", "debut", "peak", "weeks", (F.col("debut") > F.lit(origin_debut).cast("date")).alias("later")).orderBy(
        "peak", F.desc("weeks"), "chart")


def crossovers(index: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (k_title, k_artist, kind, origin, origin_debut): every
    other list of that kind the title reached. `later` is null when the origin
    has no debut to compare with. A title's lists come by peak, then weeks."""
    runs = index.select("k_title", "k_artist", "kind", "chart", "label", "debut", "peak", "weeks")
    return (
        asked.join(runs, ["k_title", "k_artist", "kind"])
        .filter(~F.col("chart").eqNullSafe(F.col("origin")))
        .select("k_title", "k_artist", "kind", "origin", "chart", "label", "debut", "peak", "weeks",
                (F.col("debut") > F.col("origin_debut")).alias("later"))
        .orderBy("k_title", "k_artist", "kind", "peak", F.desc("weeks"), "chart"))


def all_crossovers(index: DataFrame) -> DataFrame:
    """`crossovers` of every title from its first list, in one read of the index:
    the first list comes from a window over the title, which a table bucketed by
    title satisfies without a shuffle. A title's lists stand together, by peak,
    then weeks."""
    title = ["k_title", "k_artist", "kind"]
    first = F.min(F.struct("debut", "chart")).over(W.partitionBy(*title))
    rows = index.select(*title, "chart", "label", "debut", "peak", "weeks").withColumn("first", first)
    rows = rows.filter(F.col("chart") != F.col("first.chart")).select(
        *title, F.col("first.chart").alias("origin"), "chart", "label", "debut", "peak", "weeks",
        (F.col("debut") > F.col("first.debut")).alias("later"))
    return rows.sortWithinPartitions(*title, "peak", F.desc("weeks"), "chart")


def origins(index: DataFrame) -> DataFrame:
    """Per title and kind its first list, as the question for `crossovers`."""
    first = F.min(F.struct("debut", "chart"))
    return (index.groupBy("k_title", "k_artist", "kind").agg(first.alias("o"))
            .select("k_title", "k_artist", "kind", F.col("o.chart").alias("origin"),
                    F.col("o.debut").alias("origin_debut")))


def _prefixed(index: DataFrame, kind: str, prefix: str) -> DataFrame:
    """Rows of a kind by key prefix; of an index by letter one bucket is read."""
    rows = index.filter(F.col("kind") == kind)
    needle = prefix.strip().lower()
    if needle and "letter" in index.columns:
        rows = rows.filter(F.col("letter") == needle[0])
    return rows.filter(F.startswith("k_title", F.lit(needle))) if needle else rows


def title_pool(index: DataFrame, kind: str, prefix: str = "", limit: int = 50) -> DataFrame:
    """Distinct display titles by key prefix."""
    return _prefixed(index, kind, prefix).select("display").distinct().orderBy("display").limit(limit)


def suggest(index: DataFrame, kind: str, prefix: str = "", limit: int = 20) -> DataFrame:
    """(title, artist) pairs by key prefix, those on most lists first. `credit`
    is for display, `artist` for the next lookup."""
    first = F.min(F.struct("debut", "chart", "display", "credit"))
    return (
        _prefixed(index, kind, prefix).groupBy("k_title", "k_artist")
        .agg(first.alias("f"), F.count("*").cast("int").alias("charts"))
        .select("k_title", F.col("f.display").alias("title"), F.col("f.credit").alias("credit"),
                F.col("k_artist").alias("artist"), "charts")
        .orderBy(F.desc("charts"), "k_title", "artist").limit(limit).drop("k_title"))


def image_index(entries: DataFrame) -> DataFrame:
    """(k_title, k_artist) -> first real artwork address over all lists."""
    return (
        with_keys(entries.filter(F.startswith("image_url", F.lit("http"))))
        .groupBy("k_title", "k_artist")
        .agg(F.min_by("image_url", F.struct("chart", "date", "rank")).alias("found_url")))


def fill_image(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Blank artwork filled from any list that has the title."""
    own: Column = F.when(F.startswith("image_url", F.lit("http")), F.col("image_url"))
    return (
        with_keys(rows).join(images, ["k_title", "k_artist"], "left")
        .withColumn("image_url", F.coalesce(own, "found_url", F.lit("")))
        .drop("found_url", "k_title", "k_artist"))
