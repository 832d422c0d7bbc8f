"""A keyed sink for streams: base, tail and manifest.

Each micro-batch overwrites its own folder of the tail, so a batch replayed
after a failure writes the same rows again instead of adding them. After a
number of batches the tail is merged into a new base, and then one row of the
manifest says which base counts and up to which batch it reaches. Readers take
the newest manifest row and only the tail beyond it: before that row is
committed they see the old base and the whole tail, afterwards the new base,
never both. What the last two manifest rows don't need is deleted, so the number
of files stays bounded and a reader that has just looked up the row before the
newest still finds its files.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE_EVERY = 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MANIFEST = "generation int, base string, upto bigint"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """Parquet files under a path, None where there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _generations(spark: SparkSession, path: str) -> list:
    """Manifest rows, newest first; one row where none has been committed."""
    found = _read(spark, f"{path}/manifest")
    rows = [] if found is None else found.select("generation", "base", "upto").orderBy(F.desc("generation")).collect()
    return rows or spark.createDataFrame([(0, None, -1)], _MANIFEST).collect()


def _visible(spark: SparkSession, path: str, generation) -> DataFrame | None:
    """Rows of a generation with the batch they came from."""
    base = _read(spark, generation.base) if generation.base else None
    tail = _read(spark, f"{path}/tail")
    if tail is not None:
        tail = tail.withColumn("batch", F.col("batch").cast("bigint")).filter(F.col("batch") > generation.upto)
    parts = [p for p in (base, tail) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _latest(rows: DataFrame, keys: list[str] | None) -> DataFrame:
    if not keys:
        return rows
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"), F.max("batch").alias("batch")).select(
        *keys, *[f"s.{c}" for c in rest], "batch")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def merge_tail(spark: SparkSession, path: str, upto: int, keys: list[str] | None) -> None:
    """Makes a new generation of all batches up to one. Run again after a failure
    at any point it gives the same state."""
    rows = _generations(spark, path)
    last = rows[0]
    if last.upto >= upto:
        return
    visible = _visible(spark, path, last)
    if visible is None:
        return
    base = f"{path}/base/{last.generation + 1}"
    _latest(visible.filter(F.col("batch") <= upto), keys).write.mode("overwrite").parquet(base)
    commit(spark, path, last.generation + 1, base, upto)
    for old in rows[1:]:  # what the generation before the newest doesn't need either
        if old.base:
            _delete(spark, old.base)
        if old.generation:
            _delete(spark, f"{path}/manifest/v={old.generation}")
    for batch in range(rows[1].upto + 1 if len(rows) > 1 else 0, last.upto + 1):
        _delete(spark, f"{path}/tail/batch={batch}")


def commit(spark: SparkSession, path: str, generation: int, base: str, upto: int) -> None:
    """One manifest row: a single small file that appears when its write commits."""
    (spark.createDataFrame([(generation, base, upto)], _MANIFEST).coalesce(1).write.mode("overwrite")
     .parquet(f"{path}/manifest/v={generation}"))


def batch_writer(path: str, keys: list[str] | None = None, every: int = MERGE_EVERY) -> Callable[[DataFrame, int], None]:
    """foreachBatch function. With keys the rows of a later batch replace those of
    an earlier one, without all rows stay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/tail/batch={batch_id}")
        if batch_id % every == every - 1:
            merge_tail(batch.sparkSession, path, batch_id, keys)

    return write


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a sink without keys."""
    return _visible(spark, path, _generations(spark, path)[0]).drop("batch")


def latest_by_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest state of every key written so far."""
    return _latest(_visible(spark, path, _generations(spark, path)[0]), keys).drop("batch")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", keys: list[str] | None = None,
                  every: int = MERGE_EVERY) -> None:
    """Drains what the source holds now into the sink. State is kept in RocksDB,
    whose size is bounded by disk and not by the heap; the session's own setting
    comes back once the query has taken it."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(batch_writer(path, keys, every))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    query.awaitTermination()
