"""Session defaults for local runs and tests; a cluster brings its own."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chartlore")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; a fresh temporary one
    only where none is set and executors share this machine, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_STAGED: dict[str, list[str]] = {}


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back. Used where a
    result feeds several branches or a loop: later steps start from files that
    outlive an executor, and their sizes are known to the planner. `drop_staged`
    deletes them when what was made from them has been written."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    _STAGED.setdefault(frame.sparkSession.sparkContext.applicationId, []).append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def staged_count(spark: SparkSession) -> int:
    """How many frames this application has staged: a mark for `drop_staged`."""
    return len(_STAGED.get(spark.sparkContext.applicationId, []))


def drop_staged(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes what was staged after a mark, but for the last one if that is kept.
    Frames still to be read from these files must have been written elsewhere."""
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    end = len(paths) - keep_last
    for path in paths[since:end]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del paths[since:end]
