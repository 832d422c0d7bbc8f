"""Small helpers shared by the training-data operators."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import chartlore
from chartlore.session import staged

MAX_BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_model() -> str:
    """The public word-end BPE file; CHARTLORE_BPE names another one."""
    if found := os.environ.get("CHARTLORE_BPE"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bounded_rows(labelled: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About `bound` rows of `labelled` (all, if it has no more), chosen by the
    hash of the key, written once to the shared folder. At this size they may be
    broadcast: the hint is given only after the count."""
    scale, n = 1 << 30, labelled.count()
    share = int(scale * min(1.0, bound / max(1, n)))
    rows = staged(labelled.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(scale)) < share), "labelled-rows")
    return F.broadcast(rows) if min(n, 2 * bound) <= MAX_BROADCAST_ROWS else rows


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that
    functions which run there can be imported wherever the driver found them."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root, folder = Path(chartlore.__file__).parent, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file while it runs
    path = Path(folder, "chartlore-package.zip")
    with zipfile.ZipFile(path, "w") as package:
        for file in sorted(root.rglob("*.py")):
            package.write(file, str(Path(root.name, file.relative_to(root))))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
