"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash. All rows start in
one bucket; a bucket whose bytes exceed the limit splits on its next bit, the
others stay whole, until every shard fits. Buckets are never listed row by row:
bytes are summed per hash prefix, at a depth that follows from the total, with
partial sums before the shuffle, and every prefix counts for its ancestors too.
A prefix that is still too large at that depth is looked at again, alone, with
more bits.

Rows of one key share the key's bits; further bits come from the hash of the
text, so that a hot key spreads over many shards. Only a row that alone exceeds
the limit, or rows equal in key and text, can leave a shard above it.

Null texts count as no bytes; a null key is a key like any other. Repeated rows
go to the same shard. An empty table gives no shards. All work is done by
Spark's own functions.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.session import staged

LIMIT = 1 << 20
SPARE_BITS = 3
MORE_BITS = 8
KEY_BITS = 48
ALL_BITS = 96


def _bits(text: Column, skip: int = 0) -> Column:
    """48 bits of the MD5 of a text, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1 + skip, 12), 16, 2), KEY_BITS, "0")


def prefix(key: Column, text: Column, depth: int) -> Column:
    """The first `depth` bits: the key's, then the text's."""
    key = _bits(F.coalesce(key.cast("string"), F.lit("")))
    if depth <= KEY_BITS:
        return F.substring(key, 1, depth) if depth else F.lit("")
    return F.concat(key, F.substring(_bits(F.coalesce(text, F.lit(""))), 1, depth - KEY_BITS))


def directory_leaves(cells: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(cell, level) of cells (prefixes of `depth` bits with bytes and rows):
    the shortest length from `above` on whose bucket fits or holds one row; null
    where even the cell does not."""
    steps = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("level")).withColumn(
        "prefix", F.expr("substring(cell, 1, level)"))
    fits = steps.groupBy("level", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).where(
        (F.col("bytes") <= limit) | (F.col("rows") == 1)).select("level", "prefix")
    shortest = steps.select("cell", "level", "prefix").join(fits, ["level", "prefix"], "left_semi").groupBy("cell").agg(
        F.min("level").alias("level"))
    return cells.select("cell").join(shortest, "cell", "left")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with `shard` (its bits), `shard_depth` and `n_bytes`; new names."""
    sizes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    total = docs.agg(F.sum(sizes)).first()[0] or 0
    depth = min(ALL_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    above, open_cells, rounds = 0, None, []
    while True:
        rows = docs.select(prefix(F.col(key), F.col(text), depth).alias("cell"), sizes.alias("size"),
                           *([prefix(F.col(key), F.col(text), above - 1).alias("open")] if open_cells is not None else []))
        if open_cells is not None:
            rows = rows.join(open_cells.withColumnRenamed("cell", "open"), "open", "left_semi")
        cells = staged(rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-cells")
        leaves = directory_leaves(cells, above, depth, limit)
        if depth == ALL_BITS:
            leaves = leaves.withColumn("level", F.coalesce("level", F.lit(depth)))
        leaves = staged(leaves, "shard-directory")
        rounds.append((depth, leaves))
        open_cells = leaves.where("level IS NULL").select("cell")
        if depth == ALL_BITS or open_cells.isEmpty():
            break
        above, depth = depth + 1, min(ALL_BITS, depth + MORE_BITS)
    # Each row's cell names its leaf; cells without one are in the next directory.
    out = docs.withColumn("n_bytes", sizes)
    level = F.lit(None).cast("int")
    for n, (depth, leaves) in enumerate(rounds):
        out = out.withColumn(f"_cell{n}", prefix(F.col(key), F.col(text), depth)).join(
            leaves.where("level IS NOT NULL").select(F.col("cell").alias(f"_cell{n}"), F.col("level").alias(f"_level{n}")), f"_cell{n}", "left")
        level = F.coalesce(level, F.col(f"_level{n}"))
    longest = F.col(f"_cell{len(rounds) - 1}")
    out = out.withColumn("shard_depth", level).withColumn("shard", F.substr(longest, F.lit(1), F.col("shard_depth")))
    return out.drop(*(f"_{kind}{n}" for n in range(len(rounds)) for kind in ("cell", "level")))


def shard_report(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, shard, shard_depth and n_bytes of every row."""
    return assign_shards(docs.select(key, text), key, text, limit).select(key, "shard", "shard_depth", "n_bytes")
