"""Removal of repeated byte strings by a depth-limited radix sort.

Every byte covered by a `LENGTH`-byte string that starts at two or more places
goes. Only suffixes that can matter are sorted, and only through `LENGTH` bytes:

1. Of the `GRAM`-byte strings that a `LENGTH`-byte string holds, the one with the
   least hash is its anchor. Equal strings have equal anchors at the same offset,
   so strings around anchors that occur once are unique. About one position in
   seventy-five is an anchor.
2. Anchors that repeat are sorted on by whole contexts: all bytes that any string
   around the anchor can hold. Contexts that occur twice repeat entirely.
3. What is left is sorted digit by digit, most significant first. A digit halves
   the range of offsets at which a string may start before its anchor: strings
   of a half share more bytes than those of the whole. In each pass, groups
   whose shared bytes occur once drop out, groups whose full bytes agree are
   equal groups, that is repeated strings, and only the others go on. After the
   last digit a group's strings are equal in all `LENGTH` bytes.

Passes are groupings and joins of hashes with partial sums, so a passage in very
many documents is spread over tasks; bytes of texts move only where the next
digit needs them. Groups are told apart by 64-bit hashes of anchors with 64-bit
hashes of contexts or digits.

Texts are UTF-8 bytes; null counts as empty. Strings never cross texts. Repeated
rows are copies of each other and lose all strings of `LENGTH` bytes. Shorter
texts stay whole. One row comes out per row that goes in.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package
from chartlore.llm.rolling import RangeHash, stir
from chartlore.session import staged

LENGTH = 400
GRAM = 250
_SLICE = 256
_SIDE = np.uint64(0xD1B54A32D192ED03)


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of every `width` neighbours, by blocks scanned
    from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, values[-1], values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n - width + 1], ahead[width - 1:n])


def reach(at: np.ndarray, size: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of an anchor in the strings that fit the text."""
    return np.maximum(0, length - (size - at)), np.minimum(length - gram, at)


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and context hashes of a text's anchors."""
    size, width = len(raw), length - gram + 1
    if size < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = RangeHash(raw)
    start = np.arange(size - gram + 1)
    grams = hashes.ranges(start, start + gram)
    least = sliding(grams, width)
    # A gram is an anchor if the least of some string that holds it is its own.
    edge = np.zeros(width - 1, least.dtype)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    low, high = reach(at, size, length, gram)
    context = hashes.ranges(at - high, at - low + length)
    return at, grams[at], stir(context + high.astype(np.uint64) * _SIDE)


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(rid, pos, h, c) of all anchors of (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _SLICE):
                part = batch.slice(first, _SLICE)
                rids, columns = part.column(0).to_numpy(zero_copy_only=False), ([], [], [], [])
                for rid, text in zip(rids, part.column(1)):
                    at, grams, contexts = anchors((text.as_py() or "").encode("utf-8", "surrogatepass"), length, gram)
                    for column, values in zip(columns, (np.full(len(at), rid), at, grams.view(np.int64), contexts.view(np.int64))):
                        column.append(values)
                rid, at, grams, contexts = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(grams), pa.array(contexts)],
                    names=["rid", "pos", "h", "c"])

    return texts.select("rid", "text").mapInArrow(run, "rid bigint, pos int, h bigint, c bigint")


def _packed(text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for texts in batches:
            for at in range(0, len(texts), _SLICE):
                yield pd.Series([squeeze.compress((t or "").encode("utf-8", "surrogatepass"))
                                 for t in texts.iloc[at:at + _SLICE]], dtype=object)

    return run(text)


def _contexts(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes left and right of the wanted anchors (rid, pos, h, m): those
    that strings around the anchor hold besides the gram."""
    places = wanted.groupBy("rid").agg(F.collect_list(F.struct("pos", "h", "m")).alias("places"))
    joined = texts.select("rid", _packed(F.col("text")).alias("packed")).join(places, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            for rid, packed, places in zip(*(batch.column(i) for i in range(3))):
                raw, places = squeeze.decompress(packed.as_py()), places.as_py()
                at = np.array([p["pos"] for p in places], np.int64)
                low, high = reach(at, len(raw), length, gram)
                yield pa.RecordBatch.from_arrays([
                    pa.array([rid.as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32)),
                    pa.array([p["h"] for p in places], pa.int64()), pa.array([p["m"] for p in places], pa.int32()),
                    pa.array([raw[p - hi:p] for p, hi in zip(at, high)], pa.binary()),
                    pa.array([raw[p + gram:p - lo + length] for p, lo in zip(at, low)], pa.binary())],
                    names=["rid", "pos", "grp", "m", "lhs", "rhs"])

    return joined.select("rid", "packed", "places").mapInArrow(
        run, "rid bigint, pos int, grp bigint, m int, lhs binary, rhs binary")


def _tail(bytes_: Column, n: Column) -> Column:
    return F.substr(bytes_, F.greatest(F.length(bytes_) - n, F.lit(0)) + 1, n)


def _halves(state: DataFrame) -> DataFrame:
    """Both halves of every row's range of offsets a..b, where the text reaches.

    `lhs` holds the bytes from b to a before the anchor, `rhs` those that end
    strings of offsets b to a. What all strings of a half share goes into its
    group; the rest stays."""
    a, b, left, right = F.col("a"), F.col("b"), F.col("lhs"), F.col("rhs")
    mid = F.expr("(a + b) div 2").cast("int")
    more, less = b - mid, mid + 1 - a  # bytes that the near and the far half fix
    near = F.struct(
        a.alias("a"), mid.alias("b"), F.xxhash64("grp", F.lit(1), F.substr(right, F.lit(1), more)).alias("grp"),
        _tail(left, mid - a).alias("lhs"), F.substr(right, more + 1, F.length(right)).alias("rhs"))
    far = F.struct(
        (mid + 1).alias("a"), b.alias("b"), F.xxhash64("grp", F.lit(2), _tail(left, less)).alias("grp"),
        F.substr(left, F.lit(1), F.greatest(F.length(left) - less, F.lit(0))).alias("lhs"),
        F.substr(right, F.lit(1), b - mid - 1).alias("rhs"))
    halves = F.array(F.when(F.length(right) >= more, near), F.when(F.length(left) >= less, far))
    out = state.where("a < b").select("rid", "pos", "m", F.explode(halves).alias("x")).where("x IS NOT NULL")
    return out.select("rid", "pos", "m", "x.*")


def _pass(state: DataFrame) -> DataFrame:
    """One digit: the rows of groups that repeat, with `times` their full bytes
    occur in the group and `kinds`, how many different full bytes it has."""
    keyed = state.withColumn("f", F.xxhash64("lhs", "rhs", F.length("lhs")))
    full = staged(keyed.groupBy("a", "grp", "f").agg(F.sum("m").alias("times")), "digit-groups")
    groups = full.groupBy("a", "grp").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).where("all > 1")
    known = staged(full.join(groups.hint("shuffle_hash"), ["a", "grp"]).select("a", "grp", "f", "times", "kinds"), "digit-kinds")
    return staged(keyed.join(known.hint("shuffle_hash"), ["a", "grp", "f"]).drop("f"), "digit-rows")


def _spans(rows: DataFrame, length: int) -> DataFrame:
    """(rid, first, last): bytes of the strings whose offsets a row's range and
    text allow."""
    low = F.greatest(F.col("a"), F.col("b") - F.length("rhs"))
    high = F.least(F.col("b"), F.col("a") + F.length("lhs"))
    return rows.where(low <= high).select("rid", (F.col("pos") - high).alias("first"), (F.col("pos") - low + length).alias("last"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid, first, last) of byte ranges whose union is what repeats, for (rid,
    text, size)."""
    width = length - gram
    long_enough = texts.where(F.octet_length("text") >= length)
    found = _anchor_rows(long_enough, length, gram)
    again = staged(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-anchors")
    # Keys of one row each are hashed; the long sides are neither sorted nor held.
    hits = staged(found.join(again.hint("shuffle_hash"), "h"), "anchor-rows")
    # Any of the equal ones stands for a context: both columns of one row.
    kinds = staged(hits.groupBy("h", "c").agg(F.count("*").alias("n"), F.first("rid").alias("rid"), F.first("pos").alias("pos")), "contexts")
    sure = hits.join(kinds.where("n > 1").select("h", "c").hint("shuffle_hash"), ["h", "c"], "left_semi")
    # Ranges that leave the text are cut to it later.
    sure = sure.select("rid", (F.col("pos") - width).alias("first"), (F.col("pos") + length).alias("last"))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("h")
    wanted = kinds.join(mixed.hint("shuffle_hash"), "h").select("rid", "pos", "h", F.least("n", F.lit(2)).cast("int").alias("m"))
    state = _contexts(long_enough, wanted, length, gram).withColumns({"a": F.lit(0), "b": F.lit(width)})
    state = staged(state, "open-contexts")
    parts = [sure]
    while not state.isEmpty():
        rows = _pass(state)
        parts.append(_spans(rows.where("m = 1 AND times > 1"), length))
        # Rows that repeat in full stay as what others may equal.
        go_on = rows.where("kinds > 1").withColumn("m", F.when(F.col("times") > 1, 2).otherwise(F.col("m")))
        state = _halves(go_on)
    return reduce(DataFrame.union, parts)


def _cleaned(packed: Column, spans: Column) -> Column:
    """What is left of a text, and the maximal removed ranges."""

    @F.pandas_udf("n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdDecompressor()
        for texts, marks in batches:
            for first in range(0, len(texts), _SLICE):
                out = []
                for blob, ranges in zip(texts.iloc[first:first + _SLICE], marks.iloc[first:first + _SLICE]):
                    raw = squeeze.decompress(blob)
                    merged: list[list[int]] = []
                    for s, e in sorted((max(0, r["first"]), min(len(raw), r["last"])) for r in ([] if ranges is None else ranges)):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    cuts = [0, *(v for m in merged for v in m), len(raw)]
                    out.append((len(raw), [{"start": s, "end": e} for s, e in merged],
                                b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))))
                yield pd.DataFrame(out, columns=["n_bytes", "removed", "kept"])

    return run(packed, spans)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """key, n_bytes, removed (maximal ranges) and kept (remaining bytes) of every row."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), text, F.crc32(text), F.octet_length(text)).alias("rid"),
                        F.coalesce(text, F.lit("")).alias("text"))
    spans = repeated_spans(texts, length, gram)
    marks = spans.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = texts.select("key", "rid", _packed(F.col("text")).alias("packed")).join(marks, "rid", "left")
    out = joined.select("key", _cleaned(F.col("packed"), F.col("spans")).alias("x"))
    return out.select(F.col("key").alias(key), "x.*")


def repeats_report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row: bytes, removed bytes and ranges, digest of what is left."""
    out = remove_repeats(docs.select(key, "text"), key, **options)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"])
    return out.select(key, "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
