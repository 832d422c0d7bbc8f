"""Near-duplicates by order MinHash, verified by banded alignment.

Shingles of five words are labelled by their occurrence. Each of `SKETCHES` hash
functions picks the `PICKED` least ones of a text, and these, in text order, make
one sketch key: texts meet in a bucket if they share such shingles in the same
order, which happens the more, the closer they are by edits. With a similarity of
0.8, two texts miss each other in every bucket once in a million.

Texts are copies, and one representative stands for them, if they are equal. In
`CENTRES` rounds the members of a bucket are compared with its centre, the member
whose own buckets are largest, as the text in the middle of a group of variants
shares most with the others; classes merge after each round. Buckets that then
still hold several classes compare all pairs of different classes: each text has
a parity bitmap of its shingles, and as two bitmaps differ in no more bits than
two texts in shingles, pairs that differ in too many bits can't be similar. All
others are verified, so that two similar texts of one bucket share a class. Large
buckets are compared in pairs of blocks, by several tasks.

A pair is verified by aligning the two shingle sequences inside the band that a
similarity of 0.8 allows; with m aligned of a and b shingles the similarity is
m / (a + b - m). It equals the Jaccard measure where the order agrees.

Texts without words, null included, resemble nothing and form classes of their
own. Repeated rows get the class of their text. Rows need no unique id; a class
is named by the least id in it (null if all its ids are null).
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package
from chartlore.llm.rolling import RangeHash, stir
from chartlore.session import staged

WORDS = 5
SIMILAR = 0.8
PICKED = 3
SKETCHES = 20
CENTRES = 2
BLOCK = 2048
LEAST_BITS = 512
_SLICE = 256
_LABEL = np.uint64(0x9E3779B97F4A7C15)


def _salts(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def labelled_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the word runs in order, each with the number of equal ones
    before it. A text with fewer words is one run; without words there is none."""
    raw = " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(0, np.uint64)
    blanks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)
    start, end = np.append(0, blanks + 1), np.append(blanks, len(raw))
    last = words - 1
    if len(start) < words:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[:len(start) - last], end[last:]
    runs = RangeHash(raw).ranges(start, end)
    _, kind, times = np.unique(runs, return_inverse=True, return_counts=True)
    if len(times) == len(runs):
        return runs
    order = np.argsort(kind, kind="stable")
    earlier = np.empty(len(runs), np.uint64)
    earlier[order] = (np.arange(len(runs)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    return np.where(earlier > 0, stir(runs + earlier * _LABEL), runs)


def sketch_keys(runs: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One key per hash function, of the least runs in text order."""
    n = len(runs)
    if not n:
        return np.zeros(0, np.int64)
    salts = _salts(sketches)
    if n <= picked:
        at = np.tile(np.arange(n), (sketches, 1))
    else:
        at = np.empty((sketches, picked), np.int64)
        for i, salt in enumerate(salts):
            at[i] = np.argpartition(stir(runs * salt), picked - 1)[:picked]
        at.sort(axis=1)
    key = salts.copy()
    for column in range(at.shape[1]):
        key = stir(key * np.uint64(31) + runs[at[:, column]])
    return key.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence within the band, one bit per
    element of `a`."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places = {int(v): 1 << i for i, v in enumerate(a)}  # labelled runs differ
    full, width = (1 << len(a)) - 1, (1 << (2 * band + 1)) - 1
    open_bits = full
    for j, v in enumerate(b.tolist()):
        place = places.get(v, 0)
        low = j - band
        hit = open_bits & place & (width << low if low >= 0 else width >> -low)
        if hit:
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return head + tail + len(a) - open_bits.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned share of two run sequences; 0 where it can't reach `least`."""
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    if common < least * (small + large - common):
        return 0.0  # the order can only take away from this
    band = int((small + large) * (1 - least) / (1 + least)) + 1
    m = aligned(a, b, band)
    return m / (small + large - m)


def parity_bits(runs: np.ndarray) -> bytes:
    """One bit per slot: whether an odd number of runs falls into it. There are
    at least as many slots as runs, a power of two."""
    slots = max(LEAST_BITS, 1 << max(0, len(runs) - 1).bit_length())
    odd = np.bincount((stir(runs * _LABEL) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_near(n: np.ndarray, classes: np.ndarray, side: np.ndarray, bits: list[bytes], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of texts of different classes whose sizes and bitmaps allow a
    similarity of `least`. Where both sides occur, pairs are across them."""
    kinds, kind, times = np.unique(classes, return_inverse=True, return_counts=True)
    apart, widths = bool(side.any() and not side.all()), np.array([len(b) for b in bits])
    share, left, right = (1 - least) / (1 + least), [], []
    for width in np.unique(widths):
        # The narrower of two bitmaps counts; the other is folded to its width.
        at = np.flatnonzero((widths >= width) & (widths <= 4 * width))
        words = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, width // 8), axis=0) for i in at])
        some = np.flatnonzero(kind[at] != times.argmax())  # the largest class meets itself in no pair
        step = max(1, (16 << 20) // (len(at) * int(width)))
        for start in range(0, len(some), step):
            rows = some[start:start + step]
            a, b = at[rows][:, None], at[None, :]
            differ = np.bitwise_count(words[rows][:, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
            ok = (kind[a] != kind[b]) & (np.minimum(widths[a], widths[b]) == width) & (differ <= share * (n[a] + n[b]) + 1e-6)
            ok &= np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])
            if apart:
                ok &= side[a] != side[b]
            x, y = np.nonzero(ok)
            left.append(at[rows[x]])
            right.append(at[y])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rid, n, keys, bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                runs = [labelled_shingles(t.as_py()) for t in part.column("text")]
                keys = pa.array([sketch_keys(r) for r in runs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("rid"), pa.array([len(r) for r in runs], pa.int32()), keys,
                     pa.array([parity_bits(r) for r in runs], pa.binary())],
                    names=["id", "rid", "n", "keys", "bits"])

    rows = docs.select(F.col(key).alias("id"), content_id(F.col(text)).alias("rid"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, rid bigint, n int, keys array<bigint>, bits binary")


def _packed(text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for texts in batches:
            for at in range(0, len(texts), _SLICE):
                yield pd.Series([squeeze.compress((t or "").encode("utf-8", "surrogatepass"))
                                 for t in texts.iloc[at:at + _SLICE]], dtype=object)

    return run(text)


def content_id(text: Column) -> Column:
    """Names a text by 64 bits that two hash functions and the length go into."""
    return F.xxhash64(text, F.crc32(text), F.octet_length(text))


def _unpack(squeeze: zstandard.ZstdDecompressor, packed: bytes) -> np.ndarray:
    return labelled_shingles(squeeze.decompress(packed).decode("utf-8", "surrogatepass"))


def _verified(a: Column, b: Column, least: float) -> Column:
    """Similarity of two packed texts. Declared non-deterministic, so that a
    filter on it isn't pushed below and each pair aligned twice."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdDecompressor()
        for left, right in batches:
            yield pd.Series([similarity(_unpack(squeeze, x), _unpack(squeeze, y), least) for x, y in zip(left, right)], dtype=float)

    return run.asNondeterministic()(a, b)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, class) after the classes that links join have become one: least
    labels travel along links between classes, with shortcuts, until none moves.
    Works on class names alone, written to the shared folder at every step."""
    ends = links.join(labels.withColumnRenamed("rid", "a").withColumnRenamed("class", "ca"), "a").join(
        labels.withColumnRenamed("rid", "b").withColumnRenamed("class", "cb"), "b").where("ca <> cb").select("ca", "cb")
    edges = staged(ends.union(ends.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct(), "class-links")
    names = staged(edges.select(F.col("ca").alias("c")).distinct().withColumn("to", F.col("c")), "class-names")
    while True:
        near = edges.join(names.withColumnRenamed("c", "cb"), "cb").groupBy(F.col("ca").alias("c")).agg(F.min("to").alias("near"))
        moved = names.join(near, "c", "left").select(
            "c", F.least("to", F.coalesce("near", "to")).alias("next"), F.col("to").alias("old"))
        ahead = names.select(F.col("c").alias("next"), F.col("to").alias("jump"))
        step = staged(moved.join(ahead, "next", "left").select(
            "c", F.least("next", F.coalesce("jump", "next")).alias("to"), "old"), "class-names")
        if step.where("to <> old").isEmpty():
            break
        names = step.select("c", "to")
    return labels.join(names.withColumnRenamed("c", "class"), "class", "left").select(
        "rid", F.coalesce("to", "class").alias("class"))


def text_classes(docs: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and per distinct text its copies, links, class id and
    `keep`: whether it holds the least id of its class."""
    ship_package(docs.sparkSession)
    rows = staged(_sketched(docs, key, text), "sketched")
    # A text per content; null, empty and blank texts are not compared.
    members = rows.where("n > 0").groupBy("rid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    # One exchange by bucket serves the sizes and the join with them. A text is
    # in SKETCHES buckets, so none holds more than that part of the rows.
    keys = members.select("rid", "n", F.posexplode("keys").alias("no", "key")).select(
        "rid", "n", F.xxhash64("no", "key").alias("bucket")).repartition("bucket")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = staged(keys.join(sizes.hint("merge"), "bucket"), "shared-buckets")
    weight = shared.groupBy("rid").agg(F.sum("size").alias("weight"))
    places = staged(shared.join(weight, "rid").select("bucket", "rid", "n", "weight"), "bucket-places")
    # Texts and pairs grow with the corpus: no side of these joins is broadcast.
    texts = docs.select(content_id(F.col(text)).alias("rid"), _packed(F.col(text)).alias("packed")).join(
        places.select("rid").distinct().hint("merge"), "rid", "left_semi").groupBy("rid").agg(F.first("packed").alias("packed"))
    texts = staged(texts, "compared-texts")
    labels = staged(texts.select("rid", F.col("rid").alias("class")), "classes")
    bits = rows.where("n > 0").groupBy("rid").agg(F.first("bits").alias("bits"))
    links, tried, centres = [], [], []
    for last in [False] * CENTRES + [True]:
        if last:
            pairs = _all_pairs(places, labels, bits, least)
        else:
            pairs, centre, places = _round_pairs(places, labels, tried, centres, least)
            tried.append(pairs)
            centres.append(centre)
        left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("packed").alias("pa")).hint("merge"), "a")
        both = left.join(texts.select(F.col("rid").alias("b"), F.col("packed").alias("pb")).hint("merge"), "b")
        found = both.select("a", "b", _verified(F.col("pa"), F.col("pb"), least).alias("similarity"))
        found = staged(found.where(F.col("similarity") >= least), "near-links")
        links.append(found)
        if not found.isEmpty():
            labels = staged(_merged(labels, found), "classes")
    links = reduce(DataFrame.union, links)
    ends = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("n_links"))
    copies = rows.groupBy("rid").agg(F.count("*").alias("n_copies"), F.min("id").alias("least_id"), F.max("n").alias("n"))
    named = copies.join(labels, "rid", "left").withColumn("class", F.coalesce("class", "rid"))
    ids = named.groupBy("class").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "rid")).alias("first"))
    named = named.join(ids, "class").join(ends, "rid", "left").select(
        "rid", "n", "n_copies", "least_id", F.col("first.least_id").alias("class_id"), (F.col("first.rid") == F.col("rid")).alias("keep"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows, staged(named, "class-rows")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per row of `docs`: the key, `class_id` (least key of its class),
    `n_links` (verified links of its text) and `n_copies` (rows of equal text)."""
    rows, named = text_classes(docs, key, text, least)
    out = rows.select("id", "rid").join(named, "rid")
    return out.select(
        F.col("id").alias(key), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        "n_links", F.when(F.col("n") > 0, F.col("n_copies")).otherwise(F.lit(1)).alias("n_copies"))


def _round_pairs(places: DataFrame, labels: DataFrame, tried: list[DataFrame], centres: list[DataFrame],
                 least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Untried pairs (a, b) of a centre and a member, for each bucket that holds
    several classes, these centres (bucket, rid), and the places in such buckets:
    classes only merge, so the others are done. The centre is the heaviest member
    that hasn't been one of this bucket."""
    at = places.join(labels, "rid")
    spread = at.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("bucket")
    at = staged(at.join(spread, "bucket", "left_semi"), "placed-classes")
    free = at
    if centres:
        free = at.join(reduce(DataFrame.union, centres).select("bucket", "rid"), ["bucket", "rid"], "left_anti")
    centre = free.groupBy("bucket").agg(F.max_by(F.struct("rid", "n", "class"), F.struct("weight", "rid")).alias("c"))
    centre = staged(centre.select("bucket", "c.*"), "bucket-centres")
    pairs = at.join(centre.select("bucket", F.col("rid").alias("a"), F.col("n").alias("an"), F.col("class").alias("ac")), "bucket").where(
        (F.col("class") != F.col("ac")) & (F.least("n", "an") >= least * F.greatest("n", "an")))
    fresh = pairs.select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b")).distinct()
    if tried:
        fresh = fresh.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
    return staged(fresh, "candidate-pairs"), centre, at.drop("class")


def _all_pairs(places: DataFrame, labels: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes in one bucket that may be similar.

    A bucket of more than `BLOCK` members is cut into blocks by the name of the
    text; each pair of blocks is a group of its own, at most about two blocks
    large, and the groups are dealt out by name."""
    at = places.join(labels, "rid")
    spread = at.groupBy("bucket").agg(F.count("*").alias("size"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    at = at.join(spread.where("lo <> hi").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket")
    at = at.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.join(bits.hint("merge"), "rid").select(
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("part"),
        (F.col("block") > F.col("other")).alias("side"), "rid", "n", "class", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(part: pa.Table) -> pa.RecordBatch:
            rid = part.column("rid").to_numpy()
            a, b = may_be_near(part.column("n").to_numpy().astype(np.int64), part.column("class").to_numpy(),
                               part.column("side").to_numpy(), part.column("bits").to_pylist(), least)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(rid[a], rid[b])), pa.array(np.maximum(rid[a], rid[b]))], names=["a", "b"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            if held and held[-1].column(0)[0].as_py() != part[0]:
                yield pairs(pa.Table.from_batches(held))
                held = []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                held.append(batch.slice(start, end - start))
                if end < len(part):
                    yield pairs(pa.Table.from_batches(held))
                    held = []
        if held:
            yield pairs(pa.Table.from_batches(held))

    return staged(at.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a bigint, b bigint").distinct(), "candidate-pairs")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """`docs` with one row of each class, one with the least id. Texts without
    words all stay. The documents are shuffled once, by their text's name."""
    _, named = text_classes(docs, key, text, least)
    named = named.where("keep").select("rid", "n", "least_id")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    empty = F.coalesce(F.trim("text") == "", F.lit(True))
    rest = rows.where(~empty).withColumn("rid", content_id(F.col("text"))).join(named, "rid")
    rest = rest.where((F.col("n") == 0) | F.col("id").eqNullSafe(F.col("least_id")))
    again = F.row_number().over(Window.partitionBy("rid").orderBy("id"))
    rest = rest.withColumn("again", again).where("n = 0 OR again = 1")
    return rest.select("row.*").union(rows.where(empty).select("row.*"))
