"""Phrase collocation mining by direct-address tiling.

Words get ids by falling frequency within their language. A phrase of two words
is a cell of the square of ids, and since low ids are the frequent ones, most
occurrences fall into few tiles of that square: a task cuts its pairs into tiles
of `TILE` x `TILE` cells, counts the crowded ones with a dense bincount and the
rest as sorted coordinates, and passes on one row per cell. Sums of those rows
give the counts; cells below the least count go. The frequent pairs are ranked
again, get ids of their own, and two pairs that overlap in one word are a cell
of the next square: so three, four and five words follow by the same step.
Every part of a frequent phrase is as frequent, so nothing is lost.

Texts are read twice, for the words and for their ids; the later steps read
sequences of ids with a mark at every break. A dictionary of ids goes to the
workers only up to `HEAD` entries, the most frequent ones; occurrences of others
are looked up by a join, which has no hot key then. Ranks come from counts per
frequency, so no window holds a language. A candidate within a longer one of
the same count is dropped; scores are exact integers of up to 38 digits.

Null text counts as empty, null language as `und`, and both share with equal
values. Repeated rows count each time. An empty table, or one where no phrase is
frequent enough, gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package, whole_text
from chartlore.session import staged

LEAST, LONGEST, TOP = 100, 5, 2000
TILE = 1024  # ids along a side of a tile
CROWDED = TILE * TILE // 8  # pairs from which a tile is counted densely
HELD = 1 << 21  # pairs a task counts at once
HELD_WORDS = 300_000  # distinct words a task holds
BLOCK = 1 << 16  # ids of one encoded row
HEAD = 200_000  # dictionary entries sent to the workers
SALTS = 16
BREAK, OPEN = -1, -2
ENCODED = "lang string, ids binary"

_TOKEN = re.compile(rb"[^ \t\n]+|\n")
_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)


def tokens(text: str | None) -> list[bytes]:
    """Words in order, A-Z in lower case, and a line feed at every break."""
    return _TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower().translate(_BREAKS))


def cell_counts(a: np.ndarray, b: np.ndarray, tile: int = TILE, crowded: int = CROWDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) of ids with how often they occur, tile by tile."""
    across = int(b.max()) // tile + 1 if len(b) else 1
    of = (a // tile).astype(np.int64) * across + b // tile
    tiles, which, sizes = np.unique(of, return_inverse=True, return_counts=True)
    dense = sizes >= crowded
    rows, columns, counts = [], [], []
    for t in np.flatnonzero(dense):
        own = which == t
        cells = np.bincount((a[own] % tile).astype(np.int64) * tile + b[own] % tile, minlength=tile * tile)
        at = np.flatnonzero(cells)
        rows.append(tiles[t] // across * tile + at // tile)
        columns.append(tiles[t] % across * tile + at % tile)
        counts.append(cells[at])
    sparse = ~dense[which]
    cells, n = np.unique(a[sparse].astype(np.int64) << 32 | b[sparse].astype(np.int64), return_counts=True)
    return (np.concatenate([*rows, cells >> 32]), np.concatenate([*columns, cells & 0xFFFFFFFF]), np.concatenate([*counts, n]))


def collapsed(ids: np.ndarray) -> np.ndarray:
    """The sequence with one break for every run of breaks."""
    keep = ids >= 0
    keep[1:] |= ids[:-1] >= 0
    return ids[keep]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text")
        for i in range(batch.num_rows):
            yield langs[i].as_py(), tokens(texts[i].as_py())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            del counts[b"\n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "c"])
        held.clear()

    for no, (lang, words) in enumerate(_texts(batches)):
        counts = held.get(lang)
        if counts is None:
            counts = held[lang] = Counter()
        counts.update(words)
        if no % 64 == 0 and sum(map(len, held.values())) > HELD_WORDS:
            yield from flush()
    yield from flush()


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            ids = np.concatenate(parts)
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            a, b, c = cell_counts(ids[both], ids[both + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.int64())],
                names=["lang", "a", "b", "c"])
        held.clear()

    for batch in batches:
        for lang, ids in zip(batch.column("lang"), batch.column("ids")):
            part = np.frombuffer(ids.as_py(), np.int32)
            held.setdefault(lang.as_py(), []).extend((part, np.array([BREAK], np.int32)))
            size += len(part)
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def frequency_ranks(counted: DataFrame, key: list[str]) -> DataFrame:
    """`counted` (lang, *key, f) with `id`: the place in its language by falling f,
    then in a fixed order. Offsets come from the number of keys per frequency and
    salt; the windows over keys hold one such cell each."""
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
    cells = salted.groupBy("lang", "f", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("lang").orderBy(F.desc("f"), "_salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("lang", "f", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("lang", "f", "_salt").orderBy(*key)) - 1
    return salted.withColumn("_place", place).join(cells, ["lang", "f", "_salt"]).select(
        "lang", (F.col("_before") + F.col("_place")).cast("int").alias("id"), *key, "f")


def _head(ranked: DataFrame, bound: int) -> tuple[int, bool]:
    """The id below which entries go to the workers, and whether others are left."""
    sizes = ranked.groupBy("lang").agg((F.max("id") + 1).alias("n")).agg(F.count("*").alias("langs"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if (sizes.n or 0) <= bound:
        return sizes.most or 0, False
    return bound // sizes.langs, True


def _rows(blocks: Iterator[tuple[str, np.ndarray, np.ndarray, list]], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Encoded blocks as batches (lang, ids, pos, key)."""
    for lang, ids, pos, keys in blocks:
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()),
             pa.array([pos], pa.list_(pa.int32())), pa.array([keys], pa.list_(key))], names=["lang", "ids", "pos", "key"])


class _Ids(dict):
    """word -> id; others are `missing`."""

    def __init__(self, known, missing: int):
        super().__init__(known)
        self.missing = missing

    def __missing__(self, word: bytes) -> int:
        return self.missing


def _settled(rows: DataFrame, tail: DataFrame | None, name: str) -> DataFrame:
    """Encoded rows (lang, ids, pos, key) with the open positions filled from
    `tail` (lang, key, id) by a join; without a tail there are none."""
    if tail is None:
        return staged(rows.select("lang", "ids"), name)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), name)
    asked = rows.select("row", "lang", F.explode(F.arrays_zip("pos", "key")).alias("p")).select(
        "row", "lang", F.col("p.pos").alias("pos"), F.col("p.key").alias("key"))
    fills = asked.join(tail, ["lang", "key"]).groupBy("row").agg(F.collect_list(F.struct("pos", "id")).alias("fills"))

    def patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ids, fills in zip(batch.column("lang"), batch.column("ids"), batch.column("fills")):
                ids = np.frombuffer(ids.as_py(), np.int32).copy()
                if fills.is_valid and len(fills):
                    found = fills.values
                    ids[found.field("pos").to_numpy()] = found.field("id").to_numpy()
                ids = collapsed(np.where(ids == OPEN, np.int32(BREAK), ids))
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()], pa.string()), pa.array([ids.tobytes()], pa.binary())], names=["lang", "ids"])

    return staged(rows.join(fills, "row", "left").select("lang", "ids", "fills").mapInArrow(patch, ENCODED), name)


def encode_words(texts: DataFrame, ranked: DataFrame, bound: int = HEAD) -> DataFrame:
    """Sequences of word ids (lang, ids) of all texts; rare words are breaks."""
    until, more = _head(ranked, bound)
    known: dict[str, dict[bytes, int]] = {}
    for r in ranked.where(F.col("id") < until).select("lang", "word", "id").toLocalIterator():
        known.setdefault(r.lang, {b"\n": BREAK})[r.word.encode("utf-8", "surrogatepass")] = r.id
    sent = texts.sparkSession.sparkContext.broadcast(known)
    missing = OPEN if more else BREAK

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, list]]:
        heads = {lang: _Ids(words, missing) for lang, words in sent.value.items()}
        held: dict[str, list[bytes]] = {}

        def block(lang: str, words: list[bytes]):
            ids = np.fromiter(map(heads.get(lang, _Ids({b"\n": BREAK}, missing)).__getitem__, words), np.int32, len(words))
            if not more:
                return lang, collapsed(ids), [], []
            pos = np.flatnonzero(ids == OPEN)
            return lang, ids, pos, [words[i].decode("utf-8", "surrogatepass") for i in pos]

        for lang, words in _texts(batches):
            mine = held.setdefault(lang, [])
            mine += words
            mine.append(b"\n")
            if len(mine) >= BLOCK:
                yield block(lang, held.pop(lang))
        for lang in list(held):
            yield block(lang, held.pop(lang))

    rows = texts.mapInArrow(lambda batches: _rows(blocks(batches), pa.string()), ENCODED + ", pos array<int>, key array<string>")
    tail = ranked.where(F.col("id") >= until).select("lang", F.col("word").alias("key"), "id") if more else None
    return _settled(rows, tail, "word-ids")


def encode_pairs(encoded: DataFrame, ranked: DataFrame, bound: int = HEAD) -> DataFrame:
    """Sequences of ids of the pairs in `ranked` (lang, a, b, id): one per place
    where such a pair starts, breaks between the others."""
    until, more = _head(ranked, bound)
    pair = F.shiftleft(F.col("a").cast("bigint"), 32).bitwiseOR(F.col("b").cast("bigint"))
    head = ranked.where(F.col("id") < until).select("lang", pair.alias("key"), "id").toPandas()
    known = {}
    for lang, part in head.groupby("lang"):
        order = part.key.to_numpy(np.int64).argsort()
        known[lang] = part.key.to_numpy(np.int64)[order], part.id.to_numpy(np.int32)[order]
    sent = encoded.sparkSession.sparkContext.broadcast(known)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, list]]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            for lang, ids in zip(batch.column("lang"), batch.column("ids")):
                lang, ids = lang.as_py(), np.frombuffer(ids.as_py(), np.int32)
                whole = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                wanted = ids[whole].astype(np.int64) << 32 | ids[whole + 1].astype(np.int64)
                keys, names = sent.value.get(lang, none)
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
                out = np.full(max(0, len(ids) - 1), BREAK, np.int32)
                out[whole[hit]] = names[at[hit]]
                if not more:
                    yield lang, collapsed(out), [], []
                else:
                    pos = whole[~hit]
                    out[pos] = OPEN
                    yield lang, out, pos, wanted[~hit]

    rows = encoded.mapInArrow(lambda batches: _rows(blocks(batches), pa.int64()), ENCODED + ", pos array<int>, key array<bigint>")
    tail = ranked.where(F.col("id") >= until).select("lang", pair.alias("key"), "id") if more else None
    return _settled(rows, tail, "pair-ids")


def _described(ranked: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases (lang, id, a, b, f) with their words and the counts of their first
    and last 1, 2, ... words, from the phrases that are one word shorter."""
    x = shorter.select("lang", F.col("id").alias("a"), "pre", F.col("phrase").alias("begin"))
    y = shorter.select("lang", F.col("id").alias("b"), "suf", "last")
    return ranked.join(x, ["lang", "a"]).join(y, ["lang", "b"]).select(
        "lang", "id", "a", "b", "f", F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"),
        F.concat("begin", F.lit(" "), "last").alias("phrase"), "last")


def phrase_levels(docs: DataFrame, text: str, lang: str, least: int, longest: int, head: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and the frequent phrases of 1 to `longest`
    words."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole_text(text).alias("text"))
    counted = staged(texts.mapInArrow(_count_words, "lang string, word string, c bigint").groupBy("lang", "word").agg(
        F.sum("c").alias("f")), "word-counts")
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = staged(frequency_ranks(counted.where(F.col("f") >= least), ["word"]), "word-ranks")
    one = F.array("f")
    levels = [words.select("lang", "id", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), "f", one.alias("pre"),
                           one.alias("suf"), F.col("word").alias("phrase"), F.col("word").alias("last"))]
    encoded = encode_words(texts, words, head)
    for size in range(2, longest + 1):
        cells = encoded.mapInArrow(_count_cells, "lang string, a int, b int, c bigint")
        frequent = cells.groupBy("lang", "a", "b").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        ranked = staged(frequency_ranks(staged(frequent, "frequent-pairs"), ["a", "b"]), "pair-ranks")
        levels.append(staged(_described(ranked, levels[-1]), "phrases"))
        if size < longest:
            encoded = encode_pairs(encoded, ranked, head)
    return total, levels


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 head: int = HEAD) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that no longer one of
    the same count contains."""
    total, levels = phrase_levels(docs, text, lang, least, longest, head)
    kept = []
    for level, longer in zip(levels[1:], [*levels[2:], None]):
        if longer is not None:
            # A phrase two words longer of the same count holds one that is one word longer.
            inside = longer.select("lang", F.explode(F.array("a", "b")).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("g"))
            level = level.join(inside, ["lang", "id"], "left").where(F.coalesce("g", F.lit(0)) < F.col("f"))
        kept.append(level.select("lang", "phrase", "f", "pre", "suf"))
    rows = kept[0]
    for part in kept[1:]:
        rows = rows.union(part)

    def score(k):
        left, right = F.get("pre", k - 1), F.get("suf", F.size("pre") - k - 1)
        wide = [c.cast("decimal(19,0)") for c in (F.col("f"), F.col("n"), left, right)]
        exact = F.call_function("div", wide[0] * wide[1] * F.lit(1000).cast("decimal(4,0)"), wide[2] * wide[3])
        return F.struct(exact.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("pre") - 1), score))
    return rows.join(total, "lang").withColumn("best", best).select(
        "lang", "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").cast("bigint").alias("score"))


def best_of_each(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language with their rank: first of parts
    of it, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(4 * SALTS)))
    parts = parts.withColumn("_no", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_no") <= top)
    place = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    return parts.drop("_part", "_no").withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)


def phrase_report(docs: DataFrame, **options) -> DataFrame:
    return best_of_each(collocations(docs, **options)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
