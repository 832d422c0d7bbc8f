"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage of a document by up to
k = max(1, floor(rate * n)) edits. Cut into k + 1 pieces, at least one piece must
occur unchanged, so one pass of a pattern automaton over a document finds every
place worth a look. There Myers' bit-parallel search gives the least edit
distance of the whole item to any passage; items within their budget are leaks.

Texts and items are compared in lower case with runs of white space as one
blank. An item without characters matches nothing. Null and empty documents have
no leaks; repeated documents each get their own answer. An item is an id, null
included, with a text: texts that share an id are searched one by one, and rows
that repeat id and text count once, however the items are cut into blocks.

The items travel to the workers in blocks of bounded size, each built into an
automaton once per worker; documents are read once and never shuffled.
"""
from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package

RATE = 0.08
BLOCK_CHARS = 1 << 20
MAX_ITEM_CHARS = 64 << 20
LEAKS = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def error_budget(size: int, rate: float = RATE) -> int:
    return max(1, math.floor(rate * size))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length; an item with
    fewer characters than pieces has empty ones, which are left out."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def best_end(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of `item` to any substring of `text`, with the first
    end (exclusive) where it occurs: one bit per character of the item."""
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    rows: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(item):
        rows[ch] |= 1 << i
    up, down, score = full, 0, size
    best, at = size, 0
    get = rows.get
    for j, ch in enumerate(text, 1):
        same = get(ch, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, at = score, j
    return best, at


class ItemMatcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        """Items with a null id come first, then by id and text."""
        distinct = {(i, t) for i, t in ((i, normal(t)) for i, t in items) if t}
        self.items = sorted(distinct, key=lambda item: (item[0] is not None, item[0] or 0, item[1]))
        self.errors = [error_budget(len(t), rate) for _, t in self.items]
        wanted = defaultdict(list)
        for at, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.errors[at]):
                wanted[piece].append((at, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in wanted.items():
            self.automaton.add_word(piece, places)
        if wanted:
            self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item, distance, start, end) of the best passage per leaked item;
        positions refer to the normalised text."""
        text = normal(text)
        if not text or not self.items:
            return []
        starts = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for item, offset in places:
                starts[item].add(end + 1 - offset)
        found = []
        for no, at in sorted(starts.items()):
            item, wanted = self.items[no]
            best = self._best(wanted, self.errors[no], text, sorted(at))
            if best:
                found.append((item, *best))
        return found

    @staticmethod
    def _best(item: str, errors: int, text: str, at: list[int]) -> tuple[int, int, int] | None:
        exact = text.find(item)
        if exact >= 0:
            return 0, exact, exact + len(item)
        best = None
        low = high = None
        windows = []
        for start in at:  # overlapping windows are searched once
            a, b = max(0, start - errors), min(len(text), start + len(item) + errors)
            if high is not None and a <= high:
                high = max(high, b)
                windows[-1] = (low, high)
            else:
                low, high = a, b
                windows.append((low, high))
        for low, high in windows:
            distance, end = best_end(item, text[low:high])
            if distance <= errors and (best is None or distance < best[0]):
                back, size = best_end(item[::-1], text[low:low + end][::-1])
                best = (distance, low + end - size, low + end)
        return best


_MATCHERS: dict[tuple, ItemMatcher] = {}


def _matcher(token: int, items: list[tuple[int | None, str]], rate: float) -> ItemMatcher:
    """One automaton per block and worker process."""
    key = (token, rate, len(items), hash(tuple(items)))
    if key not in _MATCHERS:
        if len(_MATCHERS) >= 8:
            _MATCHERS.clear()
        _MATCHERS[key] = ItemMatcher(items, rate)
    return _MATCHERS[key]


def _plain(text: Column) -> Column:
    """`normal` as a column, by the same function."""
    return F.udf(normal, "string")(text)


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about `block_chars` characters; those that are equal
    once normalised share a block."""
    rows = items.select(F.col(key).cast("bigint").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if chars > MAX_ITEM_CHARS:
        raise ValueError(f"the items hold {chars} characters; more than {MAX_ITEM_CHARS} need several calls")
    n = max(1, math.ceil(chars / block_chars))
    for block in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", _plain(F.col("t"))), F.lit(n)) == block) if n > 1 else rows
        yield sorted({(r.i, r.t) for r in part.collect()}, key=lambda item: (item[0] is not None, item[0] or 0, item[1]))


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
               item_text: str = "text", rate: float = RATE, out: str = "leaks", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` with an array of (item_id, distance, start, end), one element per
    leaked item. `out` must be a new name; all other columns stay."""
    ship_package(docs.sparkSession)
    context = docs.sparkSession.sparkContext

    def matching(token: int, block: list[tuple[int | None, str]]):
        sent = context.broadcast(block)

        @F.pandas_udf(LEAKS)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = _matcher(token, sent.value, rate)
            for texts in batches:
                yield pd.Series([[dict(zip(("item_id", "distance", "start", "end"), leak)) for leak in matcher.leaks(t)]
                                 for t in texts], dtype=object)

        return run(F.col(text))

    found = [matching(n, block) for n, block in enumerate(item_blocks(items, item_key, item_text, block_chars))]
    return docs.withColumn(out, F.concat(*found) if len(found) > 1 else found[0])


def leak_report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per pair of a document and an item it leaks."""
    hit = with_leaks(docs.select(key, "text"), items, out="_leaks", **options)
    return hit.select(key, F.explode("_leaks").alias("_leak")).select(
        key, "_leak.item_id", "_leak.distance", F.col("_leak.start").alias("leak_start"), F.col("_leak.end").alias("leak_end"))


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` without the rows that leak an item, columns as they are."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return with_leaks(rows, items, **options).where(F.size("leaks") == 0).select("row.*")
