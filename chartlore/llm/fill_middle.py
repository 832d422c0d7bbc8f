"""Fill-in-middle transformation with cuts found on a wavelet matrix.

The bytes of a slice of texts are put into classes (continuation byte, line end,
blank, first byte of a word, any other first byte of a character) and held as a
wavelet matrix: one row of bits per bit of the class, each with running counts.
A rank query counts one class before a position; ranks of the classes that open
a unit add up to the number of units, and bisection on that number finds the
byte where the unit after a cut starts. Units are characters or words; the ranks
of the character classes turn any such place into code points.

Where a text is cut follows from a digest of its key alone, so a rerun or a lost
executor changes nothing: h1 to h4 are the first four 8-digit groups of the
hexadecimal SHA-256 of "1:" and the key. Prefix ends after the smaller of
h1 % (n + 1) and h2 % (n + 1) units, middle after the larger. Texts that are
empty or hold a mark, and `PLAIN_SHARE` of the rest, stay plain; `SPM_SHARE` of
the others put the suffix first.

A null text counts as empty, a null key as an empty one. Repeated rows are cut
alike. Rows are independent and nothing is shuffled; a text of any length takes
about two bytes of the matrix per byte.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package, whole_text

# Fixed values of the output's form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE, SPM_SHARE = 10, 20

SLICE_BYTES = 1 << 20
CONTINUATION, LINE, BLANK, WORD, OTHER = range(5)
UNITS = {"chars": (LINE, BLANK, WORD, OTHER), "words": (WORD,)}
CUTS = "n bigint, prefix_units bigint, middle_units bigint, prefix_chars bigint, middle_chars bigint"

_KIND = np.full(256, OTHER, np.uint8)
_KIND[0x80:0xC0] = CONTINUATION
_KIND[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
_KIND[0x0A] = LINE


def byte_classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that lie end to end and begin at `starts`."""
    kind = _KIND[raw]
    opens = np.ones(len(raw), bool)
    opens[1:] = (kind[:-1] == BLANK) | (kind[:-1] == LINE)
    opens[starts[starts < len(raw)]] = True
    return np.where(opens & (kind == OTHER), np.uint8(WORD), kind)


class WaveletMatrix:
    """Rank over a sequence of classes, by one row of bits per bit of a class."""

    def __init__(self, codes: np.ndarray, bits: int = 3):
        self.size, self.bits = len(codes), bits
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in reversed(range(bits)):
            bit = (codes >> level) & 1
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            packed[:(self.size + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.rows.append((words, before, self.size - int(bit.sum())))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` elements are `code`."""
        low, high = np.zeros_like(at), at
        for level, (words, before, zeros) in zip(reversed(range(self.bits)), self.rows):
            ones = [before[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
                    for i in (low, high)]
            low, high = (zeros + ones[0], zeros + ones[1]) if code >> level & 1 else (low - ones[0], high - ones[1])
        return high - low

    def count(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(code, at) for code in codes)

    def reach(self, codes: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of element number `wanted` (from 0) of the classes, by
        bisection on ranks between `low` and `high`; `high` where it lies beyond."""
        while (low < high).any():
            middle = (low + high) >> 1
            beyond = (self.count(codes, np.minimum(middle + 1, self.size)) > wanted) | (low >= high)
            low, high = np.where(beyond, low, middle + 1), np.where(beyond, np.minimum(middle, high), high)
        return low


def cuts(texts: list[bytes], first: np.ndarray, second: np.ndarray, unit: str = "chars") -> pd.DataFrame:
    """Per text the number of units, and how many units and code points lie before
    the first cut and between the two."""
    codes, every = UNITS[unit], UNITS["chars"]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    matrix = WaveletMatrix(byte_classes(np.frombuffer(b"".join(texts), np.uint8), starts))
    base = matrix.count(codes, starts)
    n = matrix.count(codes, ends) - base
    a, b = first % (n + 1), second % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)
    chars = matrix.count(every, starts)

    def code_points(units: np.ndarray) -> np.ndarray:
        at = np.where(units == 0, starts, matrix.reach(codes, base + units, starts, ends))
        return matrix.count(every, at) - chars

    low, high = code_points(a), code_points(b)
    return pd.DataFrame({"n": n, "prefix_units": a, "middle_units": b - a, "prefix_chars": low, "middle_chars": high - low})


def _slices(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """(start, texts as bytes) of runs of rows of about SLICE_BYTES."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def cut_points(text: Column, first: Column, second: Column, unit: str = "chars") -> Column:
    """A struct of CUTS."""

    @F.pandas_udf(CUTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, h1, h2 in batches:
            h1, h2 = h1.to_numpy(np.int64), h2.to_numpy(np.int64)
            for at, part in _slices(texts):
                yield cuts(part, h1[at:at + len(part)], h2[at:at + len(part)], unit)

    return run(text, first, second)


def key_numbers(key: Column) -> list[Column]:
    """h1 to h4 of a key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "chars", out: str = "fim") -> DataFrame:
    """`docs` with a struct `out` of n (units), form (plain, psm or spm), the
    units and code points of prefix and middle (null if plain), and output.
    `out` must be a new name; all other columns stay."""
    ship_package(docs.sparkSession)
    whole = whole_text(text)
    h1, h2, h3, h4 = key_numbers(F.col(key))
    plain = (whole == "") | (h3 % 100 >= 100 - PLAIN_SHARE)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(whole, F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < SPM_SHARE, "spm").otherwise("psm")
    rows = docs.select(F.struct("*").alias("_row"), whole.alias("_text"), form.alias("_form"), cut_points(whole, h1, h2, unit).alias("_cut"))
    a, b = F.col("_cut.prefix_chars"), F.col("_cut.middle_chars")
    prefix, middle, suffix = (F.substring("_text", start.cast("int"), size.cast("int")) for start, size in (
        (F.lit(1), a), (a + 1, b), (a + b + 1, F.greatest(F.length("_text"), F.lit(1)))))
    output = F.when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(
        F.col("_form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("_text"))
    cut = [F.when(F.col("_form") != "plain", F.col(f"_cut.{c}")).alias(c)
           for c in ("prefix_units", "middle_units", "prefix_chars", "middle_chars")]
    return rows.select("_row.*", F.struct(F.col("_cut.n").alias("n"), F.col("_form").alias("form"), *cut, output.alias("output")).alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of either form was made from."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(4), F.length(output))
        one = F.substring_index(body, first, 1)
        rest = F.substring(body, F.length(one) + 4, F.length(output))
        two = F.substring_index(rest, second, 1)
        return one, two, F.substring(rest, F.length(two) + 4, F.length(output))

    prefix, suffix, middle = parts(SUFFIX, MIDDLE)
    late, early, between = parts(PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, between, late)).otherwise(output)


def middle_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: units, form, sizes, and digests of the output and of the text
    restored from it."""
    done = fill_in_middle(docs.select(key, "text"), key, out="_fim")
    output, form = F.col("_fim.output"), F.col("_fim.form")
    return done.select(key, "_fim.n", "_fim.form", "_fim.prefix_chars", "_fim.middle_chars", F.sha2(output, 256).alias("output_sha256"),
                       F.sha2(restored(output, form), 256).alias("restored_sha256"))
