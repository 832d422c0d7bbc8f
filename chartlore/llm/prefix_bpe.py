"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one last token t such that the
encoding of the prefix is the encoding of what precedes t, followed by t. An
automaton with suffix links over the vocabulary lists the tokens that end at
each position; a candidate t is right if the last token of the shorter prefix
and t stay two tokens when they stand side by side. Those last tokens are the
back-pointers that give the ids, in time linear in the word's length.

The model file (tokenizers JSON: NFC, white space, lower case, byte-level BPE
with word ends) is read once by the driver and broadcast; its size is checked.
Each worker keeps two bounded tables of encoded pieces, cleared when full.

Letters and digits are those of the installed regex module's Unicode tables.

Null and empty texts have no tokens and decode to the empty string. Rows are
independent; no shuffle runs.
"""
from __future__ import annotations

import functools
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package

MAX_MODEL_BYTES = 64 << 20
CACHED_PIECES = 60_000
CACHED_PAIRS = 200_000
SLICE = 256
_END = 0x400  # added to a symbol that ends a word
_NEVER = 1 << 60
# White space as Unicode lists it; Python's own split also takes the four below.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself
    where it is a visible Latin-1 character, else the next code from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PrefixBpe:
    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("not a lower-casing byte-level BPE model with word ends")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge_rank[left, right] = rank
            self.parts[whole], self.rank[whole] = (left, right), rank
        self.automaton = ahocorasick.Automaton()
        sound = set(self.vocab.values()) - set(self.special.values()) - set(self.parts)
        for whole, (left, right) in self.parts.items():  # in the order of the merges
            if left in sound and right in sound and self._apart(left, right, self.rank[whole]):
                sound.add(whole)
        for text, token in self.vocab.items():
            if token in sound:
                word = self._symbols_of(text)
                self.automaton.add_word(word, (token, len(word)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _symbols_of(self, token: str) -> str:
        """A token's bytes as characters, the last one marked if it ends a word."""
        ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
        codes = [self.byte_of[c] for c in (token[:-len(self.suffix)] if ends else token)]
        codes[-1] += _END * ends
        return "".join(map(chr, codes))

    def _edge(self, token: int, side: int, until: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while `token` is built, each with
        the rank of the merge that takes it in."""
        edge = [(token, until)]
        while token in self.parts:
            until, token = self.rank[token], self.parts[token][side]
            edge.append((token, until))
        return edge

    def _apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge joins a's right edge to b's left edge before each is
        whole. Of equal merges the left one comes first."""
        rank = self.merge_rank
        right = self._edge(b, 0, until)
        for x, x_until in self._edge(a, 1, until):
            for y, y_until in right:
                m = rank.get((x, y))
                if m is not None and m < x_until and m <= y_until:
                    return False if (x, y) != (a, b) or until == _NEVER else True
        return True

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self._apart(a, b)
        return found

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        symbols = word.encode().decode("latin-1")
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END)
        last, sizes, pairs = [0] * (len(symbols) + 1), [0] * (len(symbols) + 1), self.pairs
        for end, (token, size) in self.automaton.iter(symbols):
            end += 1
            if sizes[end]:
                continue  # the last token of a prefix is unique
            if start := end - size:
                if not sizes[start]:
                    continue
                apart = pairs.get(last[start] << 32 | token)
                if not (self.compatible(last[start], token) if apart is None else apart):
                    continue
            last[end], sizes[end] = token, size
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= sizes[at]
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def _chunk(self, chunk: str) -> bytes:
        found = self.piece.findall(chunk)
        if found == [chunk]:
            return self.pieces.get(chunk) or self.encode_word(chunk)
        out = []
        for piece in found:
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.encode_word(piece)
                if len(piece) <= 64:
                    if len(self.pieces) >= CACHED_PIECES:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. No pre-token spans white space,
        so each run of other characters stands alone."""
        if not text.isascii():
            # Lower-casing goes letter by letter: no rule for a final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunks = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        known, out = self.chunks, []
        for chunk in chunks:
            ids = known.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if len(chunk) <= 64:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not any(mark in text for mark in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part)
                        for part in self.marks.split(text))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, as the model names no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _model(spec: str) -> PrefixBpe:
    return PrefixBpe(spec)


def read_model(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        spec = file.read(MAX_MODEL_BYTES + 1)
    if len(spec) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is larger than {MAX_MODEL_BYTES} bytes")
    return spec


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids",
                      decoded: str = "decoded") -> DataFrame:
    """`docs` with the packed ids (4 bytes each, little-endian) and the text
    decoded from them. Both names must be new; the other columns stay."""
    ship_package(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_model(path))

    @F.pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(spec.value)
        for texts in batches:
            for at in range(0, len(texts), SLICE):  # ids and texts of few rows at a time
                packed = [model.encode(t) for t in texts.iloc[at:at + SLICE]]
                yield pd.DataFrame({"ids": pd.Series(packed, dtype=object),
                                    "decoded": pd.Series([model.decode(p) for p in packed], dtype=object)})

    out = docs.select(F.struct("*").alias("_row"), run(F.col(text)).alias("_bpe"))
    return out.select("_row.*", F.col("_bpe.ids").alias(ids), F.col("_bpe.decoded").alias(decoded))


def token_counts(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("bigint")


def bpe_report(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Per row: token count and digests of the ids and of the decoded text."""
    out = encode_and_decode(docs.select(key, "text"), path, ids="_ids", decoded="_decoded")
    return out.select(key, token_counts(F.col("_ids")).alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"),
                      F.sha2("_decoded", 256).alias("decoded_sha256"))
