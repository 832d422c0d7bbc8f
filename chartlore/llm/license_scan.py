"""License scan: exact phrases, and short notices found with errors.

A text becomes its words, A-Z in lower case, with one blank between them. The
phrases of `PHRASES` are found where their words stand side by side. A notice of
n characters may differ from a passage by k = max(1, floor(RATE * n)) edits: cut
into k + 1 pieces, one at least must stand unchanged, so one pass of an automaton
over the text finds every place worth a look. There the regex library matches the
whole notice with at most k errors and gives span and edits. A notice that is
told from its likes by one word (`mit`, `bsd`, ...) counts only where the span
holds that word unchanged.

Labels are those of both kinds; the score is 1 with an exact phrase, else the
best share of a notice that stands unedited, else 0. Spans count code points of
the text, from the first character of the first word to the end of the last; a
span that begins or ends within a word takes in the whole word.

Null and empty texts have no words, labels or spans. Repeated rows get equal
answers. Rows are independent and nothing is shuffled; the notices are a short
parameter. A very long text costs time in proportion to its length: places of a
notice that lie closer than its errors are looked at once.
"""
from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import ship_package
from chartlore.llm.edit_leaks import pieces

# The exact phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Public short notices as (label, word that must stand unchanged, notice).
NOTICES = (
    ("agpl", "affero", "gnu affero general public license"),
    ("apache", "apache", "licensed under the apache license version 2 0"),
    ("apache", "apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("artistic", "artistic", "licensed under the artistic license 2 0"),
    ("boost", "boost", "distributed under the boost software license version 1 0"),
    ("bsd", "bsd", "released under the bsd license"),
    ("bsd", "", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("cc", "cc", "licensed under cc by nc 4 0"),
    ("cc", "cc", "licensed under cc by sa 4 0"),
    ("cc", "commons", "licensed under a creative commons attribution"),
    ("cc", "commons", "to the extent possible under law the author has dedicated all copyright to the public domain creative commons zero"),
    ("epl", "eclipse", "made available under the terms of the eclipse public license"),
    ("gpl", "gnu", "licensed under the gnu general public license version 3"),
    ("gpl", "", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser", "gnu lesser general public license"),
    ("mit", "mit", "released under the mit license"),
    ("mit", "", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "mozilla", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "", "this is free and unencumbered software released into the public domain"),
    ("zlib", "", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
)
RATE = 0.07
SLICE = 256
SPANS = "array<struct<label:string,edits:int,first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"
FOUND = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices {SPANS}"

_NOT_WORD = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_WORDS = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the text as it is, A-Z too


def words_of(text: str | None) -> list[bytes]:
    """The words in order. Only A-Z are folded; a blank stands for the rest of ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split(b" ")


def error_budget(size: int, rate: float = RATE) -> int:
    return max(1, math.floor(rate * size))


class NoticeFinder:
    """Finds notices, each given as (label, key word, text)."""

    def __init__(self, notices: Sequence[tuple[str, str, str]], rate: float = RATE):
        self.notices = [(label, f" {key} " if key else "", text) for label, key, text in notices if text]
        self.errors = [error_budget(len(text), rate) for _, _, text in self.notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(text, special_only=True)}){{e<={k}}}")
                         for (_, _, text), k in zip(self.notices, self.errors)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for no, (_, _, text) in enumerate(self.notices):
            for offset, piece in pieces(text, self.errors[no]):
                seeds.setdefault(piece, []).append((no, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, places)
        if seeds:
            self.automaton.make_automaton()

    def find(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(notice, edits, start, end) of every passage that is a notice within its
        errors; passages of one notice do not overlap."""
        starts: dict[int, set[int]] = {}
        if self.notices:
            for end, places in self.automaton.iter(plain):
                for no, offset in places:
                    starts.setdefault(no, set()).add(end + 1 - offset)
        found = []
        for no, at in sorted(starts.items()):
            _, key, text = self.notices[no]
            k, done = self.errors[no], 0
            for low, high in _runs(sorted(at), k):
                # The best match lies where seeds agree; a passage is taken once.
                match = self.patterns[no].search(plain, max(done, low - k), high + len(text) + k)
                if match and key in f" {plain[match.start():match.end()]} ":
                    found.append((no, sum(match.fuzzy_counts), match.start(), match.end()))
                    done = match.end()
        return found


def _runs(at: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """Ascending starts in runs that span at most `gap`."""
    low = high = at[0]
    for start in at[1:]:
        if start - low > gap:
            yield low, high
            low = start
        high = start
    yield low, high


@functools.lru_cache(maxsize=4)
def _finder(notices: tuple[tuple[str, str, str], ...], rate: float) -> NoticeFinder:
    return NoticeFinder(notices, rate)


def scan(text: str | None, finder: NoticeFinder, phrases: Sequence[tuple[str, str]] = PHRASES) -> tuple:
    """The values named in FOUND."""
    words = [w for w in words_of(text) if w]
    plain = b" ".join(words).decode("utf-8", "surrogatepass")
    blanks = None  # places of the blanks, for the number of a word

    def number(place: int) -> int:
        nonlocal blanks
        if blanks is None:
            blanks = [m.start() for m in re.finditer(" ", plain)]
        return bisect.bisect_left(blanks, place)

    framed, places, base = f" {plain} ", [], set()
    for phrase, label in phrases:
        wanted, at = f" {phrase} ", framed.find(f" {phrase} ")
        while at >= 0:
            places.append(number(at))
            base.add(label)
            at = framed.find(wanted, at + 1)
    score, labels, spans = float(bool(places)), set(base), []
    hits = finder.find(plain)
    if hits:
        bounds = [m.span() for m in _WORD.finditer(text)]
        for no, edits, start, end in hits:
            label, _, notice = finder.notices[no]
            first, last = number(start + (plain[start] == " ")), number(end - 1 - (plain[end - 1] == " "))
            spans.append({"label": label, "edits": edits, "first_word": first, "last_word": last,
                          "start": bounds[first][0], "end": bounds[last][1]})
            labels.add(label)
            score = max(score, 1 - edits / len(notice))
    spans.sort(key=lambda s: (s["start"], s["end"], s["label"]))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            score, spans)


def found_licenses(text: Column, notices: Sequence[tuple[str, str, str]] = NOTICES, rate: float = RATE) -> Column:
    """A struct of FOUND."""
    notices = tuple(map(tuple, notices))

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = _finder(notices, rate)
        for texts in batches:
            for at in range(0, len(texts), SLICE):
                rows = [scan(t, finder) for t in texts.iloc[at:at + SLICE]]
                n_words, n_base, first, last, base, labels, score, spans = zip(*rows)
                yield pd.DataFrame({
                    "n_words": n_words, "n_base": n_base, "first_word": pd.array(first, "Int64"), "last_word": pd.array(last, "Int64"),
                    "base_labels": base, "labels": labels, "score": score, "notices": pd.Series(spans, dtype=object)})

    return run(text)


def with_licenses(docs: DataFrame, text: str = "text", out: str = "licenses", notices: Sequence[tuple[str, str, str]] = NOTICES,
                  rate: float = RATE) -> DataFrame:
    """`docs` with a struct `out` of FOUND; `out` must be a new name."""
    ship_package(docs.sparkSession)
    return docs.withColumn(out, found_licenses(F.col(text), notices, rate))


def license_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: counts, labels, score, and the notices found with their spans."""
    done = with_licenses(docs.select(key, "text"), out="_found")
    return done.select(key, "_found.*")
