"""Rule statistics of whole texts, counted in Arrow batches on the workers."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but these; bytes.split() has the same rule.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
_NOT_DIGIT = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)
_NOT_ALPHA = bytes(b for b in range(128) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
FIELDS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper",
          "n_digits", "n_bytes", "n_letters", "n_marks", "n_bars"]
SCHEMA = ", ".join(f"{f} bigint" for f in FIELDS)


def repeated_words(words: list, window: int = 3) -> int:
    """Words inside `window`-word runs that occur twice or more in the text."""
    runs = list(zip(*(words[i:] for i in range(window))))
    if len(set(runs)) == len(runs):
        return 0
    times = Counter(runs)
    covered, until = 0, 0
    for at, run in enumerate(runs):
        if times[run] > 1:
            covered += at + window - max(at, until)
            until = at + window
    return covered


def text_rules(text: str | None) -> tuple[int, ...]:
    """The counts named in FIELDS; all zero but for one line if the text is null
    or empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, lines, repeated = set(), 0, 0
    for line in raw.split(b"\n"):
        lines += 1
        if line in seen:
            repeated += 1
        elif line and not line.isspace():
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), lines, repeated,
            repeated_words(words), len(set(words)), len(raw.translate(None, _NOT_UPPER)),
            len(raw.translate(None, _NOT_DIGIT)), len(raw), len(raw.translate(None, _NOT_ALPHA)),
            text.count("!") + text.count("?"), text.count("|"))


def with_rules(text: Column) -> Column:
    """A struct of all FIELDS."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_rules(t) for t in texts], columns=FIELDS, dtype="int64")

    return run(text)


#: Ratios that tell junk from prose; all finite, zero for an empty text.
RATIOS = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "letters",
          "marks", "bars", "line_length"]


def ratios(rules: pd.DataFrame) -> np.ndarray:
    """One row of RATIOS per row of counts, log-scaled where they have no bound."""
    r = rules.astype(float)
    words, size = np.maximum(1, r.n_words), np.maximum(1, r.n_bytes)
    return np.column_stack([
        np.log1p(r.n_words), np.log1p(r.word_chars / words), np.log1p(r.n_symbols / words * 10), r.n_dup_lines / np.maximum(1, r.n_lines),
        r.n_repeat_words / words, r.n_distinct / words, r.n_upper / size, r.n_digits / size, r.n_letters / size,
        np.log1p(r.n_marks / words * 10), np.log1p(r.n_bars / words * 10), np.log1p(r.n_words / np.maximum(1, r.n_lines))])
