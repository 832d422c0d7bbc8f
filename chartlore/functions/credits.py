"""Artist credits as Column functions.

A credit is what a list prints ("A Featuring B, C & D"). Two things are read
off it: the grouping key (`primary_artist`) and whether it names an artist
(`names_artist`). Both are needed everywhere, so each has one definition here.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Words that separate the leading act from collaborators.
MARKER_WORDS = ("featuring", r"feat\.?", "with", "x", "&", r"\+", "duet")
# A comma that belongs to a name: digit groups and generational suffixes.
NAME_COMMA_PATTERN = r"\d,\d|,\s*(?:jr|sr|ii|iii|iv)\b"
# What every credit holds that has such a comma, wherever its pieces are cut.
NAME_COMMA_HINT = r"\d,\d|,\s*(?:jr|sr|ii|iv)"
BAND_PATTERN = r"^the\s+(.+?)\s+band$"
UNITS_SPLIT_PATTERN = r"\s+(?:&|feat\.?|featuring|with|x|and)\s+|,\s*"
# Substrings that mark a combined credit, left out of name pools.
POOL_MARKERS = (" featuring ", " feat. ", " feat ", " with ", " x ", " & ", " + ",
                " duet ", " / ")
# ----------------------------------------------------------------------------

MARKER_PATTERN = r"\s+(?:" + "|".join(MARKER_WORDS) + r")\s+.*$"
DELIM_PATTERN = (r"(?:\s+(?:" + "|".join((*MARKER_WORDS, "and")) + r")\s+"
                 r"|\s*[/(),]\s*)")


def primary_credit(credit: Column) -> Column:
    """Leading act with its spelling kept; stops at marker words, not commas."""
    return F.trim(F.regexp_replace(F.trim(credit), "(?i)" + MARKER_PATTERN, ""))


def lead_of(credit: Column) -> Column:
    """The credit up to the first comma that separates two artists.

    A comma counts as part of a name when the seven characters around it show a
    digit group or a generational suffix.
    """
    def separates(credit: Column, i: Column) -> Column:
        start = F.greatest(i - 1, F.lit(1))
        around = F.substring(credit, start, i + 6 - start)
        return (F.substring(credit, i, F.lit(1)) == ",") & ~F.rlike(
            around, F.lit("(?i)" + NAME_COMMA_PATTERN))

    def cut_at(credit: Column) -> Column:
        cut = F.get(F.filter(F.sequence(F.lit(1), F.length(credit)), lambda i: separates(credit, i)), F.lit(0))
        return F.when(cut.isNotNull(), F.trim(F.substring(credit, F.lit(1), cut - 1))).otherwise(credit)

    # Most credits hold no comma, and most commas separate: a credit without
    # anything that may be a name's comma is cut at its first one, and only the
    # rest is walked by character. The credit is an expression: held in an array
    # it is worked out once, not once a character.
    def lead(credit: Column) -> Column:
        first = F.trim(F.substring_index(credit, ",", 1))
        return F.when(F.rlike(credit, F.lit("(?i)" + NAME_COMMA_HINT)), cut_at(credit)).otherwise(first)

    return F.when(F.contains(credit, F.lit(",")), F.get(F.transform(F.array(credit), lead), F.lit(0))).otherwise(credit)


def primary_artist(credit: Column) -> Column:
    """Grouping key: leading act, also cut at a separating comma, lower case."""
    return F.lower(lead_of(primary_credit(credit)))


def artist_pattern(name: str) -> str:
    """Pattern of a lower-case credit that names `name` as a whole segment."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", name.strip().lower())
    return f"(?:^|{DELIM_PATTERN}){quoted}(?:{DELIM_PATTERN}|$)"


def names_artist(credit: Column, name: str) -> Column:
    """Whether the credit names the artist, as a segment or as "The X Band"."""
    needle = name.strip().lower()
    if not needle:
        return F.lit(False)
    text = F.lower(F.trim(credit))
    pattern = F.lit(artist_pattern(name))
    # The substring test is a cheap necessary condition; the patterns only run
    # on the few credits that pass it.
    return F.coalesce(
        F.contains(text, F.lit(needle))
        & (F.rlike(text, pattern)
           | F.rlike(F.regexp_extract(text, BAND_PATTERN, 1), pattern)),
        F.lit(False))


def names_artist_col(credit: Column, name: Column) -> Column:
    """`names_artist` where the name is a column."""
    text, needle = F.lower(F.trim(credit)), F.lower(F.trim(name))
    quoted = F.regexp_replace(needle, r"(\p{Punct})", r"\\$1")
    pattern = F.concat(F.lit(f"(?:^|{DELIM_PATTERN})"), quoted, F.lit(f"(?:{DELIM_PATTERN}|$)"))
    return F.coalesce(
        (needle != "") & F.contains(text, needle)
        & (F.rlike(text, pattern)
           | F.rlike(F.regexp_extract(text, BAND_PATTERN, 1), pattern)),
        F.lit(False))


def credit_words(text: Column) -> Column:
    """Words of a credit or name, in lower case: what stands between white space
    and the marks that may separate artists. A credit names an artist only where
    the artist's words stand in it side by side."""
    return F.filter(F.split(F.lower(text), r"[\s/(),]+"), lambda w: w != "")


def word_runs(words: Column, longest: int) -> Column:
    """All runs of one to `longest` words, and the empty one."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " ")))
    return F.when(F.size(words) > 0, F.array_distinct(F.concat(F.flatten(runs), F.array(F.lit(""))))).otherwise(F.array(F.lit("")))


def is_solo_name(credit: Column) -> Column:
    """No collaboration marker in the credit: usable in a name pool."""
    text = F.lower(credit)
    found = F.lit(False)
    for marker in POOL_MARKERS:
        found = found | F.contains(text, F.lit(marker))
    return ~found
