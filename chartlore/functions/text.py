"""Scalar text functions, all JVM-side."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.functions.credits import UNITS_SPLIT_PATTERN, primary_artist

# --- fixed values -----------------------------------------------------------
FORMAT_TAG_PATTERN = r"(?i)\((?:ep|soundtrack|original[^)]*soundtrack|mixtape)\)"
VOLUME_PATTERN = r"(?i)\bvol(?:ume)?\b\.?"
PART_PATTERN = r"(?i)\b(?:pt|part)\b\.?"
LAZY_ARTWORK = "lazyload-fallback"
PLACEHOLDER_TITLES = {
    "soundtrack": "Soundtrack",
    "variousartists": "Various Artists",
    "originalbroadwaycast": "Original Broadway Cast",
    "originalcastrecording": "Original Cast",
}
QUOTES = "\"“”‘’"
# ----------------------------------------------------------------------------


def _plain_letters() -> dict[str, str]:
    """Every other character whose compatibility decomposition has ASCII letters,
    digits or an ampersand, with these in lower case."""
    found = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        parts = unicodedata.normalize("NFKD", chr(code))
        plain = "".join(c for c in parts.lower() if c.isascii() and (c.isalnum() or c == "&"))
        if plain:
            found[chr(code)] = plain
    return found


_FOLDS = _plain_letters()
# One letter for one: by `translate`. Several letters: by a map, in texts that
# still hold other letters than ASCII ones.
ACCENTED = "".join(c for c, p in _FOLDS.items() if len(p) == 1)
PLAIN = "".join(p for p in _FOLDS.values() if len(p) == 1)
LIGATURES = {c: p for c, p in _FOLDS.items() if len(p) > 1}
OTHER_PATTERN = "[^\\x00-\\x7f]"


def _folded(text: Column) -> Column:
    """Lower-case text with accents dropped and compatibility forms spelled out;
    ASCII texts, nearly all, take neither way."""
    return F.when(F.octet_length(text) > F.length(text), _unfolded(F.translate(text, ACCENTED, PLAIN))).otherwise(text)


def _unfolded(text: Column) -> Column:
    # One literal, folded into a map once: a map of so many columns is slow to build.
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{p}" for c, p in LIGATURES.items())), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(
        c > F.lit("\x7f"), F.coalesce(F.try_element_at(table, c), F.lit(""))).otherwise(c)), "")
    return F.when(F.rlike(text, F.lit(OTHER_PATTERN)), spelled).otherwise(text)


def match_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def safe_int(value: Column, default: int | None = None) -> Column:
    """Integer part of a number; blank, '-', zero and junk become the default."""
    found = F.nullif(value.cast("string").try_cast("double").try_cast("int"), F.lit(0))
    return found if default is None else F.coalesce(found, F.lit(default))


def number(text: Column) -> Column:
    """Digits with thousands separators, else null."""
    bare = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(F.rlike(bare, F.lit(r"^[0-9]+$")), bare.try_cast("bigint"))


def norm(text: Column) -> Column:
    """Letters and digits only, marks and compatibility forms folded, '&' read as
    'and'."""
    return F.regexp_replace(F.replace(_folded(F.lower(text)), F.lit("&"), F.lit(" and ")), "[^a-z0-9]", "")


def title_key(title: Column) -> Column:
    """`norm` with format tags dropped and volume/part spellings folded."""
    s = F.regexp_replace(title, FORMAT_TAG_PATTERN, " ")
    s = F.regexp_replace(s, VOLUME_PATTERN, " volume ")
    s = F.regexp_replace(s, PART_PATTERN, " part ")
    # Few titles hold what the patterns start with; the others skip them.
    lower = F.lower(title)
    some = F.contains(title, F.lit("(")) | F.contains(lower, F.lit("vol")) | F.contains(lower, F.lit("pt")) | F.contains(lower, F.lit("part"))
    return norm(F.when(some, s).otherwise(title))


def lead_artist(credit: Column) -> Column:
    """First credited act, normalised; also splits on "and"."""
    return norm(F.get(F.split(credit, "(?i)" + UNITS_SPLIT_PATTERN, 2), F.lit(0)))


def unswap(frame: DataFrame) -> DataFrame:
    """Rows filed as artist=<title>, title=<placeholder> put right; a placeholder
    with more text ("SOUNDTRACK, SEASON 1") keeps that text after the title."""
    shown, title, artist = F.col("_shown"), F.col("title"), F.col("artist")
    names = F.create_map(*[F.lit(x) for pair in PLACEHOLDER_TITLES.items() for x in pair])
    more = F.startswith("_key", F.lit("soundtrack")) & F.element_at(names, F.col("_key")).isNull()
    return (
        # The key is a column of its own so that it is worked out once per row.
        frame.withColumn("_key", norm(title))
        .withColumn("_more", more)
        .withColumn("_shown", F.when(F.col("_more"), "Soundtrack").otherwise(F.element_at(names, F.col("_key"))))
        .withColumns({
            "title": F.when(shown.isNull(), title)
            .when(F.col("_more"), F.concat(artist, F.lit(" "), F.substring(
                title, F.lit(len("soundtrack") + 1), F.length(title))))
            .otherwise(artist),
            "artist": F.coalesce(shown, artist)})
        .drop("_key", "_more", "_shown"))


def clean_title(raw: Column) -> Column:
    """First quoted span; unquoted text is only trimmed."""
    quoted = F.regexp_extract(raw, rf"[{QUOTES}]\s*(.+?)\s*[{QUOTES}]", 1)
    return F.when(quoted != "", F.trim(quoted)).otherwise(
        F.trim(F.regexp_replace(F.trim(raw), '^["“”]+|["“”]+$', "")))


def normalise_title(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def bare_title(title: Column) -> Column:
    """Title without parentheticals, unless nothing else is left."""
    bare = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)", ""))
    return F.when(bare == "", title).otherwise(bare)


def search_key(title: Column, credit: Column) -> Column:
    return F.concat(bare_title(title), F.lit(" "), primary_artist(credit))


def version_base(title: Column) -> Column:
    """Title key with every (...) and [...] version note removed."""
    return F.trim(F.regexp_replace(match_key(title), r"\s*[\(\[].*?[\)\]]\s*", " "))


def split_pair(text: Column, album: bool = False) -> Column:
    """'A - B' split at the first separator into struct(title, artist,
    ambiguous). Lists of albums print the artist first."""
    parts = F.split(text, " - ", 2)
    a, b = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    split = F.size(parts) == 2
    title, artist = (b, a) if album else (a, b)
    return F.struct(
        F.when(split, title).alias("title"),
        F.when(split, artist).alias("artist"),
        (F.size(F.split(text, " - ", -1)) > 2).alias("ambiguous"))


def artwork_url(raw: Column, size: str = "") -> Column:
    """Artwork address: placeholder becomes blank, thumbnail size swapped."""
    out = F.replace(raw, F.lit("-180x180."), F.lit(f"-{size}.")) if size else raw
    return F.when(raw.isNull() | F.contains(raw, F.lit(LAZY_ARTWORK)), "").otherwise(out)


def pipe_to_comma(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit(","))


def visitor_hash(address: Column, agent: Column, salt: str) -> Column:
    """Salted SHA-256 of an address and agent, 16 hex digits."""
    blank = F.lit("")
    joined = F.concat_ws(":", F.lit(salt), F.coalesce(address, blank), F.coalesce(agent, blank))
    return F.substring(F.sha2(joined, 256), 1, 16)


def stated_year(text: Column, word: str = "COUNTDOWN") -> Column:
    """Year the page states after a heading word, or null."""
    found = F.regexp_extract(text, rf"(?i){word}\s+([0-9]{{4}})", 1)
    return F.nullif(found, F.lit("")).cast("int")


def artist_list(raw: Column) -> Column:
    """Array of names from 'a|b|...': trimmed, blanks and case-insensitive
    repeats dropped, first spelling and order kept."""
    names = F.filter(F.transform(F.split(raw, r"\|"), lambda s: F.trim(s)), lambda s: s != "")
    keys = F.transform(names, lambda s: F.lower(s))
    return F.filter(names, lambda s, i: F.array_position(keys, F.lower(s)) == i + 1)
