"""Scalar functions on the shapes that matter."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from chartlore.functions import credits, dates, text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize("credit, key", [
    ("Weezer Featuring Best Coast", "weezer"),
    ("Weezer", "weezer"),
    ("David Guetta & Bebe Rexha", "david guetta"),
    ("Rumi, JINU, EJAE & Andrew Choi", "rumi"),
    ("Rumi & JINU: EJAE & Andrew Choi", "rumi"),
    ("Tyler, The Creator", "tyler"),
    ("Hank Williams, Jr.", "hank williams, jr."),
    ("Hank Williams, Jr. Featuring Someone", "hank williams, jr."),
    ("10,000 Maniacs", "10,000 maniacs"),
    ("Lil Nas X", "lil nas x"),
    # The marker " X " is found first, inside the name.
    ("Lil Nas X Featuring Billy Ray Cyrus", "lil nas"),
    ("  Spaced + Out  ", "spaced"),
    ("No Comma", "no comma"),
    (None, None),
])
def test_primary_artist(spark, credit, key):
    assert one(spark, credit, credits.primary_artist) == key


def test_primary_credit_keeps_case_and_commas(spark):
    assert one(spark, "Tyler, The Creator feat. A", credits.primary_credit) == "Tyler, The Creator"


@pytest.mark.parametrize("credit, name, hit", [
    ("Tyla Featuring Zara Larsson", "Tyla", True),
    ("Tyla Yaweh", "Tyla", False),
    ("Lil Nas X Featuring Elton John", "Lil Nas X", True),
    ("Lil Nas X Featuring Elton John", "elton john", True),
    ("The Elton John Band", "Elton John", True),
    ("The Elton John Bandits", "Elton John", False),
    ("Dionne & Friends Featuring Elton John, Gladys Knight And Stevie Wonder", "Gladys Knight", True),
    ("A (with B)", "b", False),
    ("A/B", "B", True),
    ("P!nk", "P!nk", True),
    ("Anyone", "  ", False),
    (None, "A", False),
])
def test_names_artist(spark, credit, name, hit):
    row = spark.createDataFrame([(credit, name)], "c string, n string").select(
        credits.names_artist(F.col("c"), name).alias("a"),
        credits.names_artist_col(F.col("c"), F.col("n")).alias("b")).first()
    assert (row.a, row.b) == (hit, hit)


@pytest.mark.parametrize("raw, value", [("5", 5), ("5.9", 5), ("0", None), ("-", None), (" ", None), (None, None), ("x", None)])
def test_safe_int(spark, raw, value):
    assert one(spark, raw, text.safe_int) == value
    assert one(spark, raw, lambda c: text.safe_int(c, 7)) == (7 if value is None else value)


def test_norm_and_title_key(spark):
    assert one(spark, "Beyoncé & Jay-Z", text.norm) == "beyonceandjayz"
    assert one(spark, "Hits, Vol. 2 (EP)", text.title_key) == one(spark, "HITS VOLUME 2", text.title_key)
    assert one(spark, "Film (Original Motion Picture Soundtrack) Pt. 1", text.title_key) == "filmpart1"
    assert one(spark, "X and Y, Z", text.lead_artist) == "x"


def test_artist_list(spark):
    assert one(spark, " A |b||a|B | C", text.artist_list) == ["A", "b", "C"]
    assert one(spark, "", text.artist_list) == []


def test_split_pair(spark):
    row = one(spark, "One - Two - Three", text.split_pair)
    assert (row.title, row.artist, row.ambiguous) == ("One", "Two - Three", True)
    assert one(spark, "Artist - Album", lambda c: text.split_pair(c, album=True)).title == "Album"
    assert one(spark, "nothing", text.split_pair).title is None


def test_clean_and_bare_titles(spark):
    assert one(spark, '" A " / " B "', text.clean_title) == "A"
    assert one(spark, "“Hey”", text.clean_title) == "Hey"
    assert one(spark, "(All In)", text.bare_title) == "(All In)"
    assert one(spark, "Song (Remix)", text.bare_title) == "Song"
    assert one(spark, "Song (feat. A) [Live]", text.version_base) == "song"


def test_unswap(spark):
    rows = [("SOUNDTRACK", "Film"), ("VARIOUS ARTISTS", "Now 5"), ("SOUNDTRACK, SEASON 1", "Show"), ("Real", "Band")]
    got = [tuple(r) for r in text.unswap(spark.createDataFrame(rows, "title string, artist string")).collect()]
    assert got == [("Film", "Soundtrack"), ("Now 5", "Various Artists"), ("Show , SEASON 1", "Soundtrack"), ("Real", "Band")]


def test_dates(spark):
    for raw in ("2020-01-04", "1/4/2020", "January 4, 2020"):
        assert one(spark, raw, dates.canonical_date) == dt.date(2020, 1, 4)
    assert one(spark, "junk", dates.canonical_date) is None
    assert one(spark, dt.date(2020, 1, 4), dates.to_saturday, "date") == dt.date(2020, 1, 4)
    assert one(spark, dt.date(2020, 1, 5), dates.to_saturday, "date") == dt.date(2020, 1, 11)

    def label(week, year, month, day):
        return spark.range(1).select(dates.label_year_date(*map(F.lit, (week, year, month, day))).alias("v")).first().v

    assert label(53, 2004, 1, 1) == dt.date(2005, 1, 1)
    assert label(1, 2004, 12, 30) == dt.date(2003, 12, 30)
    assert label(10, 2004, 3, 6) == dt.date(2004, 3, 6)
    assert label(10, 2004, 2, 31) is None


def test_visitor_hash_is_stable(spark):
    frame = spark.createDataFrame([("1.2.3.4", "ua"), (None, None)], "ip string, ua string")
    got = [r.h for r in frame.select(text.visitor_hash(F.col("ip"), F.col("ua"), "s").alias("h")).collect()]
    assert all(len(h) == 16 for h in got) and got[0] != got[1]


def test_sql_functions_equal_column_functions(spark):
    from chartlore.functions.sql import register_sql_functions

    register_sql_functions(spark)
    rows = ["Weezer Featuring B", "Hank Williams, Jr. & X", "Rumi, JINU", "10,000 Maniacs", "Hits, Vol. 2 (EP)", "Plain"]
    frame = spark.createDataFrame([(r,) for r in rows], "s string")
    frame.createOrReplaceTempView("credit_lines")
    got = spark.sql("SELECT primary_credit(s) AS a, primary_artist(s) AS b, title_key(s) AS c FROM credit_lines").collect()
    want = frame.select(credits.primary_credit(F.col("s")), credits.primary_artist(F.col("s")), text.title_key(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
