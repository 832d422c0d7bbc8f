"""Date helpers as Column functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The textual date forms found in list files.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "yyyy/MM/dd")


def canonical_date(text: Column) -> Column:
    """One DATE from any of the textual forms; null when none fits."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, f) for f in DATE_FORMATS])


def to_saturday(day: Column) -> Column:
    """The Saturday on or after the day."""
    return F.next_day(F.date_sub(day, 1), "SAT")


def label_year_date(week: Column, year: Column, month: Column, day: Column) -> Column:
    """Date of a page labelled "week W / Y" that prints only month and day: a
    closing week printed in January is next year's, an opening one in December
    the year before's."""
    shifted = (
        F.when((week >= 52) & (month == 1), year + 1)
        .when((week <= 1) & (month == 12), year - 1)
        .otherwise(year))
    return F.try_to_date(F.concat_ws("-", shifted, month, day), "yyyy-M-d")


def served_date(html: Column, pattern: str = r"Week of ([A-Z][a-z]+ \d{1,2}, \d{4})") -> Column:
    """The date a page itself states."""
    return F.try_to_date(F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")), "MMMM d, yyyy")


def plausible_capture(week: Column, taken: Column, days: int = 45) -> Column:
    """A capture shows a week's final list only if taken 1..`days` days later."""
    return F.coalesce((week >= F.date_sub(taken, days)) & (week < taken), F.lit(False))
