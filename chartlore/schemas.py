"""Explicit schemas. Files are never schema-inferred."""
from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DateType()

# Column names of the weekly list files, in file order.
LIST_FILE = T.StructType([
    T.StructField(n, _S)
    for n in ("Date", "Rank", "Song", "Artist", "Last Week", "Peak Position",
              "Weeks on Chart", "Image URL")
])

ENTRY = _struct(chart=_S, date=_D, rank=_I, title=_S, artist=_S, last_week=_I,
                peak_position=_I, weeks_on_chart=_I, image_url=_S)
REGISTRY = _struct(chart=_S, label=_S, grp=_S, depth=_I, kind=_S, ord=_I)
YEAREND_FILE = T.StructType([
    T.StructField(n, _S) for n in ("Chart", "Year", "Rank", "Song", "Artist", "Image URL")
])
UNITS = _struct(chart=_S, date=_D, title=_S, artist=_S, rank=_I, units=T.LongType(),
                source=_S, source_week=_D, source_rank=_I)
VISIT = _struct(ts=T.TimestampType(), path=_S, visitor=_S)
