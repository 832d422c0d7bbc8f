"""Reading and writing list files."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlore import schemas
from chartlore.functions.dates import canonical_date
from chartlore.functions.text import safe_int
from chartlore.operators.history import with_all_keys, without_keys

# Source column -> canonical column, for all spellings found in files.
RENAMES = {
    "Date": "date", "Rank": "rank", "Song": "title", "Artist": "artist",
    "Last Week": "last_week", "Peak Position": "peak_position",
    "Weeks on Chart": "weeks_on_chart", "Weeks in Charts": "weeks_on_chart",
    "Image URL": "image_url", "song": "title", "album": "title", "Album": "title",
}


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Canonical names and order, typed; album titles go in `title`."""
    known = {old: new for old, new in RENAMES.items() if old in raw.columns}
    named = raw.withColumnsRenamed(known)

    def column(field: T.StructField) -> Column:
        if field.name not in named.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(field.name)
        if field.name == "date" and named.schema["date"].dataType == T.StringType():
            c = canonical_date(c)
        elif isinstance(field.dataType, T.IntegerType):
            c = safe_int(c)
        return c.alias(field.name)

    return named.select(*[column(f) for f in schemas.ENTRY if f.name != "chart" or "chart" in named.columns])


REQUIRED = ("date", "rank", "title")
ROWS_A_FILE = 40_000
KEY_RULE = 1  # raised whenever the keys of titles or credits are worked out differently


def read_list_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """List files as text columns named by their header, whatever its order.
    Quotes inside a quoted value are doubled. Files of one call share a header:
    a file with another one fails when it is read. `multi_line` reads values
    that hold line ends, one task per file."""
    reader = spark.read.options(header=True, inferSchema=False, enforceSchema=False, quote='"', escape='"',
                                multiLine=multi_line)
    raw = reader.csv(path)
    names = {RENAMES.get(c, c) for c in raw.columns}
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"{path} has no column for {', '.join(missing)}")
    return raw


def scan_chart_csv(spark: SparkSession, path: str, chart: str, multi_line: bool = False) -> DataFrame:
    """One list's file as entries; a missing file is an empty list."""
    try:
        raw = read_list_csv(spark, path, multi_line)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.ENTRY)
    return normalize_columns(raw).select(F.lit(chart).alias("chart"), "*")


def catalogue(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    """One row per list file: chart, file, its header, the canonical columns and,
    where it can't be used, the defect. Only the block that holds a file's first
    line is read."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_name", "_metadata.file_block_start")
    # Lines of a block are numbered in their order.
    first = lines.filter("file_block_start = 0").withColumn("no", F.monotonically_increasing_id()).groupBy("file_path").agg(
        F.min_by("value", "no").alias("line"), F.first("file_name").alias("file_name"))
    chart = F.regexp_extract("file_path", r"chart=([^/]+)/", 1) if partitioned else F.regexp_extract("file_name", r"^(.+)\.csv$", 1)
    names = F.transform(F.split(F.regexp_replace("line", "^\ufeff", ""), ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in RENAMES.items() for x in pair])
    columns = F.transform("header", lambda c: F.coalesce(F.try_element_at(known, c), c))
    missing = F.filter(F.array(*map(F.lit, REQUIRED)), lambda c: ~F.array_contains("columns", c))
    twice = F.size(F.array_distinct("columns")) < F.size("columns")
    return first.select(chart.alias("chart"), F.col("file_path").alias("file"), names.alias("header")).withColumn("columns", columns).withColumn(
        "defect", F.when(F.size(missing) > 0, F.concat(F.lit("no column for "), F.array_join(missing, ", "))).when(twice, "a column twice"))


def scan_catalogued(spark: SparkSession, found: DataFrame, multi_line: bool = False) -> DataFrame:
    """All lists of a catalogue without a defect as one relation. Files that share
    a header are read together; lists are as many as files, so their names fit
    the driver."""
    groups: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for r in found.filter("defect IS NULL").select("header", "file", "chart").collect():
        groups.setdefault(tuple(r.header), []).append((r.file, r.chart))
    out = spark.createDataFrame([], schemas.ENTRY)
    for files in groups.values():
        raw = read_list_csv(spark, [f for f, _ in files], multi_line).withColumn("_file", F.col("_metadata.file_path"))
        charts = spark.createDataFrame(files, "_file string, chart string")
        out = out.unionByName(normalize_columns(raw.join(charts, "_file").drop("_file")).select(*schemas.ENTRY.fieldNames()))
    return out


def chart_dates(entries: DataFrame) -> DataFrame:
    """Distinct published dates, newest first."""
    return (entries.select("chart", "date").filter("date IS NOT NULL").distinct()
            .orderBy("chart", F.desc("date")))


def scan_all_charts(spark: SparkSession, path: str, registry: DataFrame | None = None,
                    partitioned: bool = True) -> DataFrame:
    """All lists as one relation. Partitioned folders give the list key as a
    partition column, so a filter on it prunes files; otherwise each file's own
    name is the key. A registry keeps registered lists only."""
    raw = read_list_csv(spark, path)
    if partitioned:
        raw = raw.withColumn("chart", F.col("chart").cast("string"))
    else:
        raw = raw.withColumn("chart", F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.csv$", 1))
    out = normalize_columns(raw)
    if registry is not None:
        out = out.join(registry.select("chart"), "chart", "left_semi")
    return out


def write_history(entries: DataFrame, path: str, mode: str = "overwrite", placed: bool = False) -> None:
    """The stored history: Parquet in ranges of list and week, sorted within. A
    list lies in few files, each with narrow bounds, so filters on list or week
    skip files and row groups; a large list splits by week. Entries that come
    `placed` by list, each list whole in a partition, stay where they are: they
    are not worked out a second time for the bounds of ranges, and a list lies in
    few files. Keys of title and credit are stored with the rows, in a folder named
    by the rule they follow. Lists compress so well that a split of the usual size
    would hold many millions of rows; a split counts each file as some megabytes,
    so files of `ROWS_A_FILE` rows at most bound what a reading task sorts."""
    rows = without_keys(entries)
    rows = rows if placed else rows.repartitionByRange("chart", "date")
    keyed = with_all_keys(rows).withColumn("key_rule", F.lit(KEY_RULE))
    (keyed.sortWithinPartitions("chart", "date", "rank").write.mode(mode)
     .option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("key_rule").parquet(path))


def read_history(spark: SparkSession, path: str, schema: T.StructType = schemas.ENTRY) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def read_keyed_history(spark: SparkSession, path: str, schema: T.StructType = schemas.ENTRY) -> DataFrame:
    """The stored history with its keys. Files written under another rule, if
    there are any, have theirs worked out anew."""
    keys = T.StructType([T.StructField(k, T.StringType()) for k in ("k_title", "k_artist", "k_credit")])
    columns = [*schema.fieldNames(), *keys.fieldNames()]
    rows = spark.read.schema(T.StructType([*schema, *keys, T.StructField("key_rule", T.IntegerType())])).parquet(path)
    current = rows.filter(F.col("key_rule") == KEY_RULE).select(*columns)
    others = rows.filter(~F.col("key_rule").eqNullSafe(F.lit(KEY_RULE)))
    if others.isEmpty():  # by the names of folders; no file of the rule is read
        return current
    return current.unionByName(with_all_keys(others.select(*schema.fieldNames())).select(*columns))


def csv_sink(entries: DataFrame, path: str, partition: bool = True) -> None:
    """List files with dates as m/d/yyyy and blanks for nulls."""
    names = {new: old for old, new in RENAMES.items() if old in schemas.LIST_FILE.fieldNames()}
    cols = [F.date_format("date", "M/d/yyyy").alias("Date"),
            *[F.col(c).cast("string").alias(names[c]) for c in entries.columns if c in names and c != "date"]]
    keep = [F.col("chart")] if partition else []
    writer = (entries.select(*cols, *keep).write.mode("overwrite").option("header", True)
              .option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    (writer.partitionBy("chart") if partition else writer).csv(path)
