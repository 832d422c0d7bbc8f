"""Ranked rows out of captured pages."""
from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of HTML entities with their characters, as the standard lists them.
ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def decode_entities(text: Column) -> Column:
    """Numeric and named entities as characters, each once; others stay."""
    names = F.create_map(*(F.lit(v) for pair in ENTITIES.items() for v in pair))

    def decoded(name: Column) -> Column:
        code = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(
            F.startswith(name, F.lit("#")), F.substr(name, F.lit(2))).try_cast("int")
        # A code point as text, by way of its four bytes; none for surrogates.
        char = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF),
                      F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(names, name), char, F.concat(F.lit("&"), name, F.lit(";")))

    found = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))
    between = F.split(text, _ENTITY, -1)
    joined = F.array_join(F.zip_with(between, F.transform(found, decoded), lambda gap, c: F.concat(
        gap, F.coalesce(c, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text of a fragment: tags dropped, entities decoded, trimmed."""
    return F.trim(F.replace(decode_entities(F.regexp_replace(html, "<[^>]+>", "")), F.lit("\u00a0"), F.lit(" ")))


def extract_ranked_rows(pages: DataFrame, row_pattern: str, fields: dict[str, str] | None = None,
                        rank_pattern: str | None = None) -> DataFrame:
    """(page_id, rank, text, fields...) from pages of rows.

    `row_pattern` has one group, the row's content, which may span lines. The rank is what
    `rank_pattern` finds in the row, else its place on the page. Rows without a
    readable rank are dropped.
    """
    rows = pages.select("page_id", F.posexplode(
        F.regexp_extract_all("html", F.lit("(?s)" + row_pattern), F.lit(1))).alias("pos", "row"))
    rank = (F.col("pos") + 1) if rank_pattern is None else F.regexp_extract(
        "row", rank_pattern, 1).try_cast("int")
    found = [visible_text(F.regexp_extract("row", p, 1)).alias(n) for n, p in (fields or {}).items()]
    return (rows.select("page_id", rank.alias("rank"), visible_text(F.col("row")).alias("text"), *found)
            .filter("rank IS NOT NULL"))


def join_references(rows: DataFrame, lines: DataFrame, schema: str) -> DataFrame:
    """Rows whose payload is inline or named by `ref`, resolved against the
    page's keyed lines (page_id, ref, line) and parsed; rows without any payload
    are dropped."""
    keyed = lines.select("page_id", "ref", "line")
    return (
        rows.join(keyed, ["page_id", "ref"], "left")
        .withColumn("data", F.from_json(F.coalesce("inline", "line"), schema))
        .filter("data IS NOT NULL").drop("inline", "line", "ref"))


def ffill_merged_cells(rows: DataFrame, key: str, order: str, column: str,
                       numeric: bool = False) -> DataFrame:
    """Carries a merged cell's value down to the rows it covers. A numeric value
    that covered more than one row measured none of them and is dropped."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = rows.withColumn("fill_group", F.count(column).over(w))
    group = W.partitionBy(key, "fill_group")
    value = F.max(column).over(group)
    if numeric:
        value = F.when(F.count("*").over(group) == 1, value)
    return filled.withColumn(column, value).drop("fill_group")


def served_week_guard(pages: DataFrame, stated: Column, asked: str = "asked") -> DataFrame:
    """Pages whose own date is the date asked for."""
    return pages.filter(F.coalesce(stated == F.col(asked), F.lit(False)))
