"""The credit and title functions for SQL users.

They are SQL functions, not Python ones: Spark inlines their bodies, so they
stay inside the generated code and filters on them are planned as usual.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from chartlore.functions.credits import MARKER_PATTERN, NAME_COMMA_PATTERN
from chartlore.functions.text import (
    ACCENTED, FORMAT_TAG_PATTERN, LIGATURES, OTHER_PATTERN, PART_PATTERN, PLAIN, VOLUME_PATTERN)


def _functions() -> dict[str, str]:
    one = f"translate(lower({{0}}), '{ACCENTED}', '{PLAIN}')"
    pairs = ", ".join(f"'{c}', '{p}'" for c, p in LIGATURES.items())
    many = (f"array_join(transform(split({one}, ''), c -> CASE WHEN c > '\x7f' THEN "
            f"coalesce(try_element_at(map({pairs}), c), '') ELSE c END), '')")
    norm = (f"regexp_replace(replace(CASE WHEN {one} RLIKE r'{OTHER_PATTERN}' THEN {many} ELSE {one} END, "
            "'&', ' and '), '[^a-z0-9]', '')")
    key = f"regexp_replace({{0}}, r'{FORMAT_TAG_PATTERN}', ' ')"
    key = f"regexp_replace({key}, r'{VOLUME_PATTERN}', ' volume ')"
    key = f"regexp_replace({key}, r'{PART_PATTERN}', ' part ')"
    credit = f"trim(regexp_replace(trim({{0}}), r'(?i){MARKER_PATTERN}', ''))"
    around = "substring(c, greatest(i - 1, 1), i + 6 - greatest(i - 1, 1))"
    cut = (f"get(filter(sequence(1, length(c)), i -> substring(c, i, 1) = ',' AND NOT "
           f"{around} RLIKE r'(?i){NAME_COMMA_PATTERN}'), 0)")
    lead = f"CASE WHEN {cut} IS NOT NULL THEN trim(substring(c, 1, {cut} - 1)) ELSE c END"
    return {
        "primary_credit": credit.format("s"),
        "primary_artist": f"(SELECT lower({lead}) FROM (SELECT {credit.format('s')} AS c))",
        "title_key": norm.format(key.format("s")),
    }


def register_sql_functions(spark: SparkSession) -> None:
    """primary_credit(s), primary_artist(s) and title_key(s) for this session."""
    for name, body in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
