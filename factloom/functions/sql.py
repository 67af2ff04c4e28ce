"""Functions of the evidence model for SQL: temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and arguments, result, body.
FUNCTIONS = [
    ("parse_number(s STRING)", "DOUBLE", "try_cast(replace(nullif(regexp_extract(s, '[+-]?[0-9]+(?:,[0-9]+)*(?:[.][0-9]+)?', 0), ''), ',', '') AS DOUBLE)"),
    ("fiscal_start(d DATE)", "DATE", "make_date(year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END, 4, 1)"),
    ("fiscal_label(d DATE)", "STRING", "CASE WHEN d IS NULL THEN '-' WHEN month(d) = 4 AND day(d) = 1 THEN concat('FY', year(d), '-', lpad(cast((year(d) + 1) % 100 AS STRING), 2, '0')) ELSE cast(year(d) AS STRING) END"),
    ("recency(d DATE, as_of DATE)", "DOUBLE", "CASE WHEN d IS NULL THEN 0.3D ELSE exp(-greatest(datediff(as_of, d), 0) / 365) END"),
    ("percent_change(now DOUBLE, before DOUBLE)", "DOUBLE", "CASE WHEN before <> 0 THEN round((now - before) / abs(before) * 100, 4) END"),
]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
