"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (0.0 if x == 0 else x)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return tuple(map(value, x))
    if hasattr(x, "asDict"):
        return tuple(value(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, value(v)) for k, v in x.items())) if False else tuple(value(v) for v in x.values())
    return x


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(spark_df, con, sql: str) -> str:
    """Empty if equal; else a short account."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
    types = dict(spark_df.dtypes)
    off = [(d[0], str(d[1]), types[d[0]]) for d in cur.description if kinds.get(str(d[1]), "?") != types[d[0]] and str(d[1]) in kinds]
    if off:
        return f"types {off}"
    want = Counter(tuple(value(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    got = Counter(tuple(value(r[c]) for c in sorted(names)) for r in spark_df.collect())
    if got == want:
        return ""
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {extra}; only in SQL {missing}"
