"""Comparison of a query with its oracle SQL, order and column order aside."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings node_records street_segment_records poi_records web_places "
    "place_pages map_features map_feature_points speed_feeds speed_units mix_targets"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return v


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    ours, theirs = df.columns, None
    cur = con.execute(sql)
    theirs = [c[0] for c in cur.description]
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} and {sorted(theirs)}"
    a, b = rows_of(ours, df.collect()), rows_of(theirs, cur.fetchall())
    if a == b:
        return ""
    sa, sb = {repr(x) for x in a}, {repr(x) for x in b}
    return f"{len(a)} and {len(b)} rows; only in Spark {sorted(sa - sb)[:4]}; only in SQL {sorted(sb - sa)[:4]}"
