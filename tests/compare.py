"""Spark rows and DuckDB rows of one query, compared by column name and value."""

from __future__ import annotations

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return [plain(x) for x in v]
    if isinstance(v, (float, decimal.Decimal)) or type(v).__name__.startswith("float"):
        return round(float(v), 9)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differ(df, con, sql) -> str:
    """What differs, or nothing."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    said = con.execute(sql)
    want = rows([d[0] for d in said.description], said.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    off = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(off)} rows differ, first {off[0]}" if off else ""
