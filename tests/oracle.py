"""Side-by-side comparison of a Spark query and its SQL on the same Parquet tables, as order-insensitive multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def run_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{where}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    names, rows = run_sql(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs SQL {sorted(names)}"
    cols = sorted(names)
    want = Counter(tuple(_norm(r[names.index(c)]) for c in cols) for r in rows)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows vs {sum(want.values())}; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
