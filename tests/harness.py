"""Runs registered queries against their oracle text in DuckDB."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, ".")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from touchline.catalog.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df.reindex(sorted(df.columns), axis=1).copy()
    for c in out.columns:
        s = out[c]
        if s.dtype == object or str(s.dtype).startswith(("str", "datetime")):
            out[c] = s.map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:10] if hasattr(v, "year") else v)
        if s.dtype == bool:
            out[c] = s.astype(int)
    num = [c for c in out.columns if out[c].dtype != object]
    keyed = out.copy()
    for c in num:
        keyed[c] = keyed[c].astype("float64").round(4)
    order = keyed.sort_values(list(keyed.columns), na_position="first", key=lambda s: s.map(lambda v: "" if v is None else str(v)) if s.dtype == object else s).index
    return out.loc[order].reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame, tol: float = 2e-6) -> list[str]:
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(a.columns)} vs {sorted(b.columns)}"]
    if len(a) != len(b):
        return [f"rows {len(a)} vs {len(b)}"]
    a, b = normal(a), normal(b)
    out = []
    for c in a.columns:
        x, y = a[c], b[c]
        try:
            x, y = x.astype("float64"), y.astype("float64")
            bad = ~(np.isclose(x, y, atol=tol, rtol=1e-9) | (x.isna() & y.isna()))
        except (ValueError, TypeError):
            bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = bad.idxmax()
            out.append(f"{c}: {int(bad.sum())} differ, e.g. {x[i]!r} vs {y[i]!r}")
    return out


def main(names: list[str], sf_dir: str) -> None:
    from touchline.catalog import REGISTRY
    from touchline.session import local_session

    spark = local_session("8")
    con = duck(sf_dir)
    for name in names or list(REGISTRY):
        q = REGISTRY[name]
        t = time.time()
        try:
            a = q.run(spark, sf_dir).toPandas()
            ts = time.time() - t
            if q.sql is None:
                print(f"{name}: {len(a)} rows, no oracle, {ts:.1f}s", flush=True)
                continue
            t = time.time()
            b = con.execute(q.sql).df()
            d = differences(a, b)
            print(f"{name}: {'OK' if not d else 'DIFF ' + '; '.join(d)[:900]} rows={len(a)} spark={ts:.1f}s duck={time.time() - t:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
