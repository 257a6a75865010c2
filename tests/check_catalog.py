"""Compare catalog queries with their SQL in DuckDB: check_catalog.py [sf] [name ...]."""

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as entry  # noqa: E402
from tests.conftest import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("string", "str"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else v)
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """Empty when equal: same columns, rows and values."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    a, b = normal(a), normal(b)
    kinds = [c for c in a.columns if a[c].dtype != b[c].dtype and not (a[c].isna().all() and b[c].isna().all())]
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.fillna(False).all():
            at = (~same.fillna(False)).idxmax()
            return f"{c}: {(~same.fillna(False)).sum()} of {len(a)} differ, first {x[at]!r} != {y[at]!r}; dtypes differ {kinds}"
    return f"dtypes {[(c, str(a[c].dtype), str(b[c].dtype)) for c in kinds]}" if kinds else ""


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    d = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session(), views(d), []
    for n in names:
        t0 = time.time()
        try:
            got = entry.queries()[n](spark, d).toPandas()
            sql = entry.oracle_sql().get(n)
            note = difference(got, con.execute(sql).df()) if sql else "(no SQL)"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
            got = []
        ok = note in ("", "(no SQL)") or note.startswith("dtypes")
        if not ok:
            bad.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n:32s} rows={len(got):>7} {time.time() - t0:6.2f}s {note}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")


if __name__ == "__main__":
    main()
