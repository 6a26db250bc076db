"""Runs a registered query and its check SQL on the same tables and compares the values.

``python tests/oracle.py SF_DIR [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("string", "str")):
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NA or v != v else str(v))
        else:
            df[c] = df[c].astype("float64").fillna(-1e300)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def kind(dtype: str) -> str:
    d = dtype.lower()
    return {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar"}.get(d, d)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when the query and the SQL agree on columns, types, row count and values."""
    got_types = {c: kind(t) for c, t in spark_df.dtypes}
    rel = con.sql(sql)
    want_types = {c: str(t).lower() for c, t in zip(rel.columns, rel.types)}
    out = []
    if sorted(got_types) != sorted(want_types):
        return [f"columns {sorted(got_types)} != {sorted(want_types)}"]
    out += [f"type {c}: {got_types[c]} != {want_types[c]}" for c in got_types if got_types[c] != want_types[c]]
    got, want = normal(spark_df.toPandas()), normal(rel.df())
    if len(got) != len(want):
        return out + [f"rows {len(got)} != {len(want)}"]
    for c in got.columns:
        if got[c].dtype == object:
            bad = (got[c] != want[c]).sum()
        else:
            bad = int((~np.isclose(got[c], want[c], rtol=0, atol=0)).sum())
        if bad:
            i = int(np.flatnonzero((got[c] != want[c]).to_numpy())[0])
            out.append(f"{c}: {bad} values differ, first {got.iloc[i].to_dict()} != {want.iloc[i].to_dict()}")
    return out


def main(sf_dir: str, prefixes: list[str]) -> int:
    from tabweave.plans import registry
    from tabweave.session import build_session

    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in registry.CHECKS:
                t1 = time.time()
                diffs = differences(df, con, registry.CHECKS[name])
                note = "ok" if not diffs else "DIFF " + " | ".join(diffs)[:900]
            else:
                rows = df.collect()
                diffs, note = [], f"rows-only {len(rows)} {rows[:2] if os.environ.get('SHOW') else ''}"
        except Exception as e:  # report and go on
            diffs, note = ["error"], "ERROR " + (traceback.format_exc()[-1500:] if os.environ.get("TRACE") else str(e)[:600])
        failed += bool(diffs)
        print(f"{name:32s} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
