"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py SF [name prefixes...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].dt.strftime("%Y-%m-%d")
        out[c] = out[c].map(lambda v: "~" if v is None or v is pd.NA or v is pd.NaT or v != v else
                            (repr(float(v)) if isinstance(v, float) else str(v)))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


KIND = {"int64": "int", "int32": "int", "int16": "int", "double": "float", "float": "float", "bool": "bool",
        "string": "str", "large_string": "str", "date32[day]": "date"}


def differences(spark_table, duck_table) -> str | None:
    """None when equal, otherwise a short description."""
    if sorted(spark_table.column_names) != sorted(duck_table.column_names):
        return f"columns {sorted(spark_table.column_names)} vs {sorted(duck_table.column_names)}"
    bad = [(f.name, str(f.type), str(duck_table.schema.field(f.name).type)) for f in spark_table.schema
           if KIND.get(str(f.type), str(f.type)) != KIND.get(str(duck_table.schema.field(f.name).type),
                                                             str(duck_table.schema.field(f.name).type))
           and "null" not in str(f.type)]
    if bad:
        return f"types {bad}"
    kw = {"integer_object_nulls": True, "date_as_object": True}
    a, b = canonical(spark_table.to_pandas(**kw)), canonical(duck_table.to_pandas(**kw))
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a.equals(b):
        return None
    diff = (a != b)
    cols = [c for c in a.columns if diff[c].any()]
    rows = diff.any(axis=1)
    return f"{int(rows.sum())} of {len(a)} rows differ in {cols}\n{a[rows].head(3)}\n{b[rows].head(3)}"


def main() -> int:
    from lossloom.plans.catalog import REGISTRY
    from lossloom.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    only_sql = "--sql" in sys.argv
    prefixes = [a for a in sys.argv[2:] if a != "--sql"]
    names = [n for n, q in REGISTRY.items() if (not prefixes or any(n.startswith(p) for p in prefixes)) and (q.sql or not only_sql)]
    spark = build_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for n in names:
        q = REGISTRY[n]
        t0 = time.time()
        try:
            got = q.run(spark, sf_dir).toArrow()
            t1 = time.time()
            if q.sql is None:
                print(f"rows  {n} {got.num_rows} rows {t1 - t0:.1f}s", flush=True)
                if not got.num_rows:
                    failed.append(n)
                continue
            want = con.sql(q.oracle()).to_arrow_table()
            d = differences(got, want)
            state = "ok   " if d is None else "FAIL "
            if d is None and got.num_rows == 0:
                state = "EMPTY"
            print(f"{state} {n} {got.num_rows} rows spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s", flush=True)
        except Exception as e:  # report and go on with the next query
            d = f"{type(e).__name__}: {str(e)[:1500]}"
            print(f"ERROR {n}", flush=True)
        if d is not None:
            failed.append(n)
            print(d, flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} good; failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    raise SystemExit(main())
