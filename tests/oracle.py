"""Run queries and their SQL side by side: python tests/oracle.py DIR [NAME...]."""

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def table(arrow) -> tuple[list[str], Counter]:
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, Counter(zip(*[[norm(v) for v in c] for c in cols])) if cols else Counter()


def duck(directory: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def compare(spark, directory: str, name: str) -> str:
    import __spark_entry__ as e

    began = time.time()
    names, got = table(e.queries()[name](spark, directory).toArrow())
    took = time.time() - began
    sql = e.oracle_sql().get(name)
    if sql is None:
        return f"rows only {sum(got.values())} ({took:.1f} s)"
    cols, want = table(duck(directory).execute(sql).to_arrow_table())
    if names != cols:
        return f"FAIL columns {names} {cols}"
    if got != want:
        return f"FAIL {sum(got.values())} rows, {sum(want.values())} wanted; extra {list((got - want).items())[:3]}, missing {list((want - got).items())[:3]}"
    return f"ok {sum(got.values())} rows ({took:.1f} s)"


if __name__ == "__main__":
    from serat.session import local_session

    spark = local_session(8)
    import __spark_entry__ as e

    for name in sys.argv[2:] or e.queries():
        try:
            print(name, compare(spark, sys.argv[1], name), flush=True)
        except Exception as x:
            print(name, "FAIL", str(x)[:1500], flush=True)
