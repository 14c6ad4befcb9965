"""Run registered queries against their oracle SQL and compare rows, types and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(_clean(v) for v in row) for row in zip(*cols)), key=repr)


def _kind(t: pa.DataType) -> str:
    return "string" if pa.types.is_large_string(t) else str(t)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    got = spark_df.toArrow()
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    for n in got.column_names:
        a, b = _kind(got.schema.field(n).type), _kind(want.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} != {b}"
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; spark {a[:2]} oracle {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"spark {x} != oracle {y} ({sum(p != q for p, q in zip(a, b))} of {len(a)} rows)"
    return None if a else "both empty"


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from cortexframe.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = compare(fn(spark, sf), con, oracles[name])
            else:
                n = len(fn(spark, sf).collect())
                diff = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - t
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name:42s} {took:6.2f}s {'' if name in oracles else '(rows only) '}{diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
