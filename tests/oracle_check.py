"""Run registered queries next to their oracle SQL: python -m tests.oracle_check [prefix ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from supportlake.plans.catalog import ORACLES, QUERIES
from supportlake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(frame, columns):
    return sorted(
        (tuple(_plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr
    )


def compare(spark, con, sf: str, name: str) -> str:
    began = time.time()
    got = QUERIES[name](spark, sf)
    table = got.toArrow()
    spent = time.time() - began
    if name not in ORACLES:
        return f"rows-only {table.num_rows} rows {spent:.1f}s"
    began = time.time()
    want = con.sql(ORACLES[name]).df()
    sql_spent = time.time() - began
    columns = sorted(table.column_names)
    if columns != sorted(want.columns):
        return f"FAIL columns {columns} vs {sorted(want.columns)}"
    import pandas as pd

    left = pd.DataFrame({c: pd.Series(table.column(c).to_pylist(), dtype=object) for c in columns})
    a, b = rows_of(left, columns), rows_of(want.astype(object).where(want.notna(), None), columns)
    if len(a) != len(b):
        return f"FAIL rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"FAIL {len(bad)}/{len(a)} differ, first: {str(bad[0])[:700]}"
    return f"ok {len(a)} rows {spent:.1f}s sql {sql_spent:.1f}s"


def main() -> None:
    sf = "/root/testdata/sf0.01"
    if len(sys.argv) > 1 and sys.argv[1].startswith("/"):
        sf = sys.argv.pop(1)
    wanted = sys.argv[1:] or [""]
    spark = local_session()
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    for name in QUERIES:
        if not any(name.startswith(w) for w in wanted):
            continue
        try:
            print(name, compare(spark, con, sf, name), flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            print(name, "ERROR", type(error).__name__, str(error)[:600].replace("\n", " "), flush=True)


if __name__ == "__main__":
    main()
