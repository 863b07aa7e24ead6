"""Run a registered query next to its SQL and compare rows and types.

As a script: `python -m tests.oracle [-d folder] [query ...]`.
"""

from __future__ import annotations

import argparse
import decimal
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _key(row):
    return tuple((x is not None, str(type(x).__name__), x if x is not None else "") for x in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    rows = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return names, types, sorted(rows, key=_key)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).upper() for d in cur.description}
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    rows = [tuple(_cell(r[i]) for i in order) for r in cur.fetchall()]
    return names, types, sorted(rows, key=_key)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def differences(df, con, sql) -> list[str]:
    names, types, left = rows_of_spark(df)
    names2, types2, right = rows_of_sql(con, sql)
    if names != names2:
        return [f"columns {names} != {names2}"]
    out = [
        f"type of {n}: {types[n]} != {types2[n]}" for n in names if SAME.get(types[n]) != types2[n]
    ]
    if len(left) != len(right):
        out.append(f"rows {len(left)} != {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        out.append(f"{len(bad)} of {len(left)} rows differ")
        for a, b in bad[:2]:
            for n, x, y in zip(names, a, b):
                if x != y:
                    out.append(f"   {n}: {str(x)[:300]!r} != {str(y)[:300]!r}  (row {str(a)[:80]})")
    return out


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from tests.spark import session

    spark = session()
    con = connect(args.d)
    sqls, failed = oracle_sql(), []
    for name, run in queries().items():
        if args.names and name not in args.names:
            continue
        begin = time.time()
        try:
            df = run(spark, args.d)
            if name in sqls:
                found, n = differences(df, con, sqls[name]), 0
                note = "; ".join(found) if found else "ok"
            else:
                found, note, n = [], "rows only", df.count()
        except Exception as e:  # noqa: BLE001
            found, note, n = ["error"], f"{type(e).__name__}: {str(e)[:1500]}", -1
        if found:
            failed.append(name)
        print(f"{name:26s} {n:8d} rows {time.time() - begin:6.2f}s  {note}", flush=True)
    print("FAILED:", failed)


if __name__ == "__main__":
    main()
