"""Runs registered queries next to their SQL checks. Also a command: compare.py SF_DIR [name...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


SAME_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
}


def compare(spark, con, name: str, folder: str) -> str | None:
    """None if equal, else what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, folder)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}"
    wrong = [
        (f.name, f.dataType.simpleString(), types[f.name])
        for f in df.schema
        if SAME_TYPES.get(f.dataType.simpleString()) != types[f.name].split("(")[0]
    ]
    if wrong:
        return f"types {wrong}"
    got, want = _bag(df.columns, rows), _bag(columns, expected)
    if got != want:
        return f"{len(rows)} rows <> {len(expected)}; only here {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
    return None if rows else "both empty"


def main() -> int:
    from filespoor.session import build_session
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[4]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__driver__maxResultSize="4g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in names or list(entry.queries()):
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # keep going, report at the end
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok" if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
