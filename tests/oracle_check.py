"""Compare registered queries with their SQL oracles: ``python tests/oracle_check.py DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(tuple(str(row[i]) for i in order) for row in rows),
    )


def spark_rows(df):
    return normal(df.columns, df.collect())


def oracle_rows(con, text: str):
    cursor = con.execute(text)
    return normal([d[0] for d in cursor.description], cursor.fetchall())


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            spark_time, start = time.time() - start, time.time()
            want = oracle_rows(con, oracles[name])
            ok = got == want
            print(f"{'ok  ' if ok else 'DIFF'} {name} rows={len(got[1])}/{len(want[1])} "
                  f"spark={spark_time:.2f}s oracle={time.time() - start:.2f}s", flush=True)
            if not ok:
                if got[0] != want[0]:
                    print("  columns", got[0], want[0])
                a, b = set(got[1]), set(want[1])
                for label, rows in (("only spark ", a - b), ("only oracle", b - a)):
                    for row in sorted(rows)[:2]:
                        print("  ", label, str(row)[:1500])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            ok = False
            print(f"FAIL {name}: {str(error)[:1200]}", flush=True)
        bad += not ok
    print(f"{bad} of {len(names or queries)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
