"""Run registered queries beside their SQL in a second engine and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, folder: str, build, sql: str, con=None) -> tuple[str, int]:
    con = con or connect(folder)
    df = build(spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(sql)
    want = normal(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} vs {b}", len(got)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    names = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}
    for c, kind in df.dtypes:
        if names.get(kind, kind) != kinds[c]:
            return f"type of {c}: {kind} vs {kinds[c]}", len(got)
    return "ok", len(got)


def main() -> None:
    import __spark_entry__ as entry
    from seqledger.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    bad = 0
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                verdict, rows = compare(spark, folder, build, oracle[name], con)
            else:
                verdict, rows = "no sql", len(build(spark, folder).collect())
        except Exception as error:  # noqa: BLE001
            verdict, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += verdict not in ("ok", "no sql")
        print(f"{name:40s} {time.time() - start:6.2f}s rows={rows} {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
