"""Run registered queries on Spark and their SQL on DuckDB and compare the sorted rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    result = con.execute(sql)
    want_cols = [d[0] for d in result.description]
    want = rows_of(want_cols, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(want_cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(want_cols)}"
    if len(want) != len(got):
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows against {len(want)}: only Spark {extra}, only SQL {lost}"
    for g, w in zip(got, want):
        if g != w or [type(a) for a in g] != [type(a) for a in w]:
            return f"row {g} against {w}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from fleetlens import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                problem = differences(df, con, oracles[name])
                note = f"{con.execute('SELECT count(*) FROM (' + oracles[name].strip() + ')').fetchone()[0]} rows"
            else:
                problem, note = None, f"{df.count()} rows, no SQL"
        except Exception as error:  # show every failing query, not just the first
            problem, note = f"{type(error).__name__}: {str(error)[:700]}", ""
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {note} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
