"""Runs registered queries in Spark and their SQL in DuckDB and compares rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from entitymill.plans.derived import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if mine == theirs:
        return None
    only = lambda a, b: [x for x in a if x not in set(b)][:3]
    return f"{len(mine)} vs {len(theirs)} rows {sorted(names)}\n   spark {only(mine, theirs)}\n   sql   {only(theirs, mine)}"


def main() -> None:
    import __spark_entry__ as entry
    from entitymill.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                result = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(result) and not str(result).startswith("rows only")
        print(f"{name:42s} {time.time() - start:6.2f}s {result or 'ok'}", flush=True)
    print("failing:", bad)


if __name__ == "__main__":
    main()
