"""Runs the named queries beside their SQL and compares the results.

    python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"dec:{value}"
    if isinstance(value, datetime.datetime):
        return f"ts:{value.replace(tzinfo=None).isoformat()}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(con, df, oracle: str | None) -> str | None:
    """None when equal, otherwise what differs."""
    got = df.collect()
    if oracle is None:
        return None if got else "no rows"
    cur = con.execute(oracle)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return None
    return (f"{len(got)} vs {len(want)} rows; {sorted(columns)}; only spark "
            f"{list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}")


def main(argv: list[str]) -> int:
    from noticelake.session import build_session
    from noticelake.plans import streams  # noqa: F401  (registers its queries)
    from noticelake.plans.catalog import oracle_sql, queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            result = compare(con, run(spark, sf_dir), oracles.get(name))
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {time.time() - start:6.2f}s {name}"
              f"{'' if name in oracles else ' (rows only)'}{'' if result is None else ' ' + result}", flush=True)
    print(f"{bad} of {len(queries())} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
