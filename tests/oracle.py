"""Runs registered queries beside their oracle SQL.

    python tests/oracle.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[list[str], list[str], list[str], list[str]]:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    return sorted(df.columns), sorted(names), got, want


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from docwarden.session import local_session

    spark, con = local_session("oracle"), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            if name not in oracles:
                print(f"{name}: rows only, {fn(spark, sf_dir).count()} rows, {time.time() - start:.1f}s", flush=True)
                continue
            have, want_cols, got, want = compare(spark, con, sf_dir, fn, oracles[name])
        except Exception as exc:
            bad += 1
            print(f"{name}: ERROR {str(exc)[:1500]}", flush=True)
            continue
        same = have == want_cols and got == want
        bad += not same
        print(f"{name}: {'ok' if same else 'DIFFERS'} {len(got)}/{len(want)} rows, {time.time() - start:.1f}s", flush=True)
        if not same:
            print("   columns", have, want_cols)
            only = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
            print("   spark only", only[0], "\n   oracle only", only[1], flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
