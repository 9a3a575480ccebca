"""Run registered queries and their SQL side by side: ``python -m tests.oracle [sf] [names...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

import __spark_entry__ as entry


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "item"):
        return _cell(value.item())
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    want = rows_of(names, res.fetchall())
    if got == want:
        return True, f"{len(got)} rows"
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} vs {len(want)} rows; {sorted(names)}; spark {only_got}; sql {only_want}"


def main() -> None:
    from ethersense.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    bad = []
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok ' if ok else 'BAD'} {name:26s} {time.time() - start:6.2f}s {note[:900]}", flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
