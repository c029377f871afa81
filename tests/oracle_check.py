"""Run registered queries next to their check SQL and report differences.

``python tests/oracle_check.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences in columns, types and rows; empty when equal."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    rows = found.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} / {kinds[name]}")
    order = sorted(names)
    ours = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)
    if ours != theirs:
        only_ours = [r for r in ours if r not in set(theirs)]
        only_theirs = [r for r in theirs if r not in set(ours)]
        problems.append(
            f"rows {len(ours)} / {len(theirs)}; {order}; ours {only_ours[:2]}; sql {only_theirs[:2]}"
        )
    elif not ours:
        problems.append("no rows")
    return problems


def main() -> int:
    import __spark_entry__ as contract
    from cohortlens.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf_dir), contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problems = differences(df, con, sqls[name]) if name in sqls else []
            note = "" if name in sqls else f" rows only: {df.count()}"
        except Exception as error:
            problems, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s{note} {'; '.join(problems)[:1500]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
