"""Run queries and their SQL twins side by side: `python tests/compare.py [folder] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(value(v) for v in r) for r in zip(*cols)), key=lambda r: tuple((x is None, x or "") for x in r))


def check(spark, con, fn, sql: str | None, folder: str, need_rows: bool = True) -> tuple[bool, str]:
    got = fn(spark, folder).toArrow()
    if sql is None:
        return got.num_rows > 0, f"rows={got.num_rows} (no SQL)"
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return False, f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    types = [f"{n}:{got.schema.field(n).type}/{want.schema.field(n).type}" for n in got.column_names
             if str(got.schema.field(n).type).replace("large_", "").split("[")[0] != str(want.schema.field(n).type).split("[")[0]]
    a, b = rows(got), rows(want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [r for r in a if r not in in_b], [r for r in b if r not in in_a]
        return False, f"rows {len(a)}/{len(b)} spark-only {only_a[:3]} sql-only {only_b[:3]}"
    return got.num_rows > 0, f"rows={got.num_rows} {'types ' + str(types) if types else ''}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from bidweave.session import build_session
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    extra = {"spark.driver.extraJavaOptions": os.environ["COMPARE_JAVA"]} if "COMPARE_JAVA" in os.environ else {}
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                               "spark.driver.memory": "12g", **extra})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(folder), oracle_sql(), []
    for name, fn in queries().items():
        if len(args) > 1 and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args[1:]):
            continue
        start = time.time()
        try:
            ok, note = check(spark, con, fn, sqls.get(name), folder)
        except Exception as error:  # keep going, report at the end
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
