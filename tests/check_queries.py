"""Run every registered query next to its SQL check: python tests/check_queries.py FOLDER [name ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from cohortloom.session import build_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in data)


def compare(spark, folder, name, build, sql, connection):
    start = time.time()
    df = build(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return f"rows {len(mine)}", took
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(names)}", took
    a, b = rows(df.columns, mine), rows(names, theirs)
    if a != b:
        return f"DIFFERS {len(mine)} {len(theirs)} only-spark {list((a - b).items())[:2]} only-sql {list((b - a).items())[:2]}", took
    return f"ok {len(mine)}", took


def main() -> None:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("check", 8)
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    sql = oracle_sql()
    for name, build in queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            verdict, took = compare(spark, folder, name, build, sql.get(name), connection)
        except Exception as error:  # noqa: BLE001
            verdict, took = f"ERROR {str(error)[:600]}", 0.0
        print(f"{took:6.1f}s {name}: {verdict}", flush=True)


if __name__ == "__main__":
    main()
