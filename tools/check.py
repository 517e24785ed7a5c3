"""Run registered queries next to their DuckDB SQL and compare the rows.

    python tools/check.py [scale folder] [name or prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rowsmith.plans import Tables, registered  # noqa: E402
from rowsmith.plans.registry import TABLES  # noqa: E402
from rowsmith.session import build_session  # noqa: E402


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅" if value is None else "nan"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, decimal.Decimal):
        return f"d:{value.normalize():f}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return f"f:{value!r}"
    if isinstance(value, (bytes, bytearray)):
        return f"x:{bytes(value).hex()}"
    if isinstance(value, dt.datetime):
        return f"t:{value.replace(tzinfo=None).isoformat()}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return f"s:{value}"


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failed = []
    for name, query in registered().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = query.run(Tables(spark, sf_dir))
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if query.oracle is None:
                print(f"rows  {name}: {len(rows)} rows, {took:.2f}s", flush=True)
                continue
            cursor = duck.execute(query.oracle)
            names = [d[0] for d in cursor.description]
            expected = cursor.fetchall()
            if sorted(names) != sorted(df.columns):
                raise AssertionError(f"columns {sorted(df.columns)} != {sorted(names)}")
            mine, theirs = canonical_rows(df.columns, rows), canonical_rows(names, expected)
            if mine != theirs:
                only = [r for r in mine if r not in set(theirs)][:2]
                other = [r for r in theirs if r not in set(mine)][:2]
                raise AssertionError(f"{len(mine)} vs {len(theirs)} rows; {only} != {other}")
            print(f"ok    {name}: {len(rows)} rows, {took:.2f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL  {name}: {str(error)[:600]}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
