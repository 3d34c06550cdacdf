"""Run registered queries beside their independent SQL and compare columns, types and rows.

Usage: python -m checks.compare FOLDER [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time

TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz", "DATE": "date"}
RAW = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
       "conversations").split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in RAW:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(rows, order) -> list[tuple]:
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def differences(df, connection, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL text; empty when nothing does."""
    shape = [(row[0], str(row[1])) for row in connection.execute(f"DESCRIBE {sql}").fetchall()]
    expected = {name: TYPES.get(kind, kind) for name, kind in shape}
    actual = dict(df.dtypes)
    found = []
    if expected != actual:
        only = {k: (actual.get(k), expected.get(k)) for k in {*actual, *expected} if actual.get(k) != expected.get(k)}
        found.append(f"schema (spark, sql): {only}")
        if set(expected) != set(actual):
            return found
    names = sorted(actual)
    mine = _rows(df.collect(), [df.columns.index(n) for n in names])
    theirs = _rows(connection.execute(sql).fetchall(), [[s[0] for s in shape].index(n) for n in names])
    if len(mine) != len(theirs):
        found.append(f"rows: spark {len(mine)}, sql {len(theirs)}")
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        found.append(f"values {names}: only spark {sorted(a - b)[:3]}, only sql {sorted(b - a)[:3]}")
    return found


def main() -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from kerbline.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(folder), 0
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problems = differences(df, connection, ORACLE[name]) if name in ORACLE else [f"no SQL, {df.count()} rows"]
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - begin:.1f}s {' | '.join(problems)}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
