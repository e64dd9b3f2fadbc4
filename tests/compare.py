"""Runs registered queries and their SQL side by side: python tests/compare.py [sf_dir] [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return connection


def plain_value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(plain_value(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(made, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(spark, connection, sf, name, queries, oracles):
    """None when both give the same rows, else what differs."""
    df = queries[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(oracles[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "FLOAT": "float"}
    types = {d[0]: kinds.get(str(d[1]), str(d[1])) for d in cursor.description}
    if got[0] == expected[0] and types != dict(df.dtypes):
        return f"types {sorted(set(dict(df.dtypes).items()) ^ set(types.items()))}"
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return f"{len(got[1])} rows != {len(expected[1])}; only here {list(set(got[1]) - set(expected[1]))[:2]}, only there {list(set(expected[1]) - set(got[1]))[:2]}"
    wrong = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    return f"{len(wrong)} of {len(got[1])} rows differ, e.g. {wrong[0]}" if wrong else None if got[1] else "no rows"


def main(sf="/root/testdata/sf0.01", *names):
    from __spark_entry__ import oracle_sql, queries
    from pagemill.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                          "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(sf), 0
    for name in names or queries():
        started = time.time()
        try:
            problem = difference(spark, connection, sf, name, queries(), oracle_sql())
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - started:6.1f}s {name} {problem or ''}"[:1500], flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
