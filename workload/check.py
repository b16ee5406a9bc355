"""Run registered queries and their SQL side by side and compare the rows.

    python -m workload.check [sf folder] [query ...]
"""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def session(cores: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(_cell(r[i]) for i in order) for r in rows))


def compare(df, db, sql) -> str:
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{len(mine[1])} rows, no SQL"
    found = db.execute(sql)
    theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if mine[0] != theirs[0]:
        return f"FAIL columns {sorted(set(mine[0]) ^ set(theirs[0]))}"
    if mine[1] == theirs[1]:
        return f"ok {len(mine[1])} rows"
    if len(mine[1]) != len(theirs[1]):
        extra = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return (f"FAIL rows {len(mine[1])} {len(theirs[1])} "
                f"{[sorted(e)[:1] for e in extra]}")
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(mine[0], a, b) if x != y]
            return f"FAIL values {a[-2:]} {diff[:6]}"
    return "FAIL"


def main(argv) -> int:
    from workload.duckdb_sql import ORACLES
    from workload.spark_queries import QUERIES
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, db, bad = session(), database(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        began = time.time()
        try:
            verdict = compare(QUERIES[name](spark, folder), db, ORACLES.get(name))
        except Exception as reason:  # noqa: BLE001 - reported, counted
            verdict = f"FAIL {type(reason).__name__}: {str(reason)[:600]}"
        bad += verdict.startswith("FAIL")
        print(f"{name:26} {time.time() - began:6.1f}s  {verdict}", flush=True)
    print(f"{bad} failed of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
