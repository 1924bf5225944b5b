"""Compare registered queries with their SQL: ``python tests/oracle_check.py <sf_dir> [query ...]``."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DUCK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(df, relation):
    """Problems found between a Spark result and a DuckDB relation; empty when they agree."""
    spark_schema = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), "?") for f in df.schema.fields}
    duck_schema = dict(zip(relation.columns, [str(t) for t in relation.types]))
    if spark_schema != duck_schema:
        return [f"schema: spark {spark_schema} sql {duck_schema}"]
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(relation.columns, relation.fetchall())
    if ours == theirs:
        return []
    missing = [r for r in theirs if r not in set(ours)][:2]
    extra = [r for r in ours if r not in set(theirs)][:2]
    return [f"rows: spark {len(ours)} sql {len(theirs)}; missing {missing}; extra {extra}"]


def main():
    from __spark_entry__ import oracle_sql, queries
    from riffle.plans.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problems = compare(fn(spark, sf_dir), con.sql(sql[name]))
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s {' '.join(problems)[:900]}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
