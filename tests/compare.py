"""Compare Spark rows with DuckDB rows, whatever their order."""

from collections import Counter
from pathlib import Path

import duckdb


def duckdb_rows(sf_dir, sql):
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    types = [str(column[1]) for column in cursor.description]
    return names, types, cursor.fetchall()


def bag(names, rows):
    place = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in place) for row in rows)


def assert_same(df, sf_dir, sql):
    names, types, expected = duckdb_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    got = bag(df.columns, [tuple(row) for row in df.collect()])
    want = bag(names, expected)
    assert got == want, f"only in Spark: {list((got - want).items())[:3]}; only in SQL: {list((want - got).items())[:3]}"
    return sum(got.values()), dict(df.dtypes), dict(zip(names, types))
