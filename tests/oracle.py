"""Rows of a query and of its SQL in DuckDB, as multisets that can be compared."""

from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: v.hex() if isinstance(v, (bytes, bytearray)) else v
    return Counter(tuple(str(plain(r[k])) for k in order) for r in rows)


def same(df, con, sql):
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    return _rows(df.collect(), df.columns) == _rows(got.fetchall(), columns)
