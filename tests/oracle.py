"""Compares a query's rows with those that DuckDB gives for its SQL, columns in order of their names."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, sql, con):
    """None if they agree, else a message."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want, got = rows_of(names, result.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]}, wanted {want[0]}"
    if want[1] != got[1]:
        a, b = set(want[1]), set(got[1])
        return f"{len(got[1])} rows, wanted {len(want[1])}; missing {sorted(a - b, key=repr)[:2]}, extra {sorted(b - a, key=repr)[:2]}"
    return None
