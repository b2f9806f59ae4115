"""Compares a query with its DuckDB SQL on one data directory."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, names, digits):
    def cell(x):
        if isinstance(x, float):
            return round(x, digits)
        return tuple(map(cell, x)) if isinstance(x, (list, tuple)) else x

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(cell(row[k]) for k in order) for row in found), key=repr)


def compare(spark, query, sql, sf_dir, digits=6):
    """Asserts equal column names and rows; returns the row count."""
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = query(spark, sf_dir)
    result = con.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    mine, theirs = rows(df.collect(), df.columns, digits), rows(result.fetchall(), result.columns, digits)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not bad, bad[:3]
    return len(mine)
