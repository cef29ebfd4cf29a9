"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    return str(v)


def rows(table) -> list[tuple[str, ...]]:
    names = sorted(table.column_names)
    return sorted(tuple(map(canonical, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True))


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found, expected = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(found.column_names) == sorted(expected.column_names)
    a, b = rows(found), rows(expected)
    assert a == b, [x for x in zip(a, b, strict=False) if x[0] != x[1]][:3]
