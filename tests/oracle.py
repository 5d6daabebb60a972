"""Compare a query with its SQL in DuckDB over the same Parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def same(value) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(same(v) for v in value)
    return value


def check(frame, sql: str, sf_dir: str) -> None:
    names, rows = expected(sql, sf_dir)
    assert sorted(frame.columns) == sorted(names)
    order = sorted(names)
    got = sorted(([same(r[c]) for c in order] for r in frame.collect()), key=repr)
    want = sorted(([same(r[names.index(c)]) for c in order] for r in rows), key=repr)
    assert len(got) == len(want)
    if got != want:
        # rounding may fall to either side of a tie: compare numbers with a tolerance, in the order of the other columns
        fixed = [i for i in range(len(order)) if not any(isinstance(r[i], float) for r in (*got, *want))]
        key = lambda r: (repr([r[i] for i in fixed]), [v for v in r if isinstance(v, float)])
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5)), (a, b)
