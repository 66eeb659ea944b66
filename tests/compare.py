"""Run registered queries next to their SQL and compare rows, schema names and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}".replace("-0.000000", "0.000000")
    return repr(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str | None:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in rel.description}
    odd = [(n, k, kinds[n]) for n, k in df.dtypes if KINDS.get(k, k) != kinds[n]]
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}; only here {[g for g in got if g not in want][:2]}; only SQL {[w for w in want if w not in got][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, ".")
    from conftest import session

    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = difference(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only)'} {(problem or '')[:1800]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
