"""Run registered queries against their oracles: python -m tests.compare [sf] [name prefix...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0 if v else 0.0
    return v


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(sql)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if sorted(types) != sorted(duck_types):
        return f"columns {sorted(types)} vs {sorted(duck_types)}"
    names = sorted(types)
    wrong = {n: (types[n], duck_types[n]) for n in names if types[n] != duck_types[n]}
    ours = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    at = [rel.columns.index(n) for n in names]
    theirs = [tuple(_plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple((v is not None, str(type(v).__name__ in ("int", "float")), v if not isinstance(v, bool) else int(v)) for v in r)
    ours.sort(key=key)
    theirs.sort(key=key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ; columns {names}; first {bad[0]}; types {wrong}"
    if wrong:
        return f"types {wrong}"
    if not ours:
        return "EMPTY result"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from strandline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failures = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.perf_counter()
        try:
            if name in oracles:
                problem = difference(spark, con, fn, oracles[name], sf_dir)
            else:
                rows = fn(spark, sf_dir).count()
                problem = None if rows else "EMPTY result"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.perf_counter() - start
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {took:6.2f}s {name}{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    print("failures:", failures)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
