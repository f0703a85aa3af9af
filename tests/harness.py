"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(round(v, 9) + 0.0))
    if isinstance(v, (list, tuple)):
        return (2, str([norm(x) for x in v]))
    return (1, repr(float(v))) if isinstance(v, int) and not isinstance(v, bool) else (2, str(v))


def compare(df, con, sql: str):
    cols = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()])
    rel = con.sql(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return False, f"columns differ: spark only {set(cols) - set(names)}, sql only {set(names) - set(cols)}"
    idx = [names.index(c) for c in cols]
    want = sorted([tuple(norm(r[i]) for i in idx) for r in rel.fetchall()])
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "int": "INTEGER"}
    types = dict(zip(names, (str(t) for t in rel.types)))
    off = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]]
    if got == want and off:
        return False, f"types differ: {off}"
    if got == want:
        return True, f"{len(got)} rows"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    g, w = bad[0]
    diff = [(c, a[1], b[1]) for c, a, b in zip(cols, g, w) if a != b]
    return False, f"{len(bad)} of {len(got)} rows differ, first: {diff[:6]}"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("uwspark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="uwspark-tests-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    """python tests/harness.py <sf> [name-prefix ...]"""
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{argv[0]}"
    spark, con = session(), duck(sf)
    oracle = entry.oracle_sql()
    fails = []
    for name, fn in entry.queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                ok, msg = compare(df, con, oracle[name])
            else:
                ok, msg = True, f"{len(df.collect())} rows (no sql)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            fails.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:42s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failed:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
