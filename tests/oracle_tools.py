"""Run catalog queries next to their SQL twins in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def norm(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf, name, fn, sql):
    """'' when equal, else what differs."""
    df = fn(spark, sf)
    mine_cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine_cols != cols:
        return f"columns {mine_cols} != {cols}", len(mine)
    if len(mine) != len(theirs):
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return (f"rows {len(mine)} != {len(theirs)}\n  only spark {sorted(a - b)[:3]}\n"
                f"  only sql   {sorted(b - a)[:3]}"), len(mine)
    for i, c in enumerate(cols):
        ka = {kind(r[i]) for r in mine if r[i] is not None}
        kb = {kind(r[i]) for r in theirs if r[i] is not None}
        if ka != kb:
            return f"type of {c}: {ka} != {kb}", len(mine)
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return (f"{len(a - b)} values differ ({cols})\n  only spark {sorted(a - b)[:4]}\n"
                f"  only sql   {sorted(b - a)[:4]}"), len(mine)
    return "", len(mine)


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tidemark.plans.staging import drop_staged
    from tidemark.session import local_session

    sf = "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf = f"/root/testdata/sf{a[5:]}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff, n = compare(spark, con, sf, name, fn, oracles[name])
            else:
                diff, n = "", fn(spark, sf).count()
        except Exception as e:  # noqa: BLE001
            diff, n = "".join(traceback.format_exception_only(e))[:1500], -1
        tag = "ok " if not diff else "BAD"
        print(f"{tag} {name:34s} rows={n:<7d} {time.time() - t:5.1f}s {'' if name in oracles else '(rows only)'}", flush=True)
        if diff:
            print("   ", diff, flush=True)
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    drop_staged(spark)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
