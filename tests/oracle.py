"""Compare a registered query with its SQL twin: column names, row count and values, order left out."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


SPENT: dict = {}


def plain(v):
    if v is None:
        return ("~",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, decimal.Decimal)):
        return ("n", float(v)) if not isinstance(v, int) else ("n", v)
    if isinstance(v, float):
        return ("n", "nan" if math.isnan(v) else v)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return ("l", tuple(plain(x) for x in v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return ("d", tuple((k, plain(x)) for k, x in sorted(v.items())))
    if isinstance(v, datetime.datetime):
        return ("t", v.isoformat())
    if isinstance(v, (bytes, bytearray)):
        return ("x", bytes(v).hex())
    return ("s", str(v))


def compare(spark, con, q, sf_dir):
    df = q.run(spark, sf_dir)
    cols = sorted(df.columns)
    t = time.time()
    arrow = df.toArrow()
    lists = [[plain(v) for v in arrow.column(c).to_pylist()] for c in cols]
    got = list(zip(*lists)) if lists else []
    SPENT["spark"] = time.time() - t
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in cols] if sorted(names) == cols else None
    if order is None:
        return f"columns differ: {cols} / {sorted(names)}"
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    key = repr
    got.sort(key=key)
    want.sort(key=key)
    if len(got) != len(want):
        g, w = set(map(repr, got)), set(map(repr, want))
        return f"rows {len(got)} / {len(want)}\n  only spark {sorted(g - w)[:2]}\n  only sql   {sorted(w - g)[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
        return f"{len(bad)} of {len(got)} rows differ, first: {str(diff)[:900]}\n   row {str(a)[:300]}"
    return None


def main(argv):
    from cuemill.catalog import load
    from cuemill.session import local_session

    sf = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf = a
        else:
            names.append(a)
    spark = local_session(os.environ.get("TEST_CPUS", "8"))
    con = connect(sf)
    bad = 0
    for name, q in load().items():
        if names and not any(name == n or q.run.__module__.endswith("." + n) for n in names):
            continue
        t = time.time()
        try:
            if q.sql is None:
                msg = None
                n = q.run(spark, sf).count()
                note = f"no sql, {n} rows"
            else:
                msg = compare(spark, con, q, sf)
                note = "same"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'BAD ' if msg else 'ok  '} {name} ({q.survey}) {time.time() - t:.1f}s spark {SPENT.get("spark", 0):.1f}s {msg or note}", flush=True)
        bad += bool(msg)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
