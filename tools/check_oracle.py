"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from postlytics.plans.registry import load_all  # noqa: E402
from postlytics.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in records:
        out.append(tuple(norm(r[i]) for i in order))
    return sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and os.path.isdir(sys.argv[1]) else "/root/testdata/sf0.01"
    prefixes = [a for a in sys.argv[1:] if not os.path.isdir(a)]
    if os.environ.get("PLAIN_SESSION"):
        # a session as a caller might build it: no tuning, default time zone
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs = load_all()
    bad = 0
    for name, q in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(dcols)}")
            bad += 1
            continue
        a, b = rows_of(cols, srows), rows_of(dcols, drows)
        if a != b:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; only spark {list(sa - sb)[:2]}; "
                  f"only duckdb {list(sb - sa)[:2]}")
        else:
            print(f"ok   {name}: {len(a)} rows ({ts:.1f}s)")
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
