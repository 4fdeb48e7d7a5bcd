"""Compare registered queries with their SQL twins: ``python tests/oracle.py [sf] [name ...]``."""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normalize(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """Empty text if equal, else what differs."""
    cur = con.execute(sql)
    want_cols, want = normalize([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = normalize(df.columns, df.collect())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only ours {list(set(got) - set(want))[:3]}; only twin {list(set(want) - set(got))[:3]}"
    if len(got) == 0:
        return "no rows on either side"
    for g, w in zip(got, want):
        for c, a, b in zip(got_cols, g, w):
            if type(a) is not type(b) and a is not None and b is not None:
                return f"type of {c}: {a!r} vs {b!r}"
    if got != want:
        only, twin = set(got) - set(want), set(want) - set(got)
        return f"{len(only)} of {len(got)} rows differ: {sorted(only, key=repr)[:3]} twin {sorted(twin, key=repr)[:3]} on {got_cols}"
    return ""


def main():
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in entry.oracle_sql():
                message = compare(df, con, entry.oracle_sql()[name])
            else:
                message = f"(rows only: {len(df.collect())})"
        except Exception as e:  # noqa: BLE001
            message = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(message) and not message.startswith("(")
        print(f"{name:28s} {time.time() - start:6.1f}s {'ok' if not message else message}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
