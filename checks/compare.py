"""Side-by-side check of registered queries against their SQL statements."""

import datetime as dt
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(norm(r[i])) for i in order) for r in data)


def run(spark, sf_dir, queries, oracles, names=None):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            cols = df.columns
            got = [tuple(r) for r in df.collect()]
        except Exception as err:  # report and go on with the other queries
            bad.append(name)
            print(f"FAIL {name}: {str(err)[:600]}", flush=True)
            continue
        took = time.time() - t0
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            t0 = time.time()
            cur = con.execute(oracles[name])
            ocols = [d[0] for d in cur.description]
            want = cur.fetchall()
            otook = time.time() - t0
        except Exception as err:
            bad.append(name)
            print(f"ORACLE FAIL {name}: {str(err)[:600]}", flush=True)
            continue
        if sorted(cols) != sorted(ocols):
            bad.append(name)
            print(f"COLUMNS {name}: spark-only {sorted(set(cols) - set(ocols))} sql-only {sorted(set(ocols) - set(cols))}",
                  flush=True)
            continue
        a, b = rows_of(cols, got), rows_of(ocols, want)
        if a != b:
            bad.append(name)
            miss = [x for x in a if x not in set(b)][:2]
            extra = [x for x in b if x not in set(a)][:2]
            print(f"DIFF {name}: {len(a)} vs {len(b)} rows; columns {sorted(cols)}\n   spark {miss}\n   sql   {extra}", flush=True)
        else:
            print(f"ok   {name}: {len(a)} rows {took:.1f}s sql {otook:.1f}s", flush=True)
    return bad


def session(cpus="8", parts="8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", parts)
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pick(names, words):
    """All names, those containing a word, or with ``@module`` those a checks module registers."""
    import importlib
    chosen = []
    for w in words:
        mod = importlib.import_module(f"checks.{w[1:]}").ENTRIES if w.startswith("@") else None
        chosen += [n for n in names if (n in mod if mod is not None else w in n) and n not in chosen]
    return chosen if words else list(names)


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from checks.registry import oracle_sql, queries
    spark = session()
    picked = pick(queries(), sys.argv[2:])
    failed = run(spark, f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}", queries(), oracle_sql(), picked)
    print("failed:", failed)
    spark.stop()
