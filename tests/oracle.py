"""Run registered queries next to their SQL and compare the rows.

``python tests/oracle.py [--sf 0.01] [name ...]`` prints one line per query.
"""

import os
import sys
import tempfile
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lorebase.plans import REGISTRY  # noqa: E402
from lorebase.sources.derived import RAW_TABLES  # noqa: E402

TESTDATA = "/root/testdata"


def make_spark(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lorebase-test-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, float) and v != v:
        return "nan"
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str):
    """(rows, seconds, problem or None)"""
    q = REGISTRY[name]
    start = time.time()
    df = q.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if q.sql is None:
        return len(rows), seconds, None
    result = con.execute(q.sql)
    columns = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(rows), seconds, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = canonical(df.columns, rows), canonical(columns, wanted)
    if len(a) != len(b):
        return len(rows), seconds, f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return len(rows), seconds, f"row {x!r:.500} != {y!r:.500}"
    return len(rows), seconds, None


def main(argv):
    sf = "0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark, con = make_spark(), connect(sf_dir)
    bad = 0
    for name in argv or list(REGISTRY):
        try:
            n, seconds, problem = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            n, seconds, problem = -1, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        kind = "rows-only" if REGISTRY[name].sql is None else "sql"
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{kind}] rows={n} {seconds:.2f}s {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
