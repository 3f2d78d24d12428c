"""Run named queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def compare(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None if both sides agree, else a short description of the difference."""
    ours = build(spark, sf_dir)
    mine = ours.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(ours.columns):
        return f"columns {sorted(ours.columns)} against {sorted(names)}"
    order = sorted(names)
    left = Counter(tuple(_plain(row[c]) for c in order) for row in (r.asDict() for r in mine))
    at = [names.index(c) for c in order]
    right = Counter(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())
    if left == right:
        return None
    extra, missing = list((left - right).items())[:2], list((right - left).items())[:2]
    return f"{sum(left.values())} rows against {sum(right.values())}; only ours {extra}; only SQL {missing}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from turnwise.plans.catalog import ORACLES, QUERIES

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in wanted:
        began = time.time()
        try:
            if name in ORACLES:
                verdict = compare(session, con, QUERIES[name], ORACLES[name], folder) or "ok"
            else:
                verdict = f"rows {QUERIES[name](session, folder).count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {time.time() - began:6.1f}s  {verdict[:1500]}", flush=True)
