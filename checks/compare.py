"""Run registered queries and their SQL counterparts side by side and compare the rows.

    python -m checks.compare [table folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, name: str, query, sql: str | None, sf_dir: str) -> str:
    """'' if both sides agree, else a description of the difference."""
    frame = query(spark, sf_dir)
    left = _rows(frame.columns, frame.collect())
    if sql is None:
        return ""
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = _rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if left != right:
        return (f"rows {sum(left.values())} against {sum(right.values())}; only Spark "
                f"{list((left - right).items())[:3]}; only SQL {list((right - left).items())[:3]}")
    return ""


def main() -> None:
    from siftguard.session import build_session

    from .oracles import ORACLES
    from .registry import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                               "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        note = problem or ("same" if name in ORACLES else "runs, no SQL")
        print(f"{name}: {note} ({time.time() - start:.1f} s)", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")


if __name__ == "__main__":
    main()
