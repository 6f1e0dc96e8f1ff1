"""Run registered queries against their oracle SQL."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, bool) or x is None:
        return str(x)
    if hasattr(x, "as_tuple"):
        return f"{float(x):.9g}"
    if isinstance(x, int):
        return str(x)
    return str(x)


def normal(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def check(spark, con, name: str, build, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    began = time.time()
    df = build(spark, sf_dir)
    mine = normal(df.columns, df.collect())
    if len(mine) and "-t" in sys.argv:
        print(f"  spark {time.time() - began:.2f}s")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = normal(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    if mine != theirs:
        only_mine = sorted(set(mine) - set(theirs))[:3]
        only_theirs = sorted(set(theirs) - set(mine))[:3]
        return f"rows {len(mine)} <> {len(theirs)}; {only_mine} | {only_theirs}"
    types = [str(d[1]) for d in cursor.description]
    plain = {"bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    kinds = dict(zip(names, types))
    off = [(c, k, kinds[c]) for c, k in df.dtypes if plain.get(k, k) != kinds[c]]
    if off:
        print(f"  note {name}: types {off}")
    return None if mine else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    built, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in built:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name in oracles:
                problem = check(spark, con, name, built[name], oracles[name], sf_dir)
            else:
                problem = None if built[name](spark, sf_dir).count() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {time.time() - began:6.2f}s {'' if name in oracles else '(rows) '}{name} {problem or ''}", flush=True)
    print("bad:", bad)
