"""Run registered queries beside their SQL: ``python -m checks.compare <sf dir> [names]``."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np

from checks.registry import ORACLES, QUERIES
from slopeweave.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def same(spark_rows, sql_rows) -> str:
    """Empty when both frames hold the same rows, else what differs."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    columns = sorted(spark_rows.columns)
    a = spark_rows[columns].sort_values(columns).reset_index(drop=True)
    b = sql_rows[columns].sort_values(columns).reset_index(drop=True)
    for c in columns:
        x, y = a[c].to_numpy(), b[c].to_numpy()
        kinds = {x.dtype.kind, y.dtype.kind}
        if kinds == {"f"}:
            differs = ~((x == y) | (np.isnan(x) & np.isnan(y)))
        elif len(kinds) > 1 and not kinds <= {"i", "u"}:
            return f"type of {c}: {x.dtype} / {y.dtype}"
        else:
            differs = x != y
        if differs.any():
            i = int(np.flatnonzero(differs)[0])
            return f"{c}: {int(differs.sum())} differ, first {a.iloc[i].to_dict()} / {b.iloc[i].to_dict()}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wrong = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - started
            verdict = same(got, con.execute(ORACLES[name]).df()) if name in ORACLES else "no SQL"
        except Exception as error:  # report and go on with the next query
            con = connect(sf_dir)
            got, took, verdict = [], time.time() - started, f"{type(error).__name__}: {str(error)[:400]}"
        wrong += verdict not in ("", "no SQL")
        print(f"{name:24} {len(got):8} rows {took:6.1f} s  total {time.time() - started:6.1f} s  {verdict or 'same'}", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
