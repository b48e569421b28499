"""Runs registered queries in Spark and their SQL in DuckDB and compares results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _key(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    return (1, repr(value))


def rows(table) -> tuple[list[str], list[str], list[tuple]]:
    """Column names sorted, their types, and the rows in a fixed order."""
    names = sorted(table.column_names)
    table = table.select(names)
    types = [str(t).replace("large_string", "string") for t in table.schema.types]
    values = list(zip(*[table.column(n).to_pylist() for n in names])) if names else []
    return names, types, sorted(values, key=lambda r: [_key(v) for v in r])


def differences(spark_table, duck_table) -> str | None:
    names, types, left = rows(spark_table)
    other_names, other_types, right = rows(duck_table)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if types != other_types:
        return f"types {list(zip(names, types, other_types))}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else None


def compare(spark, con, folder: str, name: str) -> str | None:
    from __spark_entry__ import oracle_sql, queries

    return differences(
        queries()[name](spark, folder).toArrow(), con.sql(oracle_sql()[name]).to_arrow_table()
    )


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from cashweave.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(oracle_sql())
    spark, con = local_session(8), connect(folder)
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
