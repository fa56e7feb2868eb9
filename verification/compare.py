"""Run registered queries in Spark and DuckDB and compare the rows.

Usage: python -m verification.compare <sf_dir> [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from echofold.session import local_session
from verification.oracle import SQL, complete
from verification.queries import REGISTRY


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, values as text, sorted."""
    frame = frame[sorted(frame.columns)]
    columns = []
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_float_dtype(column) and not (column.dropna() % 1 == 0).all():
            columns.append([f"{v:.9f}" for v in column])
        elif pd.api.types.is_datetime64_any_dtype(column):
            columns.append([str(pd.Timestamp(v)) for v in column])
        else:
            columns.append(["" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in column])
    return sorted(zip(*columns, strict=True))


def difference(spark, connection, sf_dir: str, name: str) -> str:
    """Empty when both engines agree, else what differs."""
    ours = REGISTRY[name](spark, sf_dir).toPandas()
    if name not in SQL:
        return "" if len(ours) else "no rows"
    theirs = connection.execute(complete(SQL[name])).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    left, right = canonical(ours), canonical(theirs)
    if left == right:
        return "" if left else "no rows"
    extra, missing = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    return f"rows {len(left)} and {len(right)}; only ours {extra[:2]}; only theirs {missing[:2]}"


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session("compare")
    connection = connect(sf_dir)
    failures = 0
    for name in names or list(REGISTRY):
        start = time.time()
        try:
            found = difference(spark, connection, sf_dir, name)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {time.time() - start:6.2f}s {name} {found}", flush=True)
    print(f"{failures} failures", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
