"""DuckDB side of the query checks."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


class Oracle:
    def __init__(self, sf_dir: str) -> None:
        self.connection = duckdb.connect()
        for path in sorted(Path(sf_dir).glob("*.parquet")):
            self.connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def run(self, sql: str) -> pd.DataFrame:
        return self.connection.execute(sql).fetchdf()


def _plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    table = [tuple(_plain(value) for value in row) for row in frame[names].itertuples(index=False, name=None)]
    return sorted(table, key=lambda row: tuple((value is None, str(type(value)), value if value is not None else 0) for value in row))


def compare(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None, or what differs."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} <> {sorted(expected.columns)}"
    left, right = rows(actual), rows(expected)
    if left == right:
        return None
    only_left = [row for row in left if row not in set(right)][:3]
    only_right = [row for row in right if row not in set(left)][:3]
    return f"{len(left)} rows <> {len(right)} rows; only here {only_left}; only in SQL {only_right}"
