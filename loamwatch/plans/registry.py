"""The registered queries and their SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Registers a function of (spark, folder of tables) under a name, with the SQL of the same result.

    ``dates`` names date columns; both sides return them as text, which compares alike everywhere.
    """

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("string") for c in dates.split()})) if dates else f
        if sql:
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates.split())}) FROM ({sql})" if dates else sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that entry() runs."""
    return QUERIES["break_map"](spark, sf_dir)


def load() -> None:
    """Imports the modules that register queries."""
    from loamwatch.plans import aggregates, columns, detection, graphs, joins, reshapes, scans, validation, windows  # noqa: F401
