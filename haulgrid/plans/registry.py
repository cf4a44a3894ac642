"""Registry of queries and of the SQL that answers the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register a function under its name; ``rounded`` lists float columns that both sides
    round at the edge, for sums in another order differ in their last bits."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        columns = rounded.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(c, digits) for c in columns})

        QUERIES[f.__name__] = run
        if sql:
            fix = f" REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)})" if columns else ""
            ORACLE_SQL[f.__name__] = f"SELECT *{fix} FROM ({sql})"
        return f

    return add
