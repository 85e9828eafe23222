"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of a Domain under its name, with the SQL that gives the same rows."""

    def wrap(f: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Domain(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap
