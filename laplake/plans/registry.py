"""Named queries over a data folder, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laplake.plans.fixtures import RaceData
from laplake.plans.oracle import statement

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``RaceData`` under ``name``."""

    def register(function: Callable[[RaceData], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(RaceData(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = statement(sql)
        return function

    return register
