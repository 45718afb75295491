"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import SETTINGS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_WIDEN = {T.IntegerType(): "long", T.ShortType(): "long", T.ByteType(): "long", T.FloatType(): "double"}


def _plain_types(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE, as the SQL side returns them."""
    return df.select(
        *[F.col(f"`{f.name}`").cast(_WIDEN[f.dataType]).alias(f.name) if f.dataType in _WIDEN else F.col(f"`{f.name}`")
          for f in df.schema.fields]
    )


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL counterpart."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])
            return _plain_types(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
