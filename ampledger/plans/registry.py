"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double, so that summation order does not show."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r6(body: str, doubles: str, digits: int = DIGITS) -> str:
    """The SQL counterpart of :func:`rounded` for the named columns of ``body``."""
    replaced = ", ".join(
        f"CASE WHEN round({c}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({c}::DOUBLE, {digits}) END AS {c}"
        for c in doubles.split()
    )
    return f"SELECT * REPLACE ({replaced}) FROM ({body})"


def query(name: str, sql: str | None = None):
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, lambda spark, sf: rounded(build(Tables(spark, sf))), sql)
        return build

    return register


from ampledger.plans.tables import Tables  # noqa: E402  (needs no registry itself)
