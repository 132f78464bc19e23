"""Registry of checked queries: each is a Spark plan and, where SQL can say it, the same thing in SQL.

Both sides are cut to the same columns: whole numbers as bigint, text as it is,
doubles at six decimals.  The rounding is the same arithmetic on both sides, a
hair off the half, so that decimal ties do not depend on the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as V

HALF = 0.50001
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Shape:
    ints: tuple[str, ...]
    text: tuple[str, ...]
    doubles: tuple[str, ...]


def _shape(spec: str) -> Shape:
    """"a b | c | d": bigint, text and double columns."""
    parts = [tuple(p.split()) for p in spec.split("|")]
    parts += [()] * (3 - len(parts))
    return Shape(*parts)


def _spark_select(df: DataFrame, s: Shape) -> DataFrame:
    return df.select(
        *[F.col(c).cast("long").alias(c) for c in s.ints], *[F.col(c).cast("string").alias(c) for c in s.text],
        *[(F.floor(F.col(c).cast("double") * F.lit(1e6) + F.lit(HALF)) / F.lit(1e6)).alias(c) for c in s.doubles])


def _sql_select(body: str, s: Shape, views: str) -> str:
    cols = [f"CAST({c} AS BIGINT) AS {c}" for c in s.ints] + [f"CAST({c} AS VARCHAR) AS {c}" for c in s.text]
    cols += [f"floor(CAST({c} AS DOUBLE) * 1e6 + {HALF}e0) / 1e6 + 0e0 AS {c}" for c in s.doubles]
    return f"{V.with_clause(views, body)}\nSELECT {', '.join(cols)} FROM answer"


def query(name: str, spec: str, views: str = "", sql: str | None = None):
    """Register a function of (Tables) -> DataFrame; ``views`` names the derived views its SQL uses."""
    shape = _shape(spec)

    def wrap(fn: Callable[[V.Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _spark_select(fn(V.Tables(spark, sf_dir)), shape)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _sql_select(sql, shape, views)
        return fn

    return wrap
