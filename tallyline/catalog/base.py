"""Registry of the queries that run the operators on the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Build = Callable[["Tables"], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    rows: str            # survey rows it exercises

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


CATALOG: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in CATALOG:
            raise KeyError(f"query {name!r} is registered twice")
        CATALOG[name] = Query(name, build, sql.strip() if sql else None, rows)
        return build
    return add


class Tables:
    """Lazy readers of one folder of tables, and the event-log roles they play."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def order_events(self) -> DataFrame:
        """One event per order: entity, period, day, score."""
        return self.orders.select("o_orderkey", F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("y"), F.to_date("o_orderdate").alias("d"),
                                  F.col("o_totalprice").alias("price"), "o_orderstatus", "o_orderpriority")

    @property
    def user_days(self) -> DataFrame:
        """One row per user and day: number of events and their value. Every window over users runs on this table."""
        days = self.events.groupBy(F.col("user_id"), F.to_date("ts").alias("d"))
        return days.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.count_if(F.col("event_type") == "error").alias("n_error"))


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, because the order of a floating-point sum is not fixed."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def text_day(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
