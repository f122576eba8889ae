"""Parquet tables of the registry: read with an explicit schema, write after validation, replace by partition."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.sources.contracts import TABLES, TableSpec, conform, validate


def table_path(base: str, name: str) -> str:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {sorted(TABLES)}")
    return f"{base.rstrip('/')}/{name}.parquet"


def table_exists(spark: SparkSession, base: str, name: str) -> bool:
    try:
        spark.read.parquet(table_path(base, name)).schema
        return True
    except AnalysisException:
        return False


def read_table(spark: SparkSession, base: str, name: str, *, check: bool = False) -> DataFrame:
    df = spark.read.schema(TABLES[name].schema).parquet(table_path(base, name))
    return validate(df, TABLES[name]) if check else df


def load_tables(spark: SparkSession, base: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, base, n) for n in names}


def write_table(df: DataFrame, base: str, name: str, *, check: bool = True) -> None:
    """Validated write. Partitioned tables replace only the partitions present in ``df`` (dynamic overwrite)."""
    spec = TABLES[name]
    typed = conform(df, spec)
    if check:
        validate(typed, spec)
    writer = typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if spec.partition:
        # one shuffle by partition value plus a salt, so a partition holding a third of all rows is written by several tasks
        salted = typed.withColumn("_salt", F.pmod(F.xxhash64(*(spec.key or list(spec.columns))), F.lit(32)))
        writer = (salted.repartition(spec.partition, "_salt").drop("_salt").write.mode("overwrite")
                  .option("partitionOverwriteMode", "dynamic").partitionBy(spec.partition))
    writer.parquet(table_path(base, name))


def write_snapshot(day: DataFrame, base: str, name: str) -> None:
    """Append one dated snapshot; writing the same day again replaces that day only."""
    write_table(day, base, name)


def connect(spark: SparkSession, base: str, names: Iterable[str] | None = None) -> list[str]:
    """Register a temporary view per table that exists; returns the names registered."""
    out = []
    for name in names or TABLES:
        if table_exists(spark, base, name):
            read_table(spark, base, name).createOrReplaceTempView(name)
            out.append(name)
    return out


def available_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def available_periods(df: DataFrame, column: str = "season") -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def query(spark: SparkSession, sql: str, params: Mapping[str, object] | list | None = None) -> DataFrame:
    """Parameterised SQL over the registered views."""
    return spark.sql(sql, args=params)


def append_run(spark: SparkSession, path: str, row: Mapping[str, object]) -> None:
    """Append one run record as a JSON line."""
    spark.createDataFrame([dict(row)]).coalesce(1).write.mode("append").json(path)


def describe_spec(spec: TableSpec) -> str:
    return f"{spec.name}({', '.join(spec.columns)}) key {spec.key}"
