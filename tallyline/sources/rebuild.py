"""A table built from folders of files, brought up to date from the new and changed ones only.

A unit is a folder of files that were written together. The manifest lists, in versions, each unit's digest: of its files' sizes and contents.
A run hashes the units whose files have changed in name, size or time, reads the rows of those whose digest is new, and writes them
beside the others under (unit, digest). The new manifest version comes last, and readers see only the rows that it lists: a run that
breaks off, or runs twice, leaves the table as it was or as it should be, and a unit that is gone is gone from the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MANIFEST = "unit string, unit_key string, digest string, stamp string, version long"
NOT_WRITTEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
#: Units, one row each, that may be broadcast.
SMALL_UNITS = 100_000


@dataclass(frozen=True)
class Rebuilt:
    """What a run did: units seen, units hashed, units read, units that went, and the version that readers see."""

    units: int
    hashed: int
    read: int
    gone: int
    version: int


def unit_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in NOT_WRITTEN:
            return None
        raise


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version's units; none before the first run."""
    stored = _stored(spark, f"{table}/manifest")
    if stored is None:
        return spark.createDataFrame([], MANIFEST)
    return stored.where(F.col("version") == stored.agg(F.max("version")).first()[0])


def read_rebuilt(spark: SparkSession, table: str) -> DataFrame | None:
    """The table's rows, without those of older contents of a unit or of units that are gone; None before the first run."""
    rows = _stored(spark, f"{table}/rows")
    if rows is None:
        return None
    listed = manifest(spark, table).select("unit_key", "digest")
    small = listed.count() <= SMALL_UNITS
    return rows.join(F.broadcast(listed) if small else listed, ["unit_key", "digest"], "left_semi").drop("unit_key", "digest")


def rebuild_table(spark: SparkSession, folder: str, table: str, read: Callable[[SparkSession, list[str]], DataFrame], *, pattern: str = "*.parquet", full: bool = False) -> Rebuilt:
    """Bring ``table`` up to date with the units below ``folder``. ``read`` gives the rows of a list of unit folders, with ``_unit`` naming the folder.

    Contents are hashed where they lie, by Spark, and only for units whose stamp (names, sizes and times of files) differs from the manifest's; ``full``
    hashes and reads all. The driver gets the names of the units to read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    about = files.select(unit_of(F.col("path")).alias("unit"), F.struct("path", "length", F.unix_micros("modificationTime").alias("at")).alias("f"))
    stamps = about.groupBy("unit").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("f"))), 256).alias("stamp"))
    old = manifest(spark, table).persist()
    told = state = None
    try:
        version = 1 + (old.agg(F.max("version")).first()[0] or 0)
        told = stamps.join(old.select("unit", F.col("digest").alias("old_digest"), F.col("stamp").alias("old_stamp")), "unit", "full_outer").persist()
        gone = told.where("stamp IS NULL").count()
        touched = told.where("stamp IS NOT NULL" + ("" if full else " AND NOT stamp <=> old_stamp")).select("unit")
        names = [r["unit"] for r in touched.collect()]                                  # names of units with something new
        hashes = spark.createDataFrame([], "unit string, digest string")
        if names:
            contents = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(names)
            one = contents.select(unit_of(F.col("path")).alias("unit"), F.struct("length", F.sha2("content", 256).alias("sha")).alias("c"))
            hashes = one.groupBy("unit").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("c"))), 256).alias("digest"))
        state = told.where("stamp IS NOT NULL").join(hashes, "unit", "left").select(
            "unit", F.sha2("unit", 256).alias("unit_key"), F.coalesce("digest", "old_digest").alias("digest"), "stamp", "old_digest").persist()
        new = state.where(F.lit(full) | ~F.col("digest").eqNullSafe(F.col("old_digest")))
        fresh = [r["unit"] for r in new.select("unit").collect()]
        if fresh:
            keys = new.select(F.col("unit").alias("_unit"), "unit_key", "digest")
            keyed = read(spark, fresh).join(F.broadcast(keys) if len(fresh) <= SMALL_UNITS else keys, "_unit").drop("_unit")
            keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit_key", "digest").parquet(f"{table}/rows")
        units = state.count()
        if fresh or gone or names:
            state.select("unit", "unit_key", "digest", "stamp", F.lit(version).alias("version")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{table}/manifest")
        else:
            version -= 1
        return Rebuilt(units, len(names), len(fresh), gone, version)
    finally:
        for df in (old, told, state):
            if df is not None:
                df.unpersist()


def read_parquet_units(schema: str | None = None) -> Callable[[SparkSession, list[str]], DataFrame]:
    """A reader of Parquet units for ``rebuild_table``."""
    def read(spark: SparkSession, units: list[str]) -> DataFrame:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(*units).withColumn("_unit", unit_of(F.col("_metadata.file_path")))
    return read
