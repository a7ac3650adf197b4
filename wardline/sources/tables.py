"""Reading, appending, upserting and exporting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import new_folder
from wardline.sources import schemas


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A star table stored as Parquet, read with its declared schema."""
    return spark.read.schema(schemas.STAR[name]).parquet(f"{folder}/{name}")


def load_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int,
    **options: str,
) -> DataFrame:
    """A table of a database, read in parallel ranges of a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
            numPartitions=partitions, **options,
        )
        .load()
    )


def run_sql(spark: SparkSession, sql: str, args: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """A query with ``:name`` parameters; ``{name}`` stands for a DataFrame."""
    return spark.sql(sql, args=dict(args or {}), **frames)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    For a frame that is used several times: from a table no use repeats the joins and shuffles
    before it, also not when an executor is lost.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Adds rows in one committed job."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def latest_per_key(df: DataFrame, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """One row per key, the largest by ``latest``. Combines on the map side, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*latest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], latest: Sequence[str] = ()) -> DataFrame:
    """The target with rows of known keys replaced and rows of new keys added.

    With ``latest`` the last update of a key wins; without, the updates must hold a key once.
    Write the result to a new folder: a path cannot be overwritten while it is read.
    """
    if latest:
        updates = latest_per_key(updates, keys, latest)
    kept = target.join(updates.select(*keys), list(keys), "left_anti")
    return kept.unionByName(updates)


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in frames.items()]
    return reduce(DataFrame.unionByName, counts)


def table_profile(frames: Mapping[str, DataFrame]) -> DataFrame:
    profiles = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(n).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")
        )
        for n, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, profiles)


def table_bytes(spark: SparkSession, table: str) -> int | None:
    """Size of a managed table after ``ANALYZE TABLE``, from its description."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")
    row = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'").first()
    return int(row["data_type"].split()[0]) if row else None
