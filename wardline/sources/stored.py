"""Facts stored by month, and a pointer that readers follow from one finished version to the next."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MONTH = "_month"


def month_number(col: str) -> Column:
    """Year and month as one number, 200103; 0 for a row without a time, so that it is stored, too."""
    return F.coalesce(F.year(col) * 100 + F.month(col), F.lit(0))


class StoredFact:
    """A fact below a folder, one partition per month of a time column, sorted by a key within its files.

    A load adds files to the months it has rows for. ``read`` with bounds names the months, so a scan
    opens those only, and repeats the bounds, which the files' statistics see.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, time: str, key: str):
        self.spark, self.folder, self.time, self.key = spark, folder, time, key
        self.schema = StructType([*schema.fields, StructField(MONTH, IntegerType())])
        self.columns = schema.fieldNames()

    def load(self, rows: DataFrame) -> None:
        placed = rows.select(*self.columns, month_number(self.time).alias(MONTH))
        dealt = placed.repartition(MONTH, F.pmod(F.xxhash64(self.key), F.lit(8))).sortWithinPartitions(MONTH, self.key)
        dealt.write.mode("append").partitionBy(MONTH).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._all().select(*self.columns)

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.folder)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def period(self, low: str, high: str) -> DataFrame:
        """Rows from ``low`` up to, not including, ``high``; both are literals."""
        first, last = (int(x[:4]) * 100 + int(x[5:7]) for x in (low, high))
        at = F.col(self.time)
        inside = (at >= F.lit(low).cast("timestamp_ntz")) & (at < F.lit(high).cast("timestamp_ntz"))
        return self._all().where(F.col(MONTH).between(first, last) & inside).select(*self.columns)

    def days(self, days: Iterable[date]) -> DataFrame:
        """Rows of some days, read from the months these lie in."""
        wanted = sorted(set(days))
        months = sorted({d.year * 100 + d.month for d in wanted})
        if not wanted:
            return self.read().limit(0)
        return self._all().where(F.col(MONTH).isin(months) & F.col(self.time).cast("date").isin(wanted)).select(*self.columns)


class Pointer:
    """Which stored tables make up the current version of a set of tables.

    A version is one row in a file of its own, written when all its tables are; readers take the newest.
    Tables are never overwritten, so a reader keeps what it has opened.
    """

    SCHEMA = "number long, tables map<string, array<string>>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder}/versions"

    def newest(self) -> tuple[int, dict[str, list[str]]]:
        try:
            row = self.spark.read.schema(self.SCHEMA).parquet(self.folder).orderBy(F.desc("number")).first()
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return (row.number, dict(row.tables)) if row else (-1, {})

    def swap(self, number: int, tables: Mapping[str, list[str]]) -> None:
        row = self.spark.createDataFrame([(number, dict(tables))], self.SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/version={number}")
