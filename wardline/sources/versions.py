"""A stored Type-2 dimension whose history is not rewritten by a merge.

Below its folder, rows lie in ``data/commit=N/kind=current|closed/bucket=B``, B a hash of the key. A
merge reads the current rows of the buckets that its changes touch, and writes these buckets' current
rows and the versions it closes; all other files stay. The closed rows of a bucket are read and written
again only if a change came late for it, or if they lie in COMPACT_FROM pieces.

Which pieces make up the table stands in ``commits``, one file of one row per commit, written last: a
reader takes the newest one and never sees half a merge. A commit carries the id of its batch, so a
batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from wardline.operators.history import conflicting, late_changes, scd2_merge, splice_late, unusable_changes
from wardline.sources.tables import materialize

BUCKETS = 64
COMPACT_FROM = 16
CURRENT, CLOSED = "current", "closed"
COMMIT = "commit long, batch long, top long, buckets int, pieces array<struct<kind:string,bucket:int,commit:long>>"

Piece = tuple[str, int, int]


class VersionStore:
    def __init__(
        self, spark: SparkSession, folder: str, key: str, tracked: Sequence[str], schema: StructType,
        surrogate: str = "patient_key", eff: str = "effective_at", buckets: int = BUCKETS,
    ):
        self.spark, self.folder, self.key, self.tracked = spark, folder, key, list(tracked)
        self.schema, self.surrogate, self.eff, self.buckets = schema, surrogate, eff, buckets

    # -- reading --

    def newest(self) -> tuple[int, int, int, list[Piece]] | None:
        """Commit, batch, largest surrogate key and pieces of the newest commit, whose number of buckets holds."""
        try:
            commits = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = commits.orderBy(F.desc("commit")).limit(1).collect()
        if not row:
            return None
        self.buckets = row[0].buckets
        return row[0].commit, row[0].batch, row[0].top, [tuple(p) for p in row[0].pieces]

    def _rows(self, pieces: Iterable[Piece]) -> DataFrame:
        paths = [f"{self.folder}/data/commit={c}/kind={k}/bucket={b}" for k, b, c in pieces]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, kind: str | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table, one of its halves, or only the buckets that hold some keys."""
        found = self.newest()
        pieces = found[3] if found else []
        wanted = None if keys is None else self._buckets(keys)
        return self._rows(p for p in pieces if kind in (None, p[0]) and (wanted is None or p[1] in wanted))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _buckets(self, rows: DataFrame) -> set[int]:
        """Buckets of rows; at most ``buckets`` numbers reach the driver."""
        return {r[0] for r in rows.select(self._bucket().alias("bucket")).distinct().collect()}

    # -- writing --

    def _commit(self, rows: DataFrame, number: int, batch: int, top: int, kept: list[Piece]) -> None:
        path = f"{self.folder}/data/commit={number}"
        kind = F.when(F.col("is_current"), CURRENT).otherwise(CLOSED)
        placed = rows.select(*self.schema.fieldNames(), kind.alias("kind"), self._bucket().alias("bucket"))
        placed.repartition("kind", "bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(path)
        schema = StructType([*self.schema.fields, StructField("kind", StringType()), StructField("bucket", IntegerType())])
        written = self.spark.read.schema(schema).parquet(path)
        found = written.groupBy("kind", "bucket").agg(F.max(self.surrogate).alias("top")).collect()
        pieces = kept + sorted((r.kind, r.bucket, number) for r in found)
        row = (number, batch, max([top, *(r.top for r in found)]), self.buckets, pieces)
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/number={number}")

    def create(self, dim: DataFrame, batch: int = -1) -> None:
        """The first commit, unless there is one."""
        if self.newest() is None:
            self._commit(dim, 0, batch, 0, [])

    def merge(self, source: DataFrame, batch: int, splice: bool = True) -> bool:
        """Applies a batch of changes; False if its id has been applied before.

        Late changes are spliced into the closed history, or set aside without ``splice``. What is not
        applied goes to ``set_aside/batch=N`` with the reason.
        """
        commit, applied, top, pieces = self.newest()
        if batch <= applied:
            return False
        source = materialize(source, "store-batch")
        bad = unusable_changes(source, self.key, self.eff)
        usable = source.where(F.col(self.key).isNotNull() & F.col(self.eff).isNotNull())
        touched = self._buckets(usable)
        current = self._rows(p for p in pieces if p[0] == CURRENT and p[1] in touched)
        late = materialize(late_changes(current, usable, self.key, self.eff), "store-late")
        held: dict[int, int] = {}
        for kind, bucket, _ in pieces:
            held[bucket] = held.get(bucket, 0) + (kind == CLOSED)
        again = {b for b in touched if held.get(b, 0) >= COMPACT_FROM} | (self._buckets(late) if splice else set())
        base = current.unionByName(self._rows(p for p in pieces if p[0] == CLOSED and p[1] in again))
        if splice:
            aside = bad.unionByName(conflicting(base, late, self.key, self.tracked, self.eff))
            base = materialize(splice_late(base, late, self.key, self.tracked, self.surrogate, self.eff, top=F.lit(top)), "store-spliced")
        else:
            aside = bad.unionByName(late.withColumn("reason", F.lit("late")))
        aside.write.mode("overwrite").parquet(f"{self.folder}/set_aside/batch={batch}")
        highest = base.agg(F.greatest(F.lit(top), F.coalesce(F.max(self.surrogate), F.lit(0)))).scalar()
        merged = scd2_merge(base, usable, self.key, self.tracked, self.surrogate, self.eff, top=highest)
        kept = [p for p in pieces if p[1] not in (touched if p[0] == CURRENT else again)]
        self._commit(merged, commit + 1, batch, top, kept)
        return True

    def set_aside(self, schema: StructType) -> DataFrame:
        """All changes that merges have not applied so far, with the batch and the reason."""
        wanted = StructType([*schema.fields, StructField("reason", StringType()), StructField("batch", LongType())])
        try:
            return self.spark.read.schema(wanted).parquet(f"{self.folder}/set_aside")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], wanted)
