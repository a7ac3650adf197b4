"""What the operators share: tables, staging, Arrow helpers and connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.tables import materialize

SLICE_BYTES = 4 << 20
_SHIPPED: set[str] = set()
_KEPT: dict[Hashable, Any] = {}


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, safe from lost executors."""
    return materialize(df, f"llm-{name}")


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task, one thing at a time.

    A worker serves one stage after the other: what it kept for another stage goes before the new is
    made, so that their sizes never add up.
    """
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """For stages that keep nothing: gives up what the worker kept for the stages before."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes of a text column, one row at least."""
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _differs(col: pa.Array) -> np.ndarray:
    """For each row but the first: whether the value is another one than in the row before."""
    here, before = col.slice(1), col.slice(0, len(col) - 1)
    same = pc.fill_null(pc.equal(here, before), False)
    both_null = pc.and_(pc.is_null(here), pc.is_null(before))
    return ~np.asarray(pc.or_(same, both_null).to_numpy(zero_copy_only=False), dtype=bool)


def _breaks(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a run of equal keys starts, the first row left out."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for key in keys:
        col = batch.column(key)
        out |= _differs(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col)
    return np.flatnonzero(out) + 1


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``keys`` as tables in which no run of equal keys is cut, with the runs' starts.

    Only the last, still open run of a batch is carried on.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if len(_breaks(edge, keys)):
                yield _with_starts(held, keys)
                held = []
        marks = _breaks(batch, keys)
        if not len(marks):
            held.append(batch)
            continue
        cut = int(marks[-1])
        yield _with_starts([*held, batch.slice(0, cut)], keys)
        held = [batch.slice(cut)]
    if held:
        yield _with_starts(held, keys)


def _with_starts(parts: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole, np.concatenate([[0], _breaks(whole, keys)]).astype(np.int64)


def spans_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (``src``, ``dst``): rows (``node``, ``root``), root the smallest node.

    Alternates two steps until nothing changes: every node ties its larger neighbours to the
    smallest node it knows, then its smaller ones. Both keep components and shrink the graph to
    stars in a logarithmic number of rounds. Each round is a table in the shared folder; only two
    numbers per round reach the driver. Links with a null or equal ends tie nothing.
    """
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = staged(now, "links")
    seen = _fingerprint(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        if (then := _fingerprint(now)) == seen:
            break
        seen = then
    stars = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _fingerprint(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF)))).first())
