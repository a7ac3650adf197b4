"""Embedding near-dedup by spherical-cap filters from structured random product codes.

Vectors are rotated at random and cut into two halves, each with a random spherical code; several
rotations give several such product codes. A filter is one codeword per half. In each code a vector
passes the PASSED filters with the largest sums of its inner products with both codewords, however
many vectors there are and wherever it lies, so none is left without filters. These are found from
the best PASSED codewords of each half. Vectors that share a filter meet and are verified by their
cosine in double precision.

Equal vectors meet first and count as one with a multiplicity. A pair is counted in the first
filter both pass only, and a filter yields counts and one link per vector, never its pairs. A
filter passed by more than BLOCK vectors is dealt in blocks; each pair of blocks is a task's unit,
so memory is bounded and nothing is left out.

The number of filters grows with the number of vectors, so that a filter holds about FILL of them at
every size, or as many as lie within the least cosine of a vector where those are more. The number
of codes grows with it: codes are added until a pair at the least cosine shares a filter with a
probability of RECALL. Rotations and codewords are random, so that probability is the same for every
such pair, and it is taken from PROBES pairs over the very codes used, less three standard errors.
Vectors of one or two components meet by arcs of the circle, without a miss.

Nulls: null vectors, zero vectors and those that hold null or non-finite components link with
nothing; their component is their own id. Vectors of different lengths never link. A null id counts as a
vector but is no component's smallest unless all are. Repeated rows link with each other. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.base import components, staged, whole_runs

LEAST_COSINE = 0.95
FILL = 64
PASSED = 8
RECALL = 0.9995
PROBES = 2048
BLOCK = 1024
SEED = 20_240
# What a task handles at once: a filter and a pair of its blocks; a block paired with itself has one side.
UNIT = ["dim", "filter", "low", "high"]


def _near_share(dim: int, least: float) -> float:
    """The share of random directions within cosine ``least`` of one, for two components or more."""
    mass = np.sin((np.arange(65_536) + 0.5) * np.pi / 65_536) ** (dim - 2)
    return float(mass[: max(1, round(np.arccos(least) / np.pi * 65_536))].sum() / mass.sum())


class Caps:
    """The filters for vectors of one length.

    How many codes the recall takes is found once, on the driver; workers are told the number and draw
    the same codes, whatever the last digits of their arithmetic.
    """

    def __init__(self, dim: int, n_vectors: int, least: float = LEAST_COSINE, n_codes: int | None = None):
        self.codes: list[tuple[np.ndarray, np.ndarray]] = []
        self.missed = 0.0  # share of the pairs at the least cosine that meet in no filter
        self.arc = np.arccos(min(max(least, -1.0), 1.0)) + 1e-9
        if dim <= 2:
            return
        rng = np.random.default_rng([SEED, dim])
        share = min(0.25, max(FILL / max(n_vectors, 1), _near_share(dim, least)))  # of all vectors that pass a filter
        self.size = round((PASSED / share) ** 0.5)
        x, z = rng.standard_normal((2, PROBES, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = least * x + max(1 - least**2, 0.0) ** 0.5 * z
        cut = (dim + 1) // 2
        self.missed = 1.0
        while self.missed > 1 - RECALL if n_codes is None else len(self.codes) < n_codes:
            rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            halves = []
            for low, high in ((0, cut), (cut, dim)):
                words = rng.standard_normal((self.size, high - low))
                words /= np.linalg.norm(words, axis=1, keepdims=True)
                halves.append(rotation[:, low:high] @ words.T)
            self.codes.append(tuple(halves))
            if n_codes is not None:
                continue
            one, two = self._passed(x, *halves), self._passed(y, *halves)
            meet = (one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).mean()
            self.missed *= min(1.0, 1 - meet + 3 * (max(meet * (1 - meet), 1 / PROBES) / PROBES) ** 0.5)

    def _passed(self, unit: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The PASSED filters of one code with the largest sums, for each unit vector."""
        a, b = unit @ first, unit @ second
        n = min(PASSED, self.size)
        i, j = (np.argpartition(-x, n - 1, axis=1)[:, :n] for x in (a, b))
        sums = np.take_along_axis(a, i, 1)[:, :, None] + np.take_along_axis(b, j, 1)[:, None, :]
        names = (i[:, :, None] * self.size + j[:, None, :]).reshape(len(unit), -1)
        best = np.argpartition(-sums.reshape(len(unit), -1), PASSED - 1, axis=1)[:, :PASSED]
        return np.take_along_axis(names, best, 1)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each unit vector passes."""
        if not self.codes:  # one or two components: two neighbouring arcs of the circle each, so that any two within an arc meet
            angle = np.arctan2(unit[:, 1] if unit.shape[1] > 1 else 0.0, unit[:, 0]) + np.pi
            arcs = max(1, int(2 * np.pi / self.arc))
            own = np.minimum((angle / (2 * np.pi) * arcs).astype(np.int64), arcs - 1)
            every = np.stack([own, (own + 1) % arcs], axis=1) if arcs > 1 else own[:, None]
            return np.repeat(np.arange(len(unit)), every.shape[1]), every.ravel()
        found = [self._passed(unit, *halves) + n * self.size**2 for n, halves in enumerate(self.codes)]
        every = np.concatenate(found, axis=1)
        return np.repeat(np.arange(len(unit)), every.shape[1]), every.ravel()


_CAPS: dict[tuple[int, int, float, int | None], Caps] = {}


def caps(dim: int, n_vectors: int, least: float = LEAST_COSINE, n_codes: int | None = None) -> Caps:
    key = dim, n_vectors, least, n_codes
    if key not in _CAPS:
        _CAPS[key] = Caps(*key)
    return _CAPS[key]


def _matrix(col: pa.Array, dtype: str) -> np.ndarray:
    """Rows of a binary column of vectors of one length, in double precision."""
    return np.frombuffer(b"".join(v.as_py() for v in col), dtype).reshape(len(col), -1).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, dtype: str, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, v): v the components in one binary, null where the vector links with nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            values = np.asarray(pc.fill_null(lists.flatten(), float("nan"))).astype(dtype) + np.zeros(1, dtype)  # minus zero is zero
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
            good = (np.diff(bad[bounds]) == 0) & (np.diff(some[bounds]) > 0)
            raw, step = values.tobytes(), values.itemsize
            out = [raw[a * step : b * step] if ok else None for ok, a, b in zip(good.tolist(), bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "v"])

    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    cast = "array<float>" if dtype == "<f4" else "array<double>"
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast(cast).alias("x"))
    return slim.mapInArrow(pack, f"id {kind}, v binary")


def list_decode(classes: DataFrame, n_vectors: int, lengths: list[int], dtype: str, least: float = LEAST_COSINE) -> DataFrame:
    """Adds ``dim`` and ``filters``, the sorted filters that each vector passes; ``lengths`` are those of the vectors."""
    n_codes = {dim: len(caps(dim, n_vectors, least).codes) for dim in lengths}  # a number per length of vectors
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v.as_py()) for v in batch.column("v")]) // np.dtype(dtype).itemsize
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                own = caps(int(dim), n_vectors, least, n_codes[int(dim)])
                for start in range(0, len(at), 512):
                    some = batch.take(pa.array(at[start : start + 512]))
                    row, found = own.decode(_unit(_matrix(some.column("v"), dtype)))
                    order = np.lexsort((found, row))
                    held = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=some.num_rows))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(held), pa.array(found[order].astype(np.int64)))
                    dims = pa.array(np.full(some.num_rows, dim, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, dims, lists], names=[*some.schema.names, "dim", "filters"]
                    )

    return classes.mapInArrow(run, f"{fields}, dim int, filters array<bigint>")


def _met_before(filters: list[np.ndarray], own: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows also share a filter before ``own``, from one product of incidence matrices."""
    hit, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    earlier = [f[: np.searchsorted(f, own)] for f in (filters[k] for k in hit)]
    names, code = np.unique(np.concatenate(earlier), return_inverse=True)
    if not len(names):
        return np.zeros(len(i), bool)
    passed = np.zeros((len(hit), len(names)), np.float32)
    passed[np.repeat(np.arange(len(hit)), [len(f) for f in earlier]), code] = 1
    return (passed @ passed.T)[at[: len(i)], at[len(i) :]] > 0


def verify(meeting: DataFrame, least: float, dtype: str) -> DataFrame:
    """Rows (rep, n, low): how many vectors a class links with in a filter, and the class it hangs on there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_runs(batches, UNIT):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for start, stop in zip(first, [*first[1:], table.num_rows]):
                if stop - start > 1:
                    out.extend(_meet(table.slice(start, stop - start).combine_chunks(), least, dtype))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "n", "low"])

    return meeting.mapInArrow(run, "rep long, n long, low long")


def _meet(part: pa.Table, least: float, dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One filter's block with itself or with another: verified links as counts and smallest classes."""
    rep, weight, side = (np.asarray(part.column(c)) for c in ("rep", "weight", "side"))
    left = np.flatnonzero(side == 0)
    alone = part.column("low")[0] == part.column("high")[0]
    right = left if alone else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return
    x = _unit(_matrix(part.column("v").combine_chunks(), dtype))
    cos = x[left] @ x[right].T
    if alone:
        cos[np.tril_indices(len(left))] = -2
    i, j = np.nonzero(cos >= least)
    if not len(i):
        return
    i, j = left[i], right[j]
    lists = part.column("filters").combine_chunks()
    flat, held = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64)
    held = held - held[0]
    filters = [flat[a:b] for a, b in zip(held, held[1:])]
    own = part.column("filter")[0].as_py()
    counted = ~_met_before(filters, own, i, j)
    n, low = np.zeros(len(rep), np.int64), rep.copy()
    np.add.at(n, i[counted], weight[j[counted]])
    np.add.at(n, j[counted], weight[i[counted]])
    while True:  # smallest class id over these links
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (before == low).all():
            break
    hit = np.unique(np.concatenate([i, j]))
    yield rep[hit], n[hit], low[hit]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """Rows (id, n_links, component): links counted over all rows, component the smallest id reachable."""
    element = vectors.schema[vector].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    own = staged(
        usable(vectors, dtype, id_col, vector).withColumn("uid", F.monotonically_increasing_id()), "vectors"
    )
    classes = own.where("v IS NOT NULL").groupBy("v").agg(
        F.min("uid").alias("rep"), F.count("*").alias("weight"), F.min("id").alias("least")
    )
    sizes = own.groupBy(F.octet_length("v").alias("bytes")).agg(F.count("*").alias("n")).collect()  # one row per length
    lengths = [r.bytes // np.dtype(dtype).itemsize for r in sizes if r.bytes is not None]
    decoded = staged(list_decode(classes, sum(r.n for r in sizes), lengths, dtype, least), "decoded")
    crowded = decoded.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(F.count("*").alias("held"))
    crowded = crowded.where(F.col("held") > BLOCK)
    rows = decoded.select("dim", "rep", "weight", "v", "filters", F.explode("filters").alias("filter"))
    rows = rows.join(crowded, ["dim", "filter"], "left")
    rows = rows.withColumn("blocks", F.ceil(F.coalesce("held", F.lit(1)) / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = rows.select(
        "dim", "filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "rep", "weight", "v", "filters",
    )
    meeting = meeting.repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "rep")
    found = staged(verify(meeting, least, dtype), "links")
    roots = components(found.where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")))
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = _named(decoded, counted, roots)
    return own.join(named, "v", "left").select(
        "id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("rep").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component"),
    )


def _named(decoded: DataFrame, counted: DataFrame, roots: DataFrame) -> DataFrame:
    """Each class of equal vectors with its links (copies included) and its component's smallest id."""
    slim = decoded.select("v", "rep", "weight", "least").join(counted, "rep", "left")
    slim = slim.join(roots, slim.rep == roots.node, "left").withColumn("root", F.coalesce("root", "rep"))
    lowest = slim.groupBy("root").agg(F.min("least").alias("component"))
    total = (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n")
    return slim.join(lowest, "root").select("v", "rep", total, "component")


def embedding_components(vectors: DataFrame) -> DataFrame:
    found = near_vectors(vectors)
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


# All pairs and all paths: for small tables only.
SQL = f"""
WITH RECURSIVE vectors AS (
    SELECT row_number() OVER () AS uid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
  good AS (
    SELECT *, len(x) AS dim FROM vectors WHERE x IS NOT NULL
      AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0),
  links AS (
    SELECT a.uid AS src, b.uid AS dst FROM good a JOIN good b ON a.dim = b.dim AND a.uid <> b.uid
    WHERE list_cosine_similarity(a.x, b.x) >= {LEAST_COSINE}::DOUBLE),
  reach(uid, seen) AS (
    SELECT uid, uid FROM vectors
    UNION SELECT r.uid, l.dst FROM reach r JOIN links l ON l.src = r.seen),
  lowest AS (SELECT r.uid, min(v.vec_id) AS component_id FROM reach r JOIN vectors v ON v.uid = r.seen GROUP BY r.uid),
  counted AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors v JOIN lowest USING (uid) LEFT JOIN counted c ON c.src = v.uid
"""
