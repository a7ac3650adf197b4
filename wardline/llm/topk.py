"""Exact top-k search by tiled matrix products.

Queries and candidates are cut into blocks and meet in tiles, one for each pair of a query block and
a shard of candidates. A tile is one matrix product after another over PANEL candidates; each panel
leaves a query's k best, which the tile merges. The lists of a query's tiles are merged in a tree of
MERGED lists a step, so no step gathers more than k * MERGED entries of a query. Blocks are as large
as WANTED tiles a shuffle partition allow, within LEAST and MOST vectors: a vector is sent once per
block of the other side.

Components become floor(SCALE * x); scores are integer inner products. They are exact: products run
in doubles where a bound on the panel's sums proves that no digit can be lost, otherwise in Python's
integers. Scores are ranked as numbers of up to 38 digits, larger ones as the nearest of these; the
result shows the nearest long.

A query meets every row but itself; a row of equal id is another row. Ties go to the smaller id, null
ids last. Nulls: vectors that are null or hold null or non-finite components take no part; zero
vectors do. Vectors of different lengths do not meet. Repeated rows are candidates of their own. A
query without candidates has no rows; an empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.base import staged, whole_runs

K = 10
SCALE = 1024
LEAST, MOST = 1024, 65_536
WANTED = 4
PANEL = 2048
ROWS = 512  # queries a product takes at once
MERGED = 32
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)
TILE = ["dim", "qb", "sb"]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, dim, v): finite vectors, v their components as they are stored."""
    element = vectors.schema[vector].dataType.elementType.simpleString()
    kind = np.dtype("<f4" if element == "float" else "<f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("x")))
            lists = batch.column("x")
            flat = lists.flatten()
            values = np.asarray(pc.fill_null(flat, float("nan"))).astype(kind)
            ends = np.cumsum(np.asarray(pc.list_value_length(lists)).astype(np.int64))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            blob = pa.Array.from_buffers(
                pa.large_binary(), len(ends),
                [None, pa.py_buffer(np.concatenate([[0], ends]) * kind.itemsize), pa.py_buffer(np.ascontiguousarray(values))],
            )
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array((ends - starts).astype(np.int32)), blob.cast(pa.binary())],
                names=["id", "dim", "v"],
            )
            yield out.filter(pa.array(bad[ends] == bad[starts]))

    id_kind = vectors.select(id_col).schema[0].dataType.simpleString()
    cast = "array<float>" if kind.itemsize == 4 else "array<double>"
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast(cast).alias("x"))
    return slim.mapInArrow(pack, f"id {id_kind}, dim int, v binary")


def integers(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x), in doubles; each is a whole number."""
    blob = b"".join(v.as_py() for v in col)
    kind = "<f4" if len(blob) == 4 * dim * len(col) else "<f8"
    x = np.frombuffer(blob, kind).reshape(len(col), dim).astype(float)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    return scaled if np.isfinite(scaled).all() else np.array([[int(a) * SCALE for a in row] for row in x], object)


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k largest scores in order, ties to smaller places."""
    step = float(1 << int(places.max(initial=0)).bit_length())
    if scores.dtype != object and (np.abs(scores).max(initial=0) + 1) * step < EXACT:
        key = places - scores * step  # whole numbers that order like (-score, place)
        at = np.argpartition(key, k - 1, axis=1)[:, :k] if key.shape[1] > k else np.broadcast_to(np.arange(key.shape[1]), key.shape)
        at = np.take_along_axis(at, np.take_along_axis(key, at, 1).argsort(axis=1), 1)
    else:
        rows = zip(scores.tolist(), places.tolist())
        at = [sorted(range(scores.shape[1]), key=lambda c: (-s[c], p[c]))[:k] for s, p in rows]
        at = np.array(at, np.int64).reshape(len(scores), -1)
    return np.take_along_axis(scores, at, 1), np.take_along_axis(places, at, 1)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where the sums cannot pass 2 ** 53, Python's integers elsewhere."""
    if queries.dtype != object and shard.dtype != object:
        most = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
        if most < EXACT:
            return queries @ shard.T
    whole = lambda x: np.array([[int(a) for a in row] for row in x.tolist()], object).reshape(x.shape)
    return whole(queries) @ whole(shard).T


def _tile(queries: np.ndarray, query_uids: np.ndarray, shard: np.ndarray, shard_uids: np.ndarray, k: int):
    """For each query of the tile its best k: scores and places in the shard, as lists."""
    for top in range(0, len(queries), ROWS):
        q, own = queries[top : top + ROWS], query_uids[top : top + ROWS]
        best_scores = best_places = None
        for at in range(0, len(shard), PANEL):
            part, uids = shard[at : at + PANEL], shard_uids[at : at + PANEL]
            scores = products(q, part)
            places = np.broadcast_to(np.arange(at, at + len(part), dtype=np.int64), scores.shape)
            # A query's own row: at most one of the panel; one more entry is kept and the row taken out.
            found, where = _best(scores, places, k + 1)
            if best_scores is not None:
                found, where = np.concatenate([best_scores, found], 1), np.concatenate([best_places, where], 1)
                found, where = _best(found, where, k + 1)
            best_scores, best_places = found, where
        for r in range(len(q)):
            others = shard_uids[best_places[r]] != own[r]
            yield best_scores[r][others][:k], best_places[r][others][:k]


ENTRY = "struct<score:decimal(38,0),no_id:boolean,vec_id:long>"


def _tiles(meeting: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_runs(batches, TILE):
            for start, stop in zip(first, [*first[1:], table.num_rows]):
                tile = table.slice(start, stop - start)
                dim, shard_no = tile.column("dim")[0].as_py(), tile.column("sb")[0].as_py()
                side = np.asarray(tile.column("side"))
                cut = int(np.searchsorted(side, 1))
                if not cut or cut == len(side):
                    continue
                uids = np.asarray(tile.column("uid"))
                ids = tile.column("id").combine_chunks()
                vectors = integers(tile.column("v"), dim)
                tops = list(_tile(vectors[:cut], uids[:cut], vectors[cut:], uids[cut:], k))
                held = np.concatenate([[0], np.cumsum([len(s) for s, _ in tops])]).astype(np.int32)
                scores = [min(max(int(x), -(10**38) + 1), 10**38 - 1) for s, _ in tops for x in s]
                found = ids.take(pa.array(np.concatenate([p for _, p in tops]) + cut))
                entries = pa.StructArray.from_arrays(
                    [pa.array(scores, pa.decimal128(38, 0)), pc.is_null(found), found.cast(pa.int64())],
                    names=["score", "no_id", "vec_id"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[:cut]), ids.slice(0, cut).cast(pa.int64()), pa.array(np.full(cut, shard_no, np.int32)),
                     pa.ListArray.from_arrays(pa.array(held), entries)],
                    names=["uid", "query_id", "sb", "best"],
                )

    return meeting.mapInArrow(run, f"uid long, query_id long, sb int, best array<{ENTRY}>")


def _first(entries: Column, k: int) -> Column:
    """The k first of a list of entries by score, then id, null ids last."""
    key = F.transform(entries, lambda e: F.struct((-e["score"]).alias("down"), e["no_id"], e["vec_id"]))
    return F.transform(
        F.slice(F.array_sort(key), 1, k),
        lambda e: F.struct((-e["down"]).cast("decimal(38,0)").alias("score"), e["no_id"], e["vec_id"]),
    )


def block_sizes(n_queries: int, n_rows: int, tiles: int) -> tuple[int, int]:
    """Vectors a query block and a shard: about ``tiles`` tiles, as square as LEAST and MOST allow."""
    side = int((max(n_queries, 1) * max(n_rows, 1) / max(tiles, 1)) ** 0.5)
    query = min(max(side, LEAST), MOST)
    blocks = -(-max(n_queries, 1) // query)
    return query, min(max(-(-max(n_rows, 1) * blocks // max(tiles, 1)), LEAST), MOST)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector: str = "embedding",
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every row with ``is_query`` its k best others.

    ``is_query`` is a condition on ``id``; ``sizes`` sets the vectors of a query block and a shard.
    """
    spark = vectors.sparkSession
    own = usable(vectors, id_col, vector).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    own = staged(own.withColumn("uid", F.monotonically_increasing_id()), "search-vectors")
    counts = own.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    tiles = WANTED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    query, shard = sizes or block_sizes(counts["q"], counts["n"], tiles)
    blocks, shards = -(-max(counts["q"], 1) // query), -(-max(counts["n"], 1) // shard)
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ["dim", "qb", "sb", "side", "id", "uid", "v"]
    asked = own.where("is_query").withColumn("qb", block(blocks)).withColumn("sb", every(shards)).withColumn("side", F.lit(0))
    given = own.withColumn("sb", block(shards)).withColumn("qb", every(blocks)).withColumn("side", F.lit(1))
    meeting = asked.select(*names).unionByName(given.select(*names))
    meeting = meeting.repartition(*TILE).sortWithinPartitions(*TILE, "side", F.col("id").asc_nulls_last(), "uid")
    lists = staged(_tiles(meeting, k), "search-lists")
    while shards > 1:
        lists = lists.withColumn("sb", F.floor(F.col("sb") / MERGED).cast("int")).groupBy("uid", "query_id", "sb")
        lists = lists.agg(_first(F.flatten(F.collect_list("best")), k).alias("best"))
        shards = -(-shards // MERGED)
    ranked = lists.select("query_id", F.posexplode("best").alias("at", "entry"))
    score = F.greatest(F.least(F.col("entry.score"), F.lit(LONG[1])), F.lit(LONG[0]))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.vec_id").alias("vec_id"), score.cast("long").alias("score")
    )


def exact_search(vectors: DataFrame) -> DataFrame:
    """The 10 best others of every row whose id is divisible by 100."""
    return top_k(vectors, F.col("id") % 100 == 0)


SQL = f"""
WITH vectors AS (
    SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS f
    FROM (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
  scored AS (
    SELECT q.uid, q.vec_id AS query_id, c.vec_id,
      coalesce(list_sum(list_transform(list_zip(q.f, c.f), lambda p: p[1] * p[2])), 0)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.uid <> c.uid AND len(q.f) = len(c.f) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
WHERE rank <= {K}
"""
