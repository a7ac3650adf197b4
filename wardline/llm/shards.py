"""Token-ID output in training order: a keyed permutation of all sequences, written as fixed-stride shards.

The ids of all documents, each closed by id 0, form one stream that is cut into sequences of equal
length. A Feistel network under a key, walked along its cycles until it lands below the number of
sequences, gives each sequence a global slot. Rows are dealt by ranges of slots, and each task
writes whole shards in slot order: record i of shard s is slot s * per_shard + i, so a reader
resumes anywhere by arithmetic.

A shard is written under a name of its attempt and renamed when complete; a finished shard of the
right size is not written again. So lost tasks, retries and restarts into the same folder leave
whole shards only. A folder given by the caller gets a manifest before its first shard: the input,
vocabulary, key, sizes, where the stream is stored, and a hash of every document's place and ids. A
restart goes on with the stored stream; another input or setting, a stream in another order, or
shards without a manifest are an error.

Nulls: a null text counts as empty and still has its closing id; a null id is kept in the index.
Repeated rows are in the stream each. An empty table gives no shards. Only the last sequence of the
stream may be short; it is padded, and its length says so. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.base import byte_slices
from wardline.llm.tokens import encoder
from wardline.session import new_folder

LENGTH = 2048
PER_SHARD = 4096
CLOSING_ID = 0
PADDING_ID = 0
KEY = 0x5EED
ROUNDS = 6
READ_BYTES = 1 << 20


class Permutation:
    """A keyed bijection of 0 .. n-1, and its inverse, for whole arrays."""

    def __init__(self, n: int, key: int = KEY):
        self.n = max(n, 1)
        self.half = max(1, -(-(self.n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, ROUNDS, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x = x * np.uint64(0xBF58476D1CE4E5B9)
            return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1] if inverse else self.keys:
            if inverse:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def __call__(self, index: np.ndarray, inverse: bool = False) -> np.ndarray:
        out = self._once(np.asarray(index).astype(np.uint64), inverse)
        while (far := out >= self.n).any():  # walk the cycle until it is back among the sequences
            out[far] = self._once(out[far], inverse)
        return out.astype(np.int64)


def _codec() -> tuple:
    """The worker's zstd coder and decoder."""
    if not _CODEC:
        import zstandard

        _CODEC.extend((zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress))
    return tuple(_CODEC)


_CODEC: list = []


def _packed(ids: np.ndarray) -> bytes:
    """Ids of 16 bits, compressed for the way between tasks."""
    return _codec()[0](ids.tobytes())


def _closed(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All ids in little-endian unsigned 16 bits, each document's closed; larger ids are an error."""
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit the shards' 16 bits")
    out = np.full(len(ids) + len(counts), CLOSING_ID, "<u2")
    own = np.ones(len(out), bool)
    own[np.cumsum(counts) + np.arange(len(counts))] = False
    out[own] = ids
    return out


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(_codec()[1](blob), "<u2")


def token_stream(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, part, start, n, ids): each document's ids and where they start in its part of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in byte_slices(batch, "text"):
                ids, counts = encode(piece.column("text"))
                closed = _closed(ids, counts)
                sizes = counts + 1
                ends = np.cumsum(sizes)
                blobs = [_packed(closed[e - n : e]) for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(at + ends - sizes), pa.array(sizes), pa.array(blobs, pa.binary()),
                    ],
                    names=["doc_id", "part", "start", "n", "ids"],
                )
                at += int(ends[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, part int, start long, n long, ids binary")


def part_begins(stream: DataFrame) -> tuple[dict[int, int], int]:
    """Where each part of the stream begins, and how many ids there are: one number per input partition."""
    sizes = {r["part"]: r["n"] for r in stream.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    begins, total = {}, 0
    for part in sorted(sizes):
        begins[part], total = total, total + sizes[part]
    return begins, total


def fragments(stream: DataFrame, begins: dict[int, int], permute: Permutation, length: int, per_shard: int, with_ids: bool) -> DataFrame:
    """Documents cut at sequence ends: rows (doc_id, sequence, slot, shard, offset, n), and their ids if wanted."""
    columns = ["doc_id", "part", "start", "n", *(["ids"] if with_ids else [])]
    parts = np.array(sorted(begins), np.int64)  # two numbers per input partition go to the tasks
    places = np.array([begins[p] for p in parts.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "ids") if with_ids else [batch]:
                part, start = np.asarray(piece.column("part")), np.asarray(piece.column("start"))
                begin = start + places[np.searchsorted(parts, part)]
                end = begin + np.asarray(piece.column("n"))
                first, last = begin // length, (end - 1) // length
                doc = np.repeat(np.arange(len(part)), last - first + 1)
                sequence = np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[doc]
                low, high = np.maximum(begin[doc], sequence * length), np.minimum(end[doc], (sequence + 1) * length)
                blobs, at = [], -1
                for d, a, b in zip(doc, low, high) if with_ids else ():
                    if a == begin[d] and b == end[d]:  # not cut
                        blobs.append(piece.column("ids")[int(d)].as_py())
                        continue
                    if d != at:
                        at, ids = d, _unpacked(piece.column("ids")[int(d)].as_py())
                    blobs.append(_packed(ids[a - begin[d] : b - begin[d]]))
                slot = permute(sequence)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(pa.array(doc)), pa.array(sequence), pa.array(slot),
                        pa.array(slot // per_shard), pa.array(low - sequence * length), pa.array(high - low),
                        *([pa.array(blobs, pa.binary())] if with_ids else []),
                    ],
                    names=["doc_id", "sequence", "slot", "shard", "offset", "n", *(["ids"] if with_ids else [])],
                )

    kind = stream.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, sequence long, slot long, shard long, offset long, n long"
    return stream.select(columns).mapInArrow(run, f"{fields}, ids binary" if with_ids else fields)


class _Shard:
    """One shard's file, built record by record in slot order."""

    def __init__(self, files, folder: str, shard: int, length: int, per_shard: int, n_slots: int):
        self.files, self.length = files, length
        self.path = f"{folder}/shard-{shard:08d}.bin"
        self.first = shard * per_shard
        self.size = (min(n_slots, self.first + per_shard) - self.first) * length * 2
        info = files.get_file_info(self.path)
        self.done = info.is_file and info.size == self.size
        self.temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
        self.out = None if self.done else files.open_output_stream(self.temporary)
        self.slot, self.record = self.first, np.full(length, PADDING_ID, "<u2")

    def add(self, slot: int, offset: int, ids: np.ndarray) -> None:
        self._upto(slot)
        self.record[offset : offset + len(ids)] = ids

    def _upto(self, slot: int) -> None:
        while self.slot < slot:
            if self.out:
                self.out.write(self.record.tobytes())
            self.record[:] = PADDING_ID
            self.slot += 1

    def close(self) -> None:
        self._upto(self.first + self.size // (2 * self.length))
        if self.out:
            self.out.close()
            self.files.move(self.temporary, self.path)


def _filesystem(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def write_shards(pieces: DataFrame, folder: str, n_slots: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes all shards into ``folder`` and returns rows (shard, bytes) of those written or found whole."""
    n_shards = -(-n_slots // per_shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        now, number, written = None, -1, []
        for batch in batches:
            shard, slot, offset = (np.asarray(batch.column(c)) for c in ("shard", "slot", "offset"))
            for i in range(batch.num_rows):
                if shard[i] != number:
                    if now:
                        now.close()
                        written.append((number, now.size))
                    number = int(shard[i])
                    now = _Shard(files, path, number, length, per_shard, n_slots)
                if not now.done:
                    now.add(int(slot[i]), int(offset[i]), _unpacked(batch.column("ids")[i].as_py()))
        if now:
            now.close()
            written.append((number, now.size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in written], pa.int64()), pa.array([n for _, n in written], pa.int64())], names=["shard", "bytes"]
        )

    parts = min(max(n_shards, 1), max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    # A permutation fills all shards alike, so equal ranges of shards are equal shares: no sampling is needed.
    place = F.floor(F.col("shard") * parts / max(n_shards, 1)).cast("int")
    dealt = pieces.select("shard", "slot", "offset", "ids").repartitionById(parts, place)
    return dealt.sortWithinPartitions("slot", "offset").mapInArrow(run, "shard long, bytes long")


def read_shards(spark: SparkSession, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Rows (slot, shard, position, ids) of every record, read back from the files a few records at a time."""
    from pyarrow.fs import FileSelector

    files, path = _filesystem(folder)
    names = [i.base_name for i in files.get_file_info(FileSelector(path, allow_not_found=True))]
    shards = sorted(int(m[1]) for m in map(re.compile(r"shard-(\d+)\.bin").fullmatch, names) if m)
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with files.open_input_stream(f"{path}/shard-{shard:08d}.bin") as source:
                    at = 0
                    while raw := source.read(stride * max(1, READ_BYTES // stride)):
                        n = len(raw) // stride
                        offsets = (np.arange(n + 1) * stride).astype(np.int32)
                        blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                        position = np.arange(at, at + n, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard * per_shard + position), pa.array(np.full(n, shard, np.int64)), pa.array(position), blobs],
                            names=["slot", "shard", "position", "ids"],
                        )
                        at += n

    listed = spark.createDataFrame([(s,) for s in shards], "shard long").repartition(max(1, min(len(shards), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return listed.mapInArrow(run, "slot long, shard long, position long, ids binary")


def _sums(rows: DataFrame, *columns) -> list[int]:
    """How many rows there are, and sums of both halves of their hashes: the same in whatever order they come."""
    mixed = F.xxhash64(*columns)
    low, high = mixed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(mixed, 32)
    return [int(x or 0) for x in rows.agg(F.count("*"), F.sum(low), F.sum(high)).first()]


def _source(docs: DataFrame, vocabulary: str) -> dict:
    with open(vocabulary, "rb") as file:
        code = zlib.crc32(file.read())
    return {"docs": _sums(docs, F.col("doc_id"), F.col("text").cast("string")), "vocabulary": code}


def _layout(stream: DataFrame, begins: dict[int, int]) -> list[int]:
    """A hash of where every document stands in the stream, and of its ids."""
    listed = [(int(p), int(b)) for p, b in begins.items()]
    parts = stream.sparkSession.createDataFrame(listed, "part int, begin long")  # a number per input partition
    placed = stream.join(F.broadcast(parts), "part")
    return _sums(placed, F.col("begin") + F.col("start"), F.col("n"), F.col("doc_id"), F.col("ids"))


def _manifest(folder: str) -> dict | None:
    from pyarrow.fs import FileSelector

    files, path = _filesystem(folder)
    info = files.get_file_info(f"{path}/manifest.json")
    if info.is_file:
        with files.open_input_stream(info.path) as file:
            return json.loads(file.read())
    found = files.get_file_info(FileSelector(path, allow_not_found=True))
    if any(re.fullmatch(r"shard-\d+\.bin", i.base_name) for i in found):
        raise ValueError(f"{folder} holds shards without a manifest")
    return None


def _write_manifest(folder: str, manifest: dict) -> None:
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    temporary = f"{path}/.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as file:
        file.write(json.dumps(manifest).encode())
    files.move(temporary, f"{path}/manifest.json")


def _stored(docs: DataFrame, vocabulary: str, path: str | None) -> tuple[DataFrame, str]:
    """The stream that an earlier run stored, or a new one if there is none any more; and its path."""
    spark, fresh = docs.sparkSession, token_stream(docs, vocabulary)
    if path:
        try:
            return spark.read.schema(fresh.schema).parquet(path), path
        except AnalysisException:
            pass  # removed since: a new stream must have the same layout
    path = new_folder(spark, "llm-stream")
    fresh.write.parquet(path)
    return spark.read.schema(fresh.schema).parquet(path), path


def training_order(docs: DataFrame, vocabulary: str, folder: str | None = None, length: int = LENGTH,
                   per_shard: int = PER_SHARD, key: int = KEY) -> tuple[DataFrame, str, int]:
    """Writes the shards; returns the index of fragments without ids, the folder, and how many ids there are."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    before = _manifest(folder) if folder else None
    own = {"key": key, "length": length, "per_shard": per_shard, **_source(slim, vocabulary)} if folder else {}
    if before and any(before[k] != v for k, v in own.items()):
        raise ValueError(f"{folder} holds shards of another input or other settings")
    stream, path = _stored(slim, vocabulary, before and before["stream"])
    begins, total = part_begins(stream)
    permute = Permutation(-(-total // length), key)
    if folder:
        layout = _layout(stream, begins)
        if before and before["layout"] != layout:
            raise ValueError(f"{folder} holds shards of a stream in another order")
        if not before:
            _write_manifest(folder, {**own, "stream": path, "layout": layout})
    folder = folder or new_folder(spark, "llm-shards")
    if total:
        pieces = fragments(stream, begins, permute, length, per_shard, with_ids=True)
        written = write_shards(pieces, folder, -(-total // length), length, per_shard)
        written.agg(F.sum("bytes")).collect()
    return fragments(stream, begins, permute, length, per_shard, with_ids=False), folder, total


def shard_contents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (slot, sequence_id, shard, position, n_tokens, ids_crc32, doc_ids): every record as read back, with its documents in order."""
    index, folder, total = training_order(docs, vocabulary)
    spark = docs.sparkSession
    placed = F.array_sort(F.collect_list(F.struct("offset", "doc_id")))
    own = index.groupBy("slot").agg(
        F.min("sequence").alias("sequence_id"), F.sum("n").alias("n_tokens"), placed.alias("placed")
    )
    if not total:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame(
            [], f"slot long, sequence_id long, shard long, position long, n_tokens long, ids_crc32 long, doc_ids array<{kind}>"
        )
    read = read_shards(spark, folder).select("slot", "shard", "position", F.crc32("ids").alias("ids_crc32"))
    return read.join(own, "slot").select(
        "slot", "sequence_id", "shard", "position", "n_tokens", "ids_crc32",
        F.transform("placed", lambda p: p["doc_id"]).alias("doc_ids"),
    )
