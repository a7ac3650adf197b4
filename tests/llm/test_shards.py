"""Training-order shards: every document comes back from the files, in order."""

import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wardline.llm import catalog, shards
from wardline.llm.base import staged

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation(n):
    permute = shards.Permutation(n, key=n)
    index = np.arange(n)
    slots = permute(index)
    assert sorted(slots.tolist()) == index.tolist()
    assert permute(slots, inverse=True).tolist() == index.tolist()
    if n > 100:
        assert (shards.Permutation(n, key=n + 1)(index) != slots).mean() > 0.9
        assert np.abs(np.corrcoef(index, slots)[0, 1]) < 0.2


def read(spark, folder, length, per_shard):
    return {r.slot: np.frombuffer(r.ids, "<u2").tolist() for r in shards.read_shards(spark, folder, length, per_shard).collect()}


def stream_of(index, records, total, length):
    """The stream in its own order, from the records and the permutation's index."""
    order = {r.sequence: r.slot for r in index}
    flat = [i for s in sorted(order) for i in records[order[s]]]
    assert len(order) == -(-total // length) == len(records) and not any(flat[total:])
    return flat[:total]


def documents_of(index, flat, length):
    spans = {}
    for r in sorted(index, key=lambda r: (r.sequence, r.offset)):
        spans.setdefault(r.doc_id, []).append((r.sequence * length + r.offset, r.n))
    return {d: [flat[a : a + n] for a, n in parts] for d, parts in spans.items()}


@pytest.mark.parametrize("length,per_shard", [(64, 8), (2048, 4096)])
def test_documents(spark, tmp_path, length, per_shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    folder = f"file://{tmp_path}/out"
    index, _, total = shards.training_order(docs, WORDS, folder, length, per_shard)
    index, records = index.collect(), read(spark, folder, length, per_shard)
    flat = stream_of(index, records, total, length)
    found = {d: [i for part in parts for i in part] for d, parts in documents_of(index, flat, length).items()}
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    assert found == {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    sizes = [os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out") if f.endswith(".bin")]
    assert sum(sizes) == 2 * length * len(records) and sum(s != 2 * length * per_shard for s in sizes) <= 1
    assert not [f for f in os.listdir(tmp_path / "out") if f.endswith(".tmp")]


def test_a_second_run_writes_only_what_is_missing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(2)
    docs = staged(docs, "test-docs")
    folder = f"file://{tmp_path}/out"
    shards.training_order(docs, WORDS, folder, 64, 100)
    before = read(spark, folder, 64, 100)
    files = sorted(f for f in os.listdir(tmp_path / "out") if f.endswith(".bin"))
    times = {f: os.stat(tmp_path / "out" / f).st_mtime_ns for f in files}
    broken = tmp_path / "out" / files[3]
    broken.write_bytes(b"half")
    shards.training_order(docs, WORDS, folder, 64, 100)
    assert read(spark, folder, 64, 100) == before
    now = {f: os.stat(tmp_path / "out" / f).st_mtime_ns for f in files}
    assert [f for f in files if now[f] != times[f]] == [files[3]]


def test_query(spark):
    rows = catalog.op4_token_shards(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    total = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs)
    assert sum(r.n_tokens for r in rows) == total
    assert sorted(r.slot for r in rows) == sorted(r.sequence_id for r in rows) == list(range(-(-total // 2048)))
    assert {d for r in rows for d in r.doc_ids} == {r.doc_id for r in docs}
    ordered = [d for r in sorted(rows, key=lambda r: r.sequence_id) for d in r.doc_ids]
    text = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in docs}
    flat = [i for d in dict.fromkeys(ordered) for i in text[d]]
    for r in rows:
        part = flat[r.sequence_id * 2048 : (r.sequence_id + 1) * 2048]
        part += [0] * (2048 - len(part))
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u2").tobytes())


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "a " * 3000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, slot int, ids int").repartition(2)
    folder = f"file://{tmp_path}/odd"
    index, _, total = shards.training_order(df, WORDS, folder, 16, 4)
    index = index.collect()
    flat = stream_of(index, read(spark, folder, 16, 4), total, 16)
    assert total == len(flat) == 3 + 3 + 3001
    assert Counter(r.doc_id for r in index)[3] >= 3000 // 16
    assert shards.shard_contents(df.limit(0), WORDS).collect() == []


def test_a_restart_keeps_to_its_first_stream(spark, tmp_path):
    docs = staged(spark.read.parquet(f"{SF}/documents.parquet").repartition(4), "test-docs")
    folder = f"file://{tmp_path}/out"
    shards.training_order(docs, WORDS, folder, 64, 100)
    before = read(spark, folder, 64, 100)
    files = sorted(f for f in os.listdir(tmp_path / "out") if f.endswith(".bin"))
    (tmp_path / "out" / files[1]).write_bytes(b"half")
    # The same rows in other partitions: the missing shard comes from the stored stream.
    dealt = docs.repartition(3, "text")
    index, _, total = shards.training_order(dealt, WORDS, folder, 64, 100)
    assert read(spark, folder, 64, 100) == before
    stream_of(index.collect(), before, total, 64)
    with pytest.raises(ValueError):
        shards.training_order(docs, WORDS, folder, 64, 100, key=7)
    with pytest.raises(ValueError):
        shards.training_order(docs.where("doc_id % 2 = 0"), WORDS, folder, 64, 100)
    manifest = tmp_path / "out" / "manifest.json"
    manifest.write_text(manifest.read_text().replace("llm-stream", "gone"))
    with pytest.raises(ValueError):
        shards.training_order(dealt, WORDS, folder, 64, 100)
    other = tmp_path / "other"
    other.mkdir()
    (other / files[0]).write_bytes((tmp_path / "out" / files[0]).read_bytes())
    with pytest.raises(ValueError):
        shards.training_order(docs, WORDS, f"file://{other}", 64, 100)


def test_ids_beyond_sixteen_bits_are_an_error():
    ids, counts = np.array([7, 65_535, 3], np.int32), np.array([2, 0, 1])
    assert shards._closed(ids, counts).tolist() == [7, 65_535, 0, 0, 3, 0]
    assert shards._closed(ids[:0], counts[1:2]).tolist() == [0]
    with pytest.raises(ValueError):
        shards._closed(np.array([65_536], np.int32), np.array([1]))


def test_ranges_of_shards_go_to_their_tasks(spark):
    pieces = spark.range(40).selectExpr("id AS shard", "id * 4 AS slot", "0L AS offset", "CAST('' AS BINARY) AS ids")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        place = F.floor(F.col("shard") * 7 / 40).cast("int")
        dealt = pieces.repartitionById(7, place).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"))
        assert sorted(r.n for r in dealt.collect()) == [5, 5, 6, 6, 6, 6, 6]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
