"""Merkle manifest of a dataset as a postorder append log.

Rows are leaves, numbered within their tree; every FAN consecutive nodes of a level become one node of
the next, the last run with fewer, down to one. A builder takes an aligned block of FAN ** LEVELS nodes,
so that it can finish every node above them without looking elsewhere, and writes its nodes in
completion order: a node right after its last child. Its segment is a contiguous piece of the tree's
postorder log. The finished tops of blocks are the input of the next round of builders, until each
tree has one top; the tops of all trees, in the order of their names, are the leaves of one more tree.

In a log nothing is looked up by search: ``position`` says where a node stands from its level, its
number and the number of leaves, as everything that was complete before it is a sum of subtree sizes.
Proofs are read by these addresses, from the top down: a block's nodes share what lies above the block.

Numbers come from a range partitioning by (tree, order): partition counts give offsets, so a tree of
any share of the rows is dealt over many tasks, and so are its blocks.

Nulls: a null field is ``-``; a null tree name is the first tree, a null id the first of its tree and
never tampered with. Repeated ids stand in the order of their leaves; rows repeated in every field are
leaves of their own. Empty and very long texts are values like any other. An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.base import staged, whole_runs

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- addresses -------------------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while FAN**levels < n:
        levels += 1
    return levels


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the postorder log of a tree of n leaves.

    Up to its own level, all nodes that start before its end are complete; above, those that end
    where it starts or earlier.
    """
    start = index * FAN**level
    end = min(start + FAN**level, n)
    done = sum(-(-end // FAN**k) for k in range(level + 1))
    return done - 1 + sum(start // FAN**k for k in range(level + 1, height(n) + 1))


def siblings(index: int, n: int, levels: int | None = None) -> list[tuple[int, list[int], list[int]]]:
    """Per level the node's number in its run and the positions of those before and after it there."""
    out = []
    for level in range(height(n) if levels is None else levels):
        width = -(-n // FAN**level)
        first = index - index % FAN
        run = [position(level, j, n) for j in range(first, min(first + FAN, width))]
        out.append((index - first, run[: index - first], run[index - first + 1 :]))
        index //= FAN
    return out


def node(children: bytes) -> bytes:
    """The digest over the hex texts of consecutive nodes, as a hex text."""
    return sha256(children).hexdigest().encode()


def _levels(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([node(b"".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return out


def _completion_order(levels: list[list[bytes]]) -> list[bytes]:
    """Nodes of a block as they are completed; the place of each is its ``position``."""
    out: list[bytes] = []
    for at, leaf in enumerate(levels[0], 1):
        out.append(leaf)
        for level in range(1, len(levels)):
            if at % FAN**level and at < len(levels[0]):
                break
            out.append(levels[level][-(-at // FAN**level) - 1])
    return out


# -- numbers within a tree --------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``i``, the row's number within its ``tree`` by ``order``, and ``n``, the tree's size; a stored frame."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees = batch.column("tree").dictionary_encode()
            codes = np.asarray(trees.indices)
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else []
            own = np.arange(len(codes), dtype=np.int64)
            for start, stop in zip(starts, [*starts[1:], len(codes)]):
                name = trees.dictionary[int(codes[start])].as_py()
                base = upto if name == tree else 0
                own[start:stop] += base - start
                tree, upto = name, base + int(stop - start)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(own)],
                names=[*batch.schema.names, "_part", "_at"],
            )

    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    held = staged(dealt.mapInArrow(count, f"{fields}, _part int, _at long"), "manifest-order")
    counts = held.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_part")) - F.col("_n")
    total = F.sum("_n").over(Window.partitionBy("tree"))
    # Stored when the rows of a tree are together: a file per tree, not one per task of the counts.
    offsets = staged(counts.select("tree", "_part", before.alias("_before"), total.cast("long").alias("n")), "manifest-offsets")
    joined = held.join(offsets, ["tree", "_part"])
    return staged(joined.select(*rows.columns, (F.col("_at") + F.col("_before")).cast("long").alias("i"), "n"), "manifest-leaves")


# -- building ----------------------------------------------------------------------------------------

SEGMENT = "tree string, n long, round int, block long, nodes binary, top binary, done boolean"


def _blocks(rows: DataFrame) -> DataFrame:
    dealt = rows.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "i")


def _segments(nodes: DataFrame, turn: int) -> DataFrame:
    """One row per block of nodes (tree, n, i, hash): its piece of the log, its top, whether that is the tree's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_runs(batches, ["tree", "block"]):
            hashes = table.column("hash").combine_chunks().to_pylist()
            ends = [*first[1:], table.num_rows]
            heads = table.take(pa.array(first))
            logs, tops, done = [], [], []
            for start, stop, n in zip(first, ends, heads.column("n").to_pylist()):
                left = height(n) - LEVELS * turn
                levels = _levels([h.hex().encode() for h in hashes[start:stop]], min(LEVELS, left))
                logs.append(bytes.fromhex(b"".join(_completion_order(levels)).decode()))
                tops.append(logs[-1][-DIGEST:])
                done.append(left <= LEVELS)
            columns = [heads.column(c).combine_chunks() for c in ("tree", "n")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(len(first), turn, np.int32)), heads.column("block").combine_chunks(),
                 pa.array(logs, pa.binary()), pa.array(tops, pa.binary()), pa.array(done)],
                names=["tree", "n", "round", "block", "nodes", "top", "done"],
            )

    return _blocks(nodes.select("tree", "n", "i", "hash")).mapInArrow(run, SEGMENT)


def build(leaves: DataFrame) -> list[DataFrame]:
    """The segments of every round over leaves (tree, n, i, hash); all blocks of a round at once."""
    rounds = [staged(_segments(leaves, 0), "manifest-segments")]
    while rounds[-1].where("NOT done").limit(1).count():
        below = rounds[-1].where("NOT done").select("tree", "n", F.col("block").alias("i"), F.col("top").alias("hash"))
        rounds.append(staged(_segments(below, len(rounds)), "manifest-segments"))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """Rows (tree, n, hash): what remains of every tree."""
    out = [r.where("done").select("tree", "n", F.col("top").alias("hash")) for r in rounds]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


def append_log(rounds: list[DataFrame]) -> DataFrame:
    """Rows (tree, position, level, hash): every node of every tree once, at its place in the tree's log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, n, size = LEVELS * row["round"], row["n"], len(row["nodes"])
                width = min(BLOCK, -(-n // FAN**base) - BLOCK * row["block"])
                at, levels, hashes = [], [], []
                for level in range(1 if base else 0, min(LEVELS, height(n) - base) + 1):
                    for j in range(-(-width // FAN**level)):
                        own = position(level, j, width) * DIGEST
                        at.append(position(base + level, row["block"] * FAN ** (LEVELS - level) + j, n))
                        levels.append(base + level)
                        hashes.append(row["nodes"][own : own + DIGEST])
                        assert own < size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(at), pa.string()), pa.array(at, pa.int64()),
                     pa.array(levels, pa.int32()), pa.array(hashes, pa.binary())],
                    names=["tree", "position", "level", "hash"],
                )

    out = [r.mapInArrow(run, "tree string, position long, level int, hash binary") for r in rounds]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


# -- proofs ------------------------------------------------------------------------------------------

# A path: the siblings level by level as hex, and per level how many stand before and after the node.
PATH = "sides array<int>, hashes string"


class _Block:
    """A block's nodes by address."""

    def __init__(self, nodes: bytes, n: int, turn: int, block: int):
        self.levels = min(LEVELS, height(n) - LEVELS * turn)
        self.width = min(BLOCK, -(-n // FAN ** (LEVELS * turn)) - BLOCK * block)
        text = nodes.hex()
        self.hex = [text[k : k + 2 * DIGEST] for k in range(0, len(text), 2 * DIGEST)]
        self.runs: dict[tuple[int, int], list[str]] = {}

    def path(self, at: int) -> Iterator[tuple[str, str]]:
        """Per level the hex texts before and after node ``at`` of the block."""
        for level in range(self.levels):
            group, own = divmod(at, FAN)
            run = self.runs.get((level, group))
            if run is None:
                width = -(-self.width // FAN**level)
                places = (position(level, j, self.width) for j in range(group * FAN, min(group * FAN + FAN, width)))
                run = self.runs[level, group] = [self.hex[p] for p in places]
            yield "".join(run[:own]), "".join(run[own + 1 :])
            at = group


def _paths_down(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (tree, block, sides, hashes) of the blocks below, from those of a round's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row["nodes"], row["n"], row["round"], row["block"])
                sides, hashes = [], []
                for at in range(block.width):
                    pairs = list(block.path(at))
                    sides.append([len(x) // (2 * DIGEST) for pair in pairs for x in pair] + row["sides"])
                    hashes.append("".join(x for pair in pairs for x in pair) + row["hashes"])
                numbers = row["block"] * BLOCK + np.arange(block.width, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * block.width, pa.string()), pa.array(numbers),
                     pa.array(sides, pa.list_(pa.int32())), pa.array(hashes, pa.string())],
                    names=["tree", "block", "sides", "hashes"],
                )

    joined = segments.join(paths, ["tree", "block"]).select("tree", "n", "round", "block", "nodes", "sides", "hashes")
    return joined.mapInArrow(run, f"tree string, block long, {PATH}")


def block_paths(rounds: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Rows (tree, block, sides, hashes): the path of every block of the lowest round up to its tree's top and beyond.

    ``above`` has the paths of the tops (tree, sides, hashes); without it a path ends at the top.
    """
    found = None
    for turn in reversed(range(len(rounds))):
        last = rounds[turn].where("done").select("tree", "block")
        if above is None:
            ends = last.withColumn("sides", F.array().cast("array<int>")).withColumn("hashes", F.lit(""))
        else:
            ends = last.join(above, "tree")
        found = ends if found is None else found.unionByName(ends)
        if turn:
            found = staged(_paths_down(rounds[turn], found), "manifest-paths")
    return found


def leaf_paths(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (tree, sides, hashes) of every leaf; ``i`` its number."""
    return _paths_down(segments, paths).select("tree", F.col("block").alias("i"), "sides", "hashes")


PROVED = "proof_sha256 string, folded_root string, subroot string"


def proved(leaves: DataFrame, rounds: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """Adds proof_sha256, folded_root and subroot to leaves (tree, n, i, hash, shown, ...).

    ``folded_root`` is computed from ``shown``, or ``hash`` where that is null, and the siblings. A
    block's segment and path arrive once, ahead of its leaves.
    """
    names = [c for c in leaves.columns if c not in ("block",)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)
    ends = tops(rounds).select("tree", F.lower(F.hex("hash")).alias("subroot"))
    heads = rounds[0].join(block_paths(rounds, above), ["tree", "block"]).join(ends, "tree")
    heads = heads.select("tree", "n", (F.col("block") * BLOCK).alias("i"), F.lit(0).alias("_kind"), "nodes", "sides", "hashes", "subroot")
    rows = leaves.withColumn("_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    dealt = rows.withColumn("_block", F.floor(F.col("i") / BLOCK).cast("long"))
    dealt = dealt.repartition("tree", "_block").sortWithinPartitions("tree", "_block", "_kind", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_runs(batches, ["tree", "_block"]):
            for start, stop in zip(first, [*first[1:], table.num_rows]):
                head = table.slice(start, 1).to_pylist()[0]
                own = table.slice(start + 1, stop - start - 1).combine_chunks()
                proofs, folded = _prove(head, own.column("hash").to_pylist(), own.column("shown").to_pylist())
                subroot = pa.array([head["subroot"]] * own.num_rows, pa.string())
                for batch in own.select(names).to_batches():
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(proofs, pa.string()), pa.array(folded, pa.string()), subroot],
                        names=[*names, "proof_sha256", "folded_root", "subroot"],
                    )

    return dealt.mapInArrow(run, f"{fields}, {PROVED}")


def _prove(head: dict, hashes: list[bytes], shown: list[bytes | None]) -> tuple[list[str], list[str]]:
    block = _Block(head["nodes"], head["n"], 0, head["i"] // BLOCK)
    above = head["hashes"].encode()
    pairs, at = [], 0
    for count in head["sides"]:
        pairs.append(above[at : at + 2 * DIGEST * count])
        at += 2 * DIGEST * count
    climbed: dict[bytes, bytes] = {}
    proofs, folded = [], []
    for k, (own, other) in enumerate(zip(hashes, shown)):
        path = [(a.encode(), b.encode()) for a, b in block.path(k)]
        proofs.append(sha256(b"".join([x for pair in path for x in pair]) + above).hexdigest())
        now = (own if other is None else other).hex().encode()
        for before, after in path:
            now = node(before + now + after)
        top = climbed.get(now)
        if top is None:  # what a block's top becomes on the way up does not depend on the leaf
            top = now
            for before, after in zip(pairs[::2], pairs[1::2]):
                top = node(before + top + after)
            climbed[now] = top
        folded.append(top.decode())
    return proofs, folded


# -- documents -----------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, each by its length in bytes and its value."""
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, tree, hash, shown): ``shown`` is the leaf after tampering, where a row is tampered with."""
    own = [F.col(c) for c in FIELDS]
    lowered = [*own[:-1], F.translate("text", CAPITALS, SMALL)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return docs.select("doc_id", tree.alias("tree"), leaf(own).alias("hash"), F.when(tampered, leaf(lowered)).alias("shown"))


def manifest(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one per document."""
    leaves = numbered(staged(document_leaves(docs), "manifest-hashes"), ["doc_id", "hash"])
    rounds = build(leaves)
    trees = tops(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    upper = numbered(staged(trees, "manifest-tops"), ["name"])
    crown = build(upper)
    above = leaf_paths(crown[0], block_paths(crown))
    above = upper.select("tree", "i", "name").join(above, ["tree", "i"]).select(F.col("name").alias("tree"), "sides", "hashes")
    found = proved(leaves, rounds, staged(above, "manifest-above"))
    root = tops(crown).select(F.lower(F.hex("hash"))).first()
    root = F.lit(root[0] if root else None).cast("string")
    return found.select(
        "doc_id", F.lower(F.hex("hash")).alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


_CRC = """
  crc_table AS (SELECT list(list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS n))"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned checksum of a string of ASCII characters, over rows joined with ``crc_table``."""
    codes = f"list_transform(string_split_regex({text}, ''), lambda x: ascii(x)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295)"


def _field_sql(name: str, value: str | None = None) -> str:
    text = f"CAST({value or name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join([*[_field_sql(f) for f in FIELDS[:-1]], _field_sql("text", text)]) + ")"


SQL = f"""
WITH RECURSIVE {_CRC},
  leaves AS (
    SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf_sql("text")} AS leaf,
      CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{CAPITALS}', '{SMALL}')")}
        END AS shown FROM documents, crc_table),
  ordered AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
  nodes(tree, level, i, hash, n) AS (
    SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM ordered
    UNION ALL
    SELECT *, count(*) OVER (PARTITION BY tree) FROM (
      SELECT tree, level + 1 AS level, i // {FAN} AS i, sha256(string_agg(hash, '' ORDER BY i)) AS hash
      FROM nodes WHERE n > 1 GROUP BY tree, level + 1, i // {FAN})),
  subroots AS (SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS i FROM nodes WHERE n = 1),
  crown(level, i, hash, n) AS (
    SELECT 0, i, hash, count(*) OVER () FROM subroots
    UNION ALL
    SELECT *, count(*) OVER () FROM (
      SELECT level + 1 AS level, i // {FAN} AS i, sha256(string_agg(hash, '' ORDER BY i)) AS hash
      FROM crown WHERE n > 1 GROUP BY level + 1, i // {FAN})),
  every AS (
    SELECT tree, level, i, hash, n FROM nodes
    UNION ALL SELECT 'crown', level, i, hash, n FROM crown),
  runs AS (
    SELECT tree, level, i // {FAN} AS run, list(hash ORDER BY i) AS held FROM every WHERE n > 1
    GROUP BY tree, level, i // {FAN}),
  climb(doc_id, own, tree, spot, i, level, part, folded, proof) AS (
    SELECT doc_id, i, tree, tree, i, 0, 0, coalesce(shown, leaf), '' FROM ordered
    UNION ALL
    SELECT c.doc_id, c.own, c.tree,
      CASE WHEN r.tree IS NULL THEN 'crown' ELSE c.spot END,
      CASE WHEN r.tree IS NULL THEN s.i ELSE c.i // {FAN} END,
      CASE WHEN r.tree IS NULL THEN 0 ELSE c.level + 1 END,
      CASE WHEN r.tree IS NULL THEN 1 ELSE c.part END,
      CASE WHEN r.tree IS NULL THEN c.folded
        ELSE sha256(array_to_string(r.held[:c.i % {FAN}], '') || c.folded || array_to_string(r.held[c.i % {FAN} + 2:], '')) END,
      CASE WHEN r.tree IS NULL THEN c.proof
        ELSE c.proof || array_to_string(r.held[:c.i % {FAN}], '') || array_to_string(r.held[c.i % {FAN} + 2:], '') END
    FROM climb c LEFT JOIN runs r ON r.tree = c.spot AND r.level = c.level AND r.run = c.i // {FAN}
    LEFT JOIN subroots s ON s.tree = c.tree
    WHERE r.tree IS NOT NULL OR c.part = 0),
  finished AS (
    SELECT * FROM climb
    QUALIFY row_number() OVER (PARTITION BY tree, own ORDER BY part DESC, level DESC) = 1),
  root AS (SELECT hash AS root FROM crown WHERE n = 1)
SELECT o.doc_id, o.leaf, s.hash AS subroot, root.root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root,
  f.folded = root.root AS verified
FROM ordered o JOIN finished f ON f.tree = o.tree AND f.own = o.i JOIN subroots s ON s.tree = o.tree, root
"""
