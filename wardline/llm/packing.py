"""Best-fit packing of documents into sequences of fixed capacity by bin completion.

Only lengths decide where a piece goes, and there are no more different lengths than the capacity.
So Spark counts pieces per length, the search runs on that bounded histogram, and its plan (kinds
of sequences with how often each occurs) is applied to all pieces by their rank within a length.

Nulls: a null text counts as empty and still has its closing id; a null id is kept. Very long texts
are cut at the capacity. Repeated rows are pieces of their own. Ties are settled by id, piece and
checksum. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.base import byte_slices, staged
from wardline.llm.tokens import encoder

CAPACITY = 2048
CLOSING_ID = 0
# How many choices the search may take after its first descent before it keeps its best plan.
SEARCH = 2_000


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit, the closing id last.

    Without ids, their checksum ``ids_crc32`` stands in their place and they stay in the worker.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids, counts = encode(part.column("text"))
                yield _pieces(part.column("doc_id"), ids, counts, capacity, with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    last = "ids binary" if with_ids else "ids_crc32 long"
    return slim.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, {last}")


def _pieces(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, capacity: int, with_ids: bool) -> pa.RecordBatch:
    ends = np.cumsum(counts)
    closed = np.full(len(ids) + len(counts), CLOSING_ID, "<u4")
    own = np.ones(len(closed), bool)
    own[ends + np.arange(len(ends))] = False
    closed[own] = ids
    sizes = counts + 1
    n_pieces = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n_pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = piece * capacity
    length = np.minimum(capacity, sizes[doc] - start)
    bounds = np.concatenate([[0], np.cumsum(length) * 4])
    if with_ids:
        buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(closed)]
        name, last = "ids", pa.Array.from_buffers(pa.binary(), len(doc), buffers)
    else:
        raw, at = memoryview(closed).cast("B"), bounds.tolist()
        name, last = "ids_crc32", pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64())
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), last],
        names=["doc_id", "piece", "start", "length", name],
    )


# -- the search over the histogram -------------------------------------------------------------

Kind = tuple[tuple[int, int], ...]  # ((length, times), ...), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: total length, or long pieces that cannot share plus what they leave over."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for least in sorted({n for n in counts if 2 * n <= capacity} | {1}):
        alone = sum(c for n, c in counts.items() if n > capacity - least)
        halves = {n: c for n, c in counts.items() if capacity - least >= n and 2 * n > capacity}
        small = sum(n * c for n, c in counts.items() if least <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in halves.items())
        best = max(best, alone + sum(halves.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Kind, int]]:
    """Longest first, each piece into the fullest sequence it fits; equal sequences are handled together."""
    rooms: dict[int, dict[Kind, int]] = {}  # by room left, what has that much and how often
    open_rooms = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = open_rooms >> length
            if fit:
                room = length + (fit & -fit).bit_length() - 1
                kind, copies = rooms[room].popitem()
                per = min(room // length, left)
                taken = min(left // per, copies)
                if taken < copies:
                    rooms[room][kind] = copies - taken
                if not rooms[room]:
                    open_rooms ^= 1 << room
            else:
                room, kind = capacity, ()
                per = min(room // length, left)
                taken = left // per
            room -= per * length
            new = (*kind, (length, per))
            held = rooms.setdefault(room, {})
            held[new] = held.get(new, 0) + taken
            open_rooms |= 1 << room
            left -= per * taken
    return [(kind, n) for held in rooms.values() for kind, n in held.items()]


class _Pieces:
    """How many pieces of every length are left, changed in place."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.of = [0] * (capacity + 1)
        for length, n in counts.items():
            self.of[length] = n
        self.total = sum(n * c for n, c in counts.items())
        self.lengths = sorted((n for n, c in counts.items() if c), reverse=True)
        self.first = 0  # of the lengths, all before it are used up

    def take(self, kind: Kind, copies: int) -> None:
        for length, times in kind:
            self.of[length] -= times * copies
            self.total -= length * times * copies
        while self.first < len(self.lengths) and not self.of[self.lengths[self.first]]:
            self.first += 1

    def put_back(self, kind: Kind, copies: int) -> None:
        for length, times in kind:
            self.of[length] += times * copies
            self.total += length * times * copies
        while self.first and self.of[self.lengths[self.first - 1]]:
            self.first -= 1
        self.first = min(self.first, next((k for k, n in enumerate(self.lengths) if self.of[n]), len(self.lengths)))

    def counts(self) -> dict[int, int]:
        return {n: self.of[n] for n in self.lengths if self.of[n]}


def fillings(pieces: _Pieces, longest: int, capacity: int) -> Iterator[Kind]:
    """Undominated fillings of a sequence with one piece of length ``longest``, that piece included, fullest first.

    Which sums the lengths from some point on can still reach is one number with a bit per sum, so
    the enumeration never enters a branch without a filling of the sum it looks for.
    """
    room = capacity - longest
    have: list[tuple[int, int]] = []
    for length in pieces.lengths[pieces.first :]:
        n = pieces.of[length] - (length == longest)
        if n and length <= room:
            have.append((length, min(n, room // length)))
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for length, most in reversed(have):
        sums, step = reach[-1], 1
        while most:  # 1, 2, 4, ... and the rest together give every number of copies
            step = min(step, most)
            sums |= (sums << (step * length)) & mask
            most, step = most - step, step * 2
        reach.append(sums)
    reach.reverse()

    def exactly(target: int) -> Iterator[Kind]:
        stack = [(0, target, ())]
        while stack:
            at, left, kind = stack.pop()
            if not left:
                yield kind
                continue
            while not (at < len(have) and have[at][0] <= left):
                at += 1
            length, most = have[at]
            for times in range(min(most, left // length) + 1):
                rest = left - times * length
                if reach[at + 1] >> rest & 1:
                    stack.append((at + 1, rest, (*kind, (length, times)) if times else kind))

    open_sums = reach[0]
    while open_sums:
        target = open_sums.bit_length() - 1
        open_sums ^= 1 << target
        for kind in exactly(target):
            if not _dominated(kind, room - target, pieces, longest):
                whole = dict(kind)
                whole[longest] = whole.get(longest, 0) + 1
                yield tuple(sorted(whole.items(), reverse=True))


def _dominated(kind: Kind, waste: int, pieces: _Pieces, longest: int) -> bool:
    """Whether a piece left out fits in place of some of the filling's that are together no longer.

    Those of equal length count only where they are two pieces or more; none at all, where it fits beside.
    """
    used, sums, several = dict(kind), 1, 0
    for length, times in kind:
        for _ in range(times):
            several |= (several << length) | ((sums ^ 1) << length)
            sums |= sums << length
    longer, width = sums << 1, 1  # what is longer than a sum by 1 to ``waste``
    while width < waste:
        grow = min(width, waste - width)
        longer |= longer << grow
        width += grow
    better = several | (longer if waste else 0)
    for length in pieces.lengths[pieces.first :]:
        if better >> length & 1 and pieces.of[length] - (length == longest) > used.get(length, 0):
            return True
    return False


def complete(counts: dict[int, int], capacity: int, search: int = SEARCH) -> list[tuple[Kind, int]]:
    """Bin completion: fill the sequence of the longest piece, repeat that filling as often as pieces last, go on.

    Depth first, fullest fillings first, most copies first. The first descent is taken to its end; its
    plan replaces the best-fit plan unless that has fewer sequences. From then on a branch ends when the
    sequences so far and the bound of what is left, the waste so far included in it, cannot beat the
    best plan, and best fit of what is left after every further choice is an incumbent. ``search``
    bounds the choices taken after the first descent, whatever the number of lengths; every piece is
    in whatever plan comes out.
    """
    return search_plan(counts, capacity, search)[0]


def search_plan(counts: dict[int, int], capacity: int, search: int = SEARCH) -> tuple[list[tuple[Kind, int]], dict[str, int]]:
    """The plan, and what the search did: its bound, the best-fit plan's size, nodes and fillings."""
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    done = {"bound": lower_bound(counts, capacity), "best_fit": size, "nodes": 0, "fillings": 0, "after_descent": 0}
    if not counts:
        return [], done
    pieces = _Pieces(counts, capacity)
    plan: list[tuple[Kind, int]] = []
    used, descended = 0, False

    def choices() -> Iterator[tuple[Kind, int]]:
        longest = pieces.lengths[pieces.first]
        for kind in fillings(pieces, longest, capacity):
            done["fillings"] += 1
            for copies in range(min(pieces.of[n] // k for n, k in kind), 0, -1):
                yield kind, copies

    stack = [choices()]
    while stack and not (descended and (size <= done["bound"] or done["after_descent"] > search)):
        choice = next(stack[-1], None)
        if choice is None:
            stack.pop()
            if plan and stack:
                kind, copies = plan.pop()
                pieces.put_back(kind, copies)
                used -= copies
            continue
        kind, copies = choice
        done["nodes"] += 1
        done["after_descent"] += descended
        pieces.take(kind, copies)
        plan.append(choice)
        used += copies
        keep = True
        if not pieces.total:
            if used < size or not descended and used == size:
                best, size = list(plan), used
            descended, keep = True, False
        elif descended:
            if used + -(-pieces.total // capacity) >= size:
                keep = False
            else:
                tail = best_fit(pieces.counts(), capacity)
                if used + sum(n for _, n in tail) < size:
                    best, size = plan + tail, used + sum(n for _, n in tail)
        if keep:
            stack.append(choices())
        else:
            plan.pop()
            pieces.put_back(kind, copies)
            used -= copies
    return best, done


# -- applying the plan ---------------------------------------------------------------------------


def intervals(plan: list[tuple[Kind, int]]) -> dict[str, np.ndarray]:
    """Per kind and length: the ranks it takes and where they go, sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for kind, copies in plan:
        offset = 0
        for length, times in kind:
            first = taken.get(length, 0)
            rows.append((length, first, base, times, offset))
            taken[length] = first + times * copies
            offset += length * times
        base += copies
    rows.sort()
    return dict(zip(("length", "first", "base", "times", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, search: int = SEARCH) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice, so pass a stored frame; ``order`` names columns that tell its rows
    apart. A length may hold any share of the rows: ranks are counted within hash buckets of a
    length and shifted by the buckets before.
    """
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counted = staged(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = intervals(complete(histogram, capacity, search))
    shift = F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")
    shifts = counted.select("length", "_bucket", shift.alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = keyed.withColumn("_rank", rank).join(shifts, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_shift")).cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = (at["length"] << 44) | at["first"]
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("_rank"))
            i = np.searchsorted(bounds, (length << 44) | rank, side="right") - 1
            copy, nth = np.divmod(rank - at["first"][i], at["times"][i])
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_rank"]
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at["base"][i] + copy), pa.array(at["offset"][i] + nth * length)],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, search: int = SEARCH) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece."""
    cut = cut_documents(docs.select("doc_id", "text"), vocabulary, capacity, with_ids=False)
    return pack_pieces(staged(cut, "pieces"), ["doc_id", "piece", "ids_crc32"], capacity, search)


def sequences(pieces: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """The packed sequences themselves: rows (sequence_id, length, ids), pieces joined at their offsets."""
    joined = pieces.join(placed.select(*keys, "sequence_id", "offset"), keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    blob = F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("length"), blob.alias("ids"))
