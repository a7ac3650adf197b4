"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Three errors over three segments
leave one of these cases, and each has a key that both sides share:

* two segments without error: the key is both segments as they are;
* one without error and one with a single error: the exact segment and a Golay codeword index of
  the other;
* one error in each: codeword indices of the first two and the error-free half of the third.

A segment, padded to 23 bits, decodes to the one codeword of the perfect Golay code within three
bits. A neighbour at one bit decodes to the same codeword or to one of a few others; a probe
carries all of them (one or up to six), the indexed side only its own. Candidates share a key of
33 bits or more and are verified by their Hamming distance.

Nulls: a null text counts as empty, its fingerprint is zero and is linked like any other; a null id
is never the smallest of a component unless all are. Repeated rows share their component. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.base import components, release, staged

SHINGLE = 3
SEED = 42
MAX_BITS = 3
WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)
GENERATOR = 0b101011100011  # of the (23, 12) Golay code


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    n = max(1, len(words) - SHINGLE + 1)
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # the unpacked bits of a long text never exist at once
        part = hashed[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        found = np.fromiter(
            (fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows
        )
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])


def _syndrome_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders modulo the generator of the high and low bits, and the error of each remainder."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    high = np.array([remainder(x << 11) for x in range(1 << 12)], np.int32)
    errors = np.zeros(1 << 11, np.int32)
    units = [1 << i for i in range(23)]
    for a in range(23):
        errors[remainder(units[a])] = units[a]
        for b in range(a):
            errors[remainder(units[a] | units[b])] = units[a] | units[b]
            for c in range(b):
                errors[remainder(units[a] | units[b] | units[c])] = units[a] | units[b] | units[c]
    return high, np.arange(1 << 11, dtype=np.int32), errors


_TABLES: list = []


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    if not _TABLES:
        _TABLES.extend(_syndrome_tables())
    high, low, errors = _TABLES
    return (words ^ errors[high[words >> 11] ^ low[words & 0x7FF]]) >> 11


def nearby(words: np.ndarray, width: int) -> list[np.ndarray]:
    """Columns of codeword indices of the word and of its neighbours at one bit; -1 where repeated."""
    every = np.stack([decode(words), *(decode(words ^ (1 << i)) for i in range(width))], axis=1)
    every.sort(axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    every[:, ::-1].sort(axis=1)
    used = int((every >= 0).sum(axis=1).max()) if len(every) else 0
    return [every[:, i] for i in range(used)]


def keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and their keys, a few for the index and all that a near fingerprint may have for a probe."""
    parts = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    near = [nearby(p, w) if probe else [decode(p)] for p, w in zip(parts, WIDTHS)]
    rows = np.arange(len(fps))
    out_rows, out_keys, kind = [], [], 0

    def put(valid: np.ndarray, key: np.ndarray) -> None:
        at = np.flatnonzero(valid)
        out_rows.append(rows[at])
        out_keys.append((kind << 48) | key[at])

    always = np.ones(len(fps), bool)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        put(always, (parts[a] << WIDTHS[b]) | parts[b])
        kind += 1
    for a in range(3):
        for b in range(3):
            if a != b:
                for c in near[b]:
                    put(c >= 0, (parts[a] << 12) | c)
                kind += 1
    for half in (parts[2] >> 10, parts[2] & 0x3FF):
        for a in near[0]:
            for b in near[1]:
                put((a >= 0) & (b >= 0), (half << 24) | (a << 12) | b)
        kind += 1
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _keyed(probe: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = np.asarray(batch.column("fp").slice(at, 4096)).view(np.uint64)
                rows, found = keys(fps, probe)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fps.view(np.int64)[rows])], names=["k", "fp"])

    return emit


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, fp): every text's fingerprint as a signed long."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_fingerprints, f"id {kind}, fp long")


def near_links(fps: DataFrame) -> DataFrame:
    """Pairs (src, dst) of different fingerprints that differ in at most three bits, each once."""
    probes = fps.mapInArrow(_keyed(True), "k long, fp long").alias("p")
    index = fps.mapInArrow(_keyed(False), "k long, fp long").alias("i")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= MAX_BITS
    found = probes.join(index, (F.col("p.k") == F.col("i.k")) & (F.col("p.fp") < F.col("i.fp")) & near)
    return found.select(F.col("p.fp").alias("src"), F.col("i.fp").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, fp, component): component is the smallest id reachable over links, the own one included.

    Equal fingerprints meet first, so copies never pair up with each other; links and components
    are found among different fingerprints only.
    """
    own = staged(fingerprints(docs, id_col, text), "fingerprints")
    classes = staged(own.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(near_links(classes.select("fp")))
    classes = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    lowest = classes.groupBy("root").agg(F.min("least").alias("component"))
    named = classes.join(lowest, "root").select("fp", "component")
    return own.join(named, "fp").select("id", "fp", "component")


def simhash_components(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# -- the same in SQL, by all pairs of fingerprints: for small tables only --------------------------------

# The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_MASK = (1 << 64) - 1


def _mod(x: str) -> str:
    return f"(({x}) & {_MASK}::UHUGEINT)"


def _rotated(x: str, n: int) -> str:
    return _mod(f"(({x}) << {n}) | (({x}) >> {64 - n})")


def _round(acc: str, lane: str) -> str:
    return _mod(f"{_rotated(_mod(f'{acc} + {lane} * {PRIMES[1]}::UHUGEINT'), 31)} * {PRIMES[0]}::UHUGEINT")


def xxh64_sql(source: str) -> str:
    """SQL for rows (text, h) of a table with different texts: h their unsigned XXH64 under SEED."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in PRIMES)

    def lane(at: str, size: int) -> str:  # little-endian number from byte ``at`` of the hex text x
        return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"

    seeds = [(SEED + PRIMES[0] + PRIMES[1]) & _MASK, (SEED + PRIMES[1]) & _MASK, SEED, (SEED - PRIMES[0]) & _MASK]
    own = "(SELECT text, hex(encode(text)) AS x, octet_length(encode(text))::BIGINT AS n FROM " + source + ")"
    stripes = ", ".join(
        f"list_reduce(list_prepend({seed}::UHUGEINT, list_transform(range(0, n // 32), lambda i: {lane(f'32 * i + {8 * k}', 8)})), "
        f"lambda a, b: {_round('a', 'b')}) AS v{k}" for k, seed in enumerate(seeds)
    )
    own = f"(SELECT *, {stripes} FROM {own})"
    own = f"(SELECT *, {_mod(' + '.join(_rotated(f'v{k}', r) for k, r in enumerate((1, 7, 12, 18))))} AS h FROM {own})"
    for k in range(4):
        own = f"(SELECT * REPLACE ({_mod(f'xor(h, {_round('0::UHUGEINT', f'v{k}')}) * {p1} + {p4}')} AS h) FROM {own})"
    own = f"(SELECT * REPLACE ({_mod(f'CASE WHEN n < 32 THEN {SEED}::UHUGEINT + {p5} ELSE h END + n::UHUGEINT')} AS h), n // 32 * 32 AS done FROM {own})"
    step = _mod(f"{_rotated(f'xor(a, {_round('0::UHUGEINT', 'b')})', 27)} * {p1} + {p4}")
    lanes = f"list_transform(range(0, (n - done) // 8), lambda i: {lane('done + 8 * i', 8)})"
    own = f"(SELECT * REPLACE (list_reduce(list_prepend(h, {lanes}), lambda a, b: {step}) AS h, done + (n - done) // 8 * 8 AS done) FROM {own})"
    four = _mod(f"{_rotated(f'xor(h, {_mod(f'{lane('done', 4)} * {p1}')})', 23)} * {p2} + {p3}")
    own = f"(SELECT * REPLACE (CASE WHEN n - done >= 4 THEN {four} ELSE h END AS h, CASE WHEN n - done >= 4 THEN done + 4 ELSE done END AS done) FROM {own})"
    step = _mod(f"{_rotated(f'xor(a, {_mod(f'b * {p5}')})', 11)} * {p1}")
    tail = f"list_transform(range(done, n), lambda i: {lane('i', 1)})"
    own = f"(SELECT * REPLACE (list_reduce(list_prepend(h, {tail}), lambda a, b: {step}) AS h) FROM {own})"
    for shift, prime in ((33, p2), (29, p3)):
        own = f"(SELECT * REPLACE ({_mod(f'xor(h, h >> {shift}) * {prime}')} AS h) FROM {own})"
    return f"SELECT text, xor(h, h >> 32)::UBIGINT AS h FROM {own}"


_BITS = ", ".join(f"2 * sum((h >> {b}) & 1) > count(*) AS b{b}" for b in range(64))
SQL = f"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS row, doc_id,
      list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
  shingles AS (
    SELECT row, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS text FROM texts, unnest(range(1, greatest(len(words) - {SHINGLE - 2}, 2))) AS r(i)
    WHERE len(words) > 0),
  different AS (SELECT DISTINCT text FROM shingles),
  hashed AS MATERIALIZED ({xxh64_sql("different")}),
  voted AS (SELECT row, {_BITS} FROM shingles JOIN hashed USING (text) GROUP BY row),
  prints AS (
    SELECT t.row, doc_id, coalesce({' + '.join(f'b{b}::UBIGINT * {1 << b}::UBIGINT' for b in range(64))}, 0)::UBIGINT AS fp
    FROM texts t LEFT JOIN voted USING (row)),
  classes AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
  links AS (SELECT a.fp AS src, b.fp AS dst FROM classes a JOIN classes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::BIT) <= {MAX_BITS}),
  reach(fp, seen) AS (SELECT fp, fp FROM classes UNION SELECT r.fp, l.dst FROM reach r JOIN links l ON l.src = r.seen),
  lowest AS (SELECT r.fp, min(c.least) AS component_id FROM reach r JOIN classes c ON c.fp = r.seen GROUP BY r.fp)
SELECT doc_id, lower(printf('%016x', fp)) AS fingerprint, component_id FROM prints JOIN lowest USING (fp)
"""
