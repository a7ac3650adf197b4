"""Packing: plans against exhaustive search, and the placing of every piece."""

import itertools
import random
import zlib
from collections import Counter
from functools import lru_cache

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer
from wardline.llm import packing

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    @lru_cache(None)
    def best(left, room):
        if not left:
            return 0
        out = len(left)
        for i in sorted({left.index(n) for n in left}):
            rest, n = left[:i] + left[i + 1 :], left[i]
            out = min(out, best(rest, room - n) if n <= room else 1 + best(rest, capacity - n))
        return out

    return best(tuple(sorted(lengths, reverse=True)), 0)


def check(plan, counts, capacity):
    used = Counter()
    for kind, copies in plan:
        assert copies > 0 and sum(n * k for n, k in kind) <= capacity
        for n, k in kind:
            used[n] += k * copies
    assert used == Counter(counts)


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_as_small_as_possible(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    lengths = [rng.randint(1, capacity) if seed % 2 else rng.randint(capacity // 5 + 1, capacity // 2 + 1) for _ in range(rng.randint(1, 8))]
    counts = Counter(lengths)
    plan = packing.complete(counts, capacity)
    check(plan, counts, capacity)
    size = sum(n for _, n in plan)
    assert size == fewest(lengths, capacity) >= packing.lower_bound(counts, capacity)


def test_search_beats_best_fit():
    # Best fit pairs 6+4 and wastes the rest; the optimum is 6+2+2, 5+5, 4+3+3.
    counts = {6: 1, 5: 2, 4: 1, 3: 2, 2: 2}
    plan = packing.complete(counts, 10)
    check(plan, counts, 10)
    assert sum(n for _, n in plan) == 3


@pytest.mark.parametrize("seed", range(25))
def test_fillings_are_the_undominated_ones(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 20, 31])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
    longest = max(counts)
    rest = Counter(counts)
    rest[longest] -= 1
    lengths = [n for n in rest if rest[n]]
    want = set()
    for times in itertools.product(*[range(rest[n] + 1) for n in lengths]):
        own = {n: t for n, t in zip(lengths, times) if t}
        waste = capacity - longest - sum(n * t for n, t in own.items())
        if waste < 0:
            continue
        subsets = itertools.product(*[range(t + 1) for t in own.values()])
        sums = {(sum(k * n for k, n in zip(ks, own)), sum(ks)) for ks in subsets}
        spare = [n for n in lengths if rest[n] > own.get(n, 0)]
        if not any(s <= x <= s + waste and (k != 1 or s != x) for x in spare for s, k in sums):
            whole = Counter(own)
            whole[longest] += 1
            want.add(tuple(sorted(whole.items(), reverse=True)))
    got = list(packing.fillings(packing._Pieces(counts, capacity), longest, capacity))
    assert set(got) == want and len(got) == len(want)
    filled = [sum(n * t for n, t in kind) for kind in got]
    assert filled == sorted(filled, reverse=True)


def test_search_closes_a_gap_over_all_lengths():
    rng = random.Random(1)
    counts = Counter(max(1, min(2048, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(300_000))
    for n in range(1, 2049):
        counts[n] += 1
    plan, done = packing.search_plan(counts, 2048)
    check(plan, counts, 2048)
    assert sum(n for _, n in plan) == done["bound"] <= done["best_fit"]
    triples = Counter()
    for _ in range(4000):
        a = rng.randint(513, 1000)
        b = rng.randint(513, max(513, 2048 - a - 513))
        triples.update((a, b, 2048 - a - b))
    plan, done = packing.search_plan(triples, 2048)
    check(plan, triples, 2048)
    assert sum(n for _, n in plan) <= 4100 < 4400 < done["best_fit"]


def test_plan_comes_from_completion():
    counts = Counter({2048: 3, 1500: 4, 548: 4, 700: 9, 648: 18, 5: 100})
    plan, done = packing.search_plan(counts, 2048)
    check(plan, counts, 2048)
    assert done["fillings"] and done["nodes"] and sum(n for _, n in plan) <= done["best_fit"]


def test_many_pieces_of_few_lengths():
    counts = {2048: 10**9, 1500: 3 * 10**8, 600: 10**9, 548: 10**8, 7: 5 * 10**9, 1: 12345}
    plan = packing.complete(counts, 2048)
    check(plan, counts, 2048)
    assert len(plan) < 100
    assert packing.complete({}, 2048) == []


def placed_well(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack_documents(docs, WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    counts = Counter()
    pieces = {(r.doc_id, r.piece): r for r in got}
    assert len(pieces) == len(got)
    for r in docs.collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            own = pieces.pop((r.doc_id, piece))
            raw = b"".join(i.to_bytes(4, "little") for i in part)
            assert (own.start, own.length, own.ids_crc32) == (start, len(part), zlib.crc32(raw))
            counts[len(part)] += 1
    assert not pieces
    assert placed_well(got, 2048) <= packing.lower_bound(counts, 2048) + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "a " * 5000), (4, "日本" * 4000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, _rank int")
    got = packing.pack_documents(df, WORDS).collect()
    assert sum(r.length == 1 for r in got) == 3
    placed_well(got, 2048)
    assert packing.pack_documents(df.limit(0), WORDS).collect() == []


def test_one_length_for_nearly_all(spark):
    pieces = spark.range(20_000).selectExpr("id", "IF(id % 50 = 0, 1 + id % 13, 5L) AS length")
    got = packing.pack_pieces(pieces, ["id"], 25).collect()
    assert len(got) == 20_000
    total = sum(r.length for r in got)
    assert placed_well(got, 25) <= -(-total // 25) + 1


def test_sequences_hold_their_pieces(spark):
    df = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(40)], "doc_id long, text string")
    cut = packing.cut_documents(df, WORDS, 16)
    placed = packing.pack_pieces(cut.drop("ids"), ["doc_id", "piece"], 16)
    for r in packing.sequences(cut, placed, ["doc_id", "piece"]).collect():
        assert len(r.ids) == 4 * r.length <= 64
