"""SimHash near-dedup against all pairs of fingerprints."""

import numpy as np
import pytest
import xxhash
from wardline.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in raw).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashed) > len(hashed))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(
        ((d, format(f, "016x"), least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str
    )


def result(df):
    return sorted((tuple(r) for r in simhash.simhash_components(df).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs) == plain_components(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "ONE"), (5, "one two"), (None, "one"), (6, "Straße ÀÉ x"),
        (7, "a b c " * 20_000), (8, "x"),
    ]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, fp string, k int")
    assert result(docs) == plain_components(rows)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_every_pattern_of_three_errors_shares_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    _, own = simhash.keys(base, probe=False)
    rows, probes = simhash.keys(base, probe=True)
    held = [set(probes[rows == i].tolist()) for i in range(len(base))]
    for _ in range(3000):
        i = int(rng.integers(len(base)))
        other = base[i]
        for bit in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            other ^= np.uint64(1) << np.uint64(bit)
        _, index = simhash.keys(np.array([other]), probe=False)
        assert held[i] & set(index.tolist())


@pytest.mark.parametrize("width", [21, 22])
def test_decoding_is_nearest(width):
    words = np.random.default_rng(2).integers(0, 1 << width, 500)
    index = simhash.decode(words)
    again = simhash.decode(index << 11)  # a message part alone is within reach of some codeword
    assert len(again) == len(index)
    for word in words[:50]:
        near = {int(simhash.decode(np.array([word ^ (1 << i)]))[0]) for i in range(width)}
        got = {int(c[0]) for c in simhash.nearby(np.array([word]), width) if c[0] >= 0}
        assert got == near | {int(simhash.decode(np.array([word]))[0])}
        assert len(got) <= 6
