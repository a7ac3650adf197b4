"""The manifest against a plain tree, the log against a recursive postorder walk, proofs by address."""

import zlib
from hashlib import sha256

import pytest
from wardline.llm import merkle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row, lower=False):
    text = row.text
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[k : k + 8])) for k in range(0, len(below), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        run = level[first : first + 8]
        out.append((run[: i - first], run[i - first + 1 :]))
        i //= 8
    return out


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row.lang, []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        built[name] = own, plain_levels([plain_leaf(r) for r in own])
    crown = plain_levels([built[name][1][-1][0] for name in names])
    root, out = crown[-1][0], []
    for t, name in enumerate(names):
        own, levels = built[name]
        for i, row in enumerate(own):
            path = plain_path(levels, i) + plain_path(crown, t)
            hit = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 3 == 0
            now = plain_leaf(row, lower=hit)
            for before, after in path:
                now = digest("".join(before) + now + "".join(after))
            proof = digest("".join(x for pair in path for side in pair for x in side))
            out.append((row.doc_id, levels[0][i], levels[-1][0], root, proof, now, now == root))
    return out


def same(got, want):
    def key(r):
        return [str(x) for x in r]

    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(merkle.manifest(docs).collect(), plain_manifest(docs.collect()))


def test_several_rounds_of_builders(spark):
    docs = spark.range(1300).selectExpr(
        "id AS doc_id", "'s' AS source", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 31 = 0 THEN concat('é', id % 10) ELSE 'en' END AS lang",
        "id AS n_chars", "concat('Text ', id) AS text",
    )
    same(merkle.manifest(docs).collect(), plain_manifest(docs.collect()))


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "a", None, 1, "b"), (1, "a", "en", 0, ""), (1, "a", "en", 0, ""), (1, "A", "en", 0, "Z"),
        (2, "-", "", 5, "É ABC" * 20_000), (3, "1:x", "zz", -7, "no capitals"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DOCS + ", i int, tree int, hash string")
    got = merkle.manifest(docs).collect()
    same(got, plain_manifest(docs.collect()))
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = merkle.manifest(docs.where("doc_id = 3")).collect()[0]
    assert one.leaf == one.subroot == one.root


def test_offsets_are_stored_in_a_file_per_tree(spark, monkeypatch):
    """Not in one per task of the counts: each file costs an executor several processes where Hadoop has no native code."""
    held, stage = {}, merkle.staged
    monkeypatch.setattr(merkle, "staged", lambda df, name: held.setdefault(name, stage(df, name)))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(600).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS tree")
        found = merkle.numbered(rows, ["doc_id"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.doc_id, r.i, r.n) for r in found} == {
        (d, d // 3 if d % 3 == 0 else d - d // 3 - 1, 200 if d % 3 == 0 else 400) for d in range(600)
    }
    assert len(held["manifest-order"].inputFiles()) > 20
    rest = [f for name, f in held.items() if name not in ("manifest-order", "manifest-leaves")]
    assert rest and all(len(f.inputFiles()) <= 3 for f in rest)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 511, 512, 513, 600])
def test_positions_are_those_of_a_postorder_walk(n):
    order = []

    def walk(level, j):
        if level:
            for child in range(8 * j, min(8 * j + 8, -(-n // 8 ** (level - 1)))):
                walk(level - 1, child)
        order.append((level, j))

    walk(merkle.height(n), 0)
    assert [merkle.position(level, j, n) for level, j in order] == list(range(len(order)))


def test_log_and_proofs_by_address(spark):
    n = 5000
    leaves = [digest(str(i)) for i in range(n)]
    frame = spark.createDataFrame([("1en", n, i, bytes.fromhex(h)) for i, h in enumerate(leaves)], "tree string, n long, i long, hash binary")
    rounds = merkle.build(frame)
    log = {r.position: r.hash.hex() for r in merkle.append_log(rounds).collect()}
    levels = plain_levels(leaves)
    assert sorted(log) == list(range(sum(map(len, levels))))
    for level, nodes in enumerate(levels):
        for j, h in enumerate(nodes):
            assert log[merkle.position(level, j, n)] == h
    for i in (0, 7, 4095, 4999):
        got = [([log[p] for p in before], [log[p] for p in after]) for _, before, after in merkle.siblings(i, n)]
        assert got == plain_path(levels, i)
