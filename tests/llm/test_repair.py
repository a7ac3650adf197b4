"""Conversation repair against a textbook CYK over all splits, an exhaustive search, and plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from wardline.llm import repair

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def all_splits(kinds):
    """Every span from every split of it, by span length."""
    n = len(kinds)
    cell = {(i, i + 1): repair.row_cell(k) for i, k in enumerate(kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            best = {}
            for split in range(i + 1, i + size):
                for pq, own in repair.join(cell[i, split], cell[split, i + size]).items():
                    best[pq] = min(best.get(pq, own), own)
            cell[i, i + size] = best
    return repair.whole(cell[0, n] if n else repair.INSERTED)


def exhaustive(kinds, most=2):
    """All edits with at most ``most`` insertions before each row and at the end."""
    best = None
    gaps = ["", *("".join(x) for k in range(1, most + 1) for x in itertools.product("ua", repeat=k))]
    for inserts in itertools.product(gaps, repeat=len(kinds) + 1):
        for letters in itertools.product("KRD", repeat=len(kinds)):
            options = [("",)]
            cost, audit = 0, ""
            for put, letter, kind in zip(inserts, [*letters, ""], [*kinds, ""]):
                cost, audit = cost + 2 * len(put), audit + "I" * len(put) + letter
                options.append((put,))
                if letter == "D":
                    cost += 3
                elif letter and kind == "D":
                    break
                elif letter:
                    cost += (2 if letter == "R" else 0) + kind.isupper()
                    options.append(("u", "a") if letter == "R" else (kind.lower(),))
            else:
                if best is None or (cost, audit) < best:
                    if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*options)):
                        best = cost, audit
    return best


@pytest.mark.parametrize("seed", range(60))
def test_aligned_spans_are_enough(seed):
    rng = random.Random(seed)
    kinds = "".join(rng.choice("suaxSUAXD") for _ in range(rng.randint(0, 24)))
    assert repair.whole(repair.span_cell(kinds)) == all_splits(kinds)


@pytest.mark.parametrize("kinds", ["", *"suaxUAD", "ua", "au", "su", "uu", "aa", "ss", "xD", "uA", "sua", "uau", "Dau", "aus", "xxu", "uUa"])
def test_cheapest_of_all_edits(kinds):
    assert repair.whole(repair.span_cell(kinds)) == exhaustive(kinds)


def plain_result(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        role, text, hit = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if hit == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        own.extend([(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1))
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, *_ in own if t is not None}
        seen, kinds, count = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            kind = role[:1] if role[:1] in tuple("sua") else "x"
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            kinds += {"": kind, "t": kind.upper()}.get(fault, "D")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = all_splits(kinds)
        length = len(audit) - audit.count("D")
        wanted = ["system"] * (length % 2) + ["user", "assistant"] * (length // 2)
        lines, rows_left, k = [], iter(own), 0
        for letter in audit:
            row = next(rows_left) if letter != "I" else (None, "", "")
            if letter != "D":
                lines.append(f"{row[1] if letter == 'K' else wanted[k]}:{row[2]}")
                k += 1
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count["b"], count["d"], count["t"], illegal, cost, audit, sha))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, repair.repaired_conversations(df).collect()), key=str)


def test_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert result(df) == plain_result(list(map(tuple, df.collect())))


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, None, "user", ""), (1, 2, "", "No role"),
        (1, 2, "User", "x "), (1, 2, "tool", "done!\n\t"), (2, 5, "system", "a" * 300_000 + "."), (2, 7, "assistant", "b?"), (2, 5, "system", "S."),
        (3, 9, "assistant", "é。"), (-4, 0, "user", "q?"), (-4, 2**62, "assistant", "a."),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", copies int, cell string")
    assert result(df) == plain_result(rows)
    assert repair.repaired_conversations(df.limit(0)).collect() == []


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no", "well?", "", f"{i}!"])) for i in range(300)]
    df = spark.createDataFrame(rows + [(8, 1, "user", "x.")], TURNS).repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert result(df) == plain_result(rows + [(8, 1, "user", "x.")])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repaired_turns_fit_the_pattern(spark):
    held, parsed = repair.repair(repair.damaged(spark.read.parquet(f"{SF}/conversations.parquet")))
    digests = {r.conv_id: r.repaired_sha256 for r in repair.with_digests(held, parsed).collect()}
    by = {}
    for r in repair.repaired_turns(held, parsed).orderBy("conv_id", "seq").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, digest in digests.items():
        turns = by.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in turns))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == digest
