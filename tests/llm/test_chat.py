"""Chat formatting: exact round trips and digests from the turns themselves."""

import hashlib
import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from oracle_compare import compare, connect
from wardline.llm import catalog, chat

SF = "/root/testdata/sf0.001"


def want(turns):
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def got(df):
    formatted = chat.format_conversations(df)
    spans = {r.conv_id: r for r in formatted.collect()}
    for r in spans.values():
        at = 0
        for s in r.loss_spans:
            assert at <= s.start <= s.end <= len(r.formatted)
            at = s.end
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digests(formatted).collect()}


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    found = {r.conv_id: tuple(r)[1:5] for r in catalog.op5_chat_formatting(spark, SF).collect()}
    assert found == {c: want(t) for c, t in by_conversation(rows).items()}


def test_query_matches_sql(spark):
    _, problem = compare(catalog.op5_chat_formatting(spark, SF), connect(SF), catalog.sql_texts()["op5_chat_formatting"])
    assert not problem, problem


def test_odd_rows(spark):
    rng = random.Random(3)
    bits = [*chat.CONTROL, "\\", "<", "[", "|>", "/", "é", "日", "\n", "", "s>", "turn|>", "\U0001f600"]
    rows = [(c, t, rng.choice(["user", "assistant", "<|text|>x", None, ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (70, None, "user", None), (70, 2, "assistant", None)]
    rows += [(71, 1, "assistant", "same"), (71, 1, "assistant", "same"), (72, 1, "assistant", "long \\ <s>" * 50_000)]
    rows += [(73, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = got(df.where("conv_id IS NOT NULL"))
    wanted = {c: want(t) for c, t in by_conversation(rows).items() if c is not None}
    assert {c: r[:4] for c, r in found.items()} == wanted
    for r in chat.format_conversations(df.where("conv_id IS NOT NULL")).collect():
        assert chat.read_back(r.formatted) == by_conversation(rows)[r.conv_id]
    alone = chat.digests(chat.format_conversations(df)).where("conv_id IS NULL").collect()  # a conversation a turn
    assert sorted(tuple(r)[1:5] for r in alone) == sorted([want([("user", "a")]), want([("assistant", "b")])])


def test_buffer_is_filled_in_bounded_pieces(spark, monkeypatch):
    rows = [(c, t, "assistant", "é" * (c * 7 % 50) + "long" * (500 * (c == 3))) for c in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "SCATTER_BYTES", 64)
    batch = df.toArrow()
    formatted, _, _ = chat.assemble(batch.column("role").combine_chunks(), batch.column("text").combine_chunks(), np.arange(0, 120, 4))
    turns = by_conversation(rows)
    assert [chat.read_back(x.as_py()) for x in formatted] == [turns[c] for c in range(30)]


def test_sql_takes_rows_without_a_conversation_or_a_turn_alike(spark, tmp_path):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, "assistant", "c"), (1, None, "system", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/t")
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/t/*.parquet')")
    own = chat.digests(chat.format_conversations(chat.fixed_conversation(df)))
    _, problem = compare(own, con, chat.SQL)
    assert not problem, problem


def test_small_batches_cut_no_conversation(spark):
    rows = [(c, t, "assistant", f"{c}-{t}") for c in range(20) for t in range(17)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {c: r[:4] for c, r in got(df).items()} == {c: want(t) for c, t in by_conversation(rows).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}
