"""Chat formatting by columnar byte assembly.

A conversation becomes one string: per turn ``<|turn|>role<|text|>text<|end|>``. Control strings
inside roles and texts get a backslash after their first character and backslashes are doubled, so
no text can imitate a mark and everything can be read back. The loss mask covers what stands
between ``<|text|>`` and ``<|end|>`` of assistant turns.

Nulls: a null role or text counts as empty; a turn without a conversation id is a conversation of
its own; turns without a number come first. A conversation's formatted text has to fit into a string
of 2 GB; a longer one is an error that names it. Turns of equal number stand in the order of role
and text, repeated rows are turns of their own. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.base import spans_to_index, whole_runs

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Marks of this template and of others that a tokenizer may know.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINED_ROLE = "assistant"
SPANS = "array<struct<start:long,end:long>>"
MAX_BYTES = 64 << 20
SCATTER_BYTES = 4 << 20


def escape(col: pa.Array) -> pa.Array:
    col = pc.replace_substring(col, "\\", "\\\\")
    for mark in CONTROL:
        col = pc.replace_substring(col, mark, f"{mark[0]}\\{mark[1:]}")
    return col


_ESCAPE = re.compile(r"\\(\\)?")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group(1) or "", text)


def _raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and each value's start and length in bytes."""
    col = pa.concat_arrays([col.cast(pa.large_string())])
    bounds = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data, bounds[:-1], np.diff(bounds)


def _scatter(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All segments, one after the other, in one buffer; indices exist for SCATTER_BYTES of it at a time."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = 0
    while first < len(lengths):
        at = int(ends[first] - lengths[first])
        stop = max(first + 1, int(np.searchsorted(ends, at + SCATTER_BYTES, side="right")))
        if stop == first + 1:
            out[at : int(ends[first])] = source[starts[first] : starts[first] + lengths[first]]
        else:
            out[at : int(ends[stop - 1])] = source[spans_to_index(starts[first:stop], lengths[first:stop])]
        first = stop
    return out


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations, and start and end of every turn's text in characters of its conversation.

    ``first`` has the row at which each conversation starts. Segment lengths and their cumulative
    sums give every segment's place; marks, roles and texts are copied into one preallocated buffer.
    """
    n = len(roles)
    roles, texts = escape(roles), escape(texts)
    marks = np.frombuffer((TURN + TEXT + END).encode(), np.uint8)
    role_data, role_at, role_len = _raw(roles)
    text_data, text_at, text_len = _raw(texts)
    source = np.concatenate([marks, role_data, text_data])
    starts = np.empty((n, 5), np.int64)
    lengths = np.empty((n, 5), np.int64)
    for k, (at, size) in enumerate(
        (
            (0, len(TURN)),
            (len(marks) + role_at, role_len),
            (len(TURN), len(TEXT)),
            (len(marks) + len(role_data) + text_at, text_len),
            (len(TURN) + len(TEXT), len(END)),
        )
    ):
        starts[:, k], lengths[:, k] = at, size
    out = _scatter(source, starts.reshape(-1), lengths.reshape(-1))
    turn_ends = np.cumsum(lengths.sum(axis=1))
    bounds = np.concatenate([[0], turn_ends])[np.append(first, n)].astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    role_chars, text_chars = (np.asarray(pc.utf8_length(c)).astype(np.int64) for c in (roles, texts))
    size = len(TURN) + role_chars + len(TEXT) + text_chars + len(END)
    before = np.cumsum(size) - size
    own = before - np.repeat(before[first], np.diff(np.append(first, n)))
    begin = own + len(TURN) + role_chars + len(TEXT)
    return formatted, begin, begin + text_chars


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss_spans): spans of trained text in characters, in order."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_runs(batches, ["conv_id", "_alone"]):
            roles, texts = (pc.fill_null(table.column(c).combine_chunks(), "") for c in ("role", "text"))
            sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(first):  # bounded output per batch, whole conversations
                stop = at + 1
                while stop < len(first) and upto[first[stop]] - upto[first[at]] < MAX_BYTES // 4:
                    stop += 1
                low, high = int(first[at]), int(first[stop]) if stop < len(first) else table.num_rows
                some = first[at:stop] - low
                r, t = roles.slice(low, high - low), texts.slice(low, high - low)
                formatted, begin, end = assemble(r, t, some)
                trained = np.asarray(pc.equal(r, TRAINED_ROLE).to_numpy(zero_copy_only=False), bool)
                spans = pa.StructArray.from_arrays([pa.array(begin[trained]), pa.array(end[trained])], names=["start", "end"])
                held = np.concatenate([[0], np.cumsum(trained)])[np.append(some, high - low)].astype(np.int32)
                ids = table.column("conv_id").combine_chunks().take(pa.array(first[at:stop]))
                if formatted.nbytes >= (1 << 31) - 1:
                    raise ValueError(f"conversation {ids[0]} is longer than a string can be")
                yield pa.RecordBatch.from_arrays(
                    [ids, formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(held), spans)],
                    names=["conv_id", "formatted", "loss_spans"],
                )
                at = stop

    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_alone")
    slim = turns.select("conv_id", alone, "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = slim.repartition("conv_id", "_alone").sortWithinPartitions("conv_id", "_alone", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans {SPANS}")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(TURN).partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations and their masks say when read back, one row each."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted"), batch.column("loss_spans")):
                text = text.as_py()
                turns = read_back(text)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                loss = [unescape(text[s["start"] : s["end"]]) for s in spans.as_py()]
                trained = hashlib.sha256("".join(loss).encode())
                rows.append((len(turns), whole.hexdigest(), sum(map(len, loss)), trained.hexdigest(), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=["conv_id", *names])

    return formatted.mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def fixed_conversation(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -1, whose texts imitate control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, TRAINED_ROLE, said)]
    own = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)


def _escaped_length(column: str) -> str:
    """SQL for the length of an escaped value: one more character per backslash and per control string."""
    marks = " + ".join(f"(length({column}) - length(replace({column}, '{m}', ''))) // {len(m)}" for m in ("\\", *CONTROL))
    return f"(length({column}) + {marks})"


SQL = f"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role,
    coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, '{TRAINED_ROLE}', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id, alone
"""
