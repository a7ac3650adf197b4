"""Conversation structure repair by weighted CYK interval parsing.

The wanted role initials are ``(s?(ua)+)?``. Nonterminals N_pq stand for what leads from state p to
state q of that language: nothing said, system, user, assistant. The grammar is in Chomsky normal
form, N_pq -> N_pr N_rq, with a row's edits as terminal rules. A cell holds the smallest (cost, audit)
of each N_pq over a span of rows, closed under insertion on both sides. Cells of single rows are
combined bottom-up by span length.

Joining cells is associative in this grammar, so every way to split a span gives the same cell. Spans of
1, 2, 4, ... rows are enough, and a conversation may be cut anywhere: each task reduces the rows it has,
and a conversation's cells are joined in order. Costs depend on audit letters and rows alone, so no
audit of a cell is a proper prefix of another of equal cost and the least audit of the whole consists
of least audits of its spans.

A conversation may hold any share of the rows: faults and cells come from a range partitioning by
(conversation, turn, role, text). Only the hash of its repaired text is one task's work, as it has to
be, and streams; the audit, a letter a row or insertion, must fit into one string (2 GB).

Nulls: a null role or text is one space; a null turn comes first; rows without a conversation id form
one conversation. Rows of equal turn stand in the order of role, then of the text's sha256. A role
without characters has no initial and fits nowhere. Empty texts are blank. An empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.base import staged, whole_runs
from wardline.llm.merkle import _CRC, crc32_sql

SPACE = r"\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}
# State after nothing, a system, a user, an assistant row; what an initial does to it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": ((NOTHING, SYSTEM),), "u": ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
LEGAL = ("su", "ua", "au")
RETURNED = (
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
)

Cell = dict[tuple[int, int], tuple[int, str]]


# -- the grammar ---------------------------------------------------------------------------------------


def join(left: Cell, right: Cell) -> Cell:
    """The smallest (cost, audit) of N_pq -> N_pr N_rq for all states."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is None:
                continue
            total, known = cost + other[0], out.get((p, q))
            if known is None or total < known[0] or (total == known[0] and audit + other[1] < known[1]):
                out[p, q] = total, audit + other[1]
    return out


def _inserted() -> Cell:
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    once: Cell = {**{move: (2, "I") for role in ROLES for move in MOVES[role]}, **cell}
    while (more := join(cell, once)) != cell:
        cell = more
    return cell


INSERTED = _inserted()


@lru_cache(maxsize=64)
def row_cell(kind: str) -> Cell:
    """One row: ``D`` must go; else its initial, upper case if truncated, ``x`` for any that fits nowhere."""
    cell: Cell = {(p, p): (3, "D") for p in range(4)}
    if kind != "D":
        extra = int(kind.isupper())
        for move in (m for role in ROLES for m in MOVES[role]):
            cell[move] = 2 + extra, "R"
        for move in MOVES.get(kind.lower(), ()):
            cell[move] = extra, "K"
    return join(join(INSERTED, cell), INSERTED)


def _bottom_up(cells: list[Cell]) -> Cell:
    while len(cells) > 1:
        pairs = [join(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[2 * len(pairs) :]
    return cells[0] if cells else INSERTED


@lru_cache(maxsize=1 << 16)
def _short_span(kinds: str) -> Cell:
    return _bottom_up([row_cell(k) for k in kinds])


def span_cell(kinds: str) -> Cell:
    """The cell of a span of rows."""
    return _bottom_up([_short_span(kinds[k : k + 16]) for k in range(0, len(kinds), 16)])


def whole(cell: Cell) -> tuple[int, str]:
    """The cheapest edits that end after nothing at all or after an assistant row."""
    return min(cell[NOTHING, q] for q in (NOTHING, ASSISTANT) if (NOTHING, q) in cell)


def packed(cell: Cell) -> str:
    return ";".join(f"{p}{q}{cost}:{audit}" for (p, q), (cost, audit) in cell.items())


def unpacked(text: str) -> Cell:
    parts = (part.partition(":") for part in text.split(";"))
    return {(int(head[0]), int(head[1])): (int(head[2:]), audit) for head, _, audit in parts}


# -- rows and their faults -------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """The turns after damage by checksum: rows (conv_id, turn, role, text, copies); a dropped row has no copies."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return turns.select(
        "conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def _slim(rows: DataFrame) -> DataFrame:
    """Rows without their text: its digest, whether it is blank or truncated, and whether an earlier turn says the same."""
    own = rows.select(
        "conv_id", "turn", "role", "digest", "copies",
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("open"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    said = own.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    said = said.where("first <> last").select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest", "first")])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    joined = own.join(said, same, "left")
    later = F.coalesce(place > F.col("_first"), F.lit(False))
    return joined.select(*own.columns, later.alias("later"))


ORDER = ["conv_id", "turn", "role", "digest"]
PARTIAL = (
    "conv_id {kind}, part int, seq int, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, low long, high long, turns long, cell string"
)


def _partials(rows: DataFrame) -> DataFrame:
    """Per task, batch and conversation: counts of faults, what its neighbours need, and the cell of its rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = PARTIAL.format(kind=kind)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            out = []
            held = batch.to_pydict()
            columns = [held[c] for c in ("conv_id", "turn", "role", "digest", "copies", "blank", "open", "later")]
            own = _Run()
            for conv, turn, role, digest, copies, blank, open_, later in zip(*columns):
                if own.rows and own.conv != conv:
                    out.append(own.row(part, seq))
                    seq, own = seq + 1, _Run()
                own.conv, own.rows = conv, own.rows + 1
                for _ in range(copies):
                    this = (conv, turn, role, digest)
                    own.add(turn, role, blank, later or this == before, open_)
                    before = this
            if own.rows:
                out.append(own.row(part, seq))
                seq += 1
            arrays = [pa.array(c) for c in zip(*out)]
            types = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, types)], names=names)

    return rows.mapInArrow(run, schema)


class _Run:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.conv, self.rows = None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.kinds: list[str] = []

    def add(self, turn, role: str, blank: bool, duplicate: bool, open_: bool) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if self.high is None:
                self.low = turn
            if turn != self.high:
                self.turns, self.high = self.turns + 1, turn
        kind = initial if initial in MOVES else "x"
        if blank:
            self.blank, kind = self.blank + 1, "D"
        elif duplicate:
            self.duplicate, kind = self.duplicate + 1, "D"
        elif open_:
            self.truncated, kind = self.truncated + 1, kind.upper()
        self.kinds.append(kind)

    def row(self, part: int, seq: int) -> tuple:
        cell = packed(span_cell("".join(self.kinds)))
        return (
            self.conv, part, seq, self.blank, self.duplicate, self.truncated, self.illegal,
            self.first, self.last, self.low, self.high, self.turns, cell,
        )


def _parsed(partials: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): a conversation's pieces joined in order."""
    kind = partials.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_runs(batches, ["conv_id"]):
            rows, out = table.to_pylist(), []
            for start, stop in zip(first, [*first[1:], len(rows)]):
                out.append(_conversation(rows[start:stop]))
            columns = [pa.array(c, pa.int64() if n != "audit" else pa.string()) for n, c in zip([*counts, "audit"], zip(*out))]
            ids = table.column("conv_id").combine_chunks().take(pa.array(first))
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["conv_id", *counts, "audit"])

    dealt = partials.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string")


def _conversation(pieces: list[dict]) -> tuple:
    illegal = sum(p["illegal"] for p in pieces)
    said = [p for p in pieces if p["first"] is not None]
    illegal += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(said, said[1:]))
    dated = [p for p in pieces if p["low"] is not None]
    turns = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
    cost, audit = whole(_bottom_up([unpacked(p["cell"]) for p in pieces]))
    totals = (sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated"))
    return gaps, *totals, illegal, cost, audit


# -- the repaired conversations -------------------------------------------------------------------------


class Repaired:
    """Applies an audit to a conversation's rows as they come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.put = audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2  # a system row stands first, which is always kept

    def _role(self) -> str:
        return "user" if self.put % 2 == self.odd else "assistant"

    def insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._role(), ""
            self.at, self.put = self.at + 1, self.put + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield (role if letter == "K" else self._role()), text
            self.put += 1


def repaired_turns(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows (conv_id, seq, role, text): the repaired conversations themselves."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq = None, 0
        for batch in batches:
            out = []
            for r in batch.select(["conv_id", "head", "audit", "role", "text", "copies", "closing"]).to_pylist():
                if r["head"] == 0:
                    own, seq = Repaired(r["audit"]), 0
                    continue
                made = own.insertions() if r["closing"] else (x for _ in range(r["copies"]) for x in own.row(r["role"], r["text"]))
                for role, text in made:
                    out.append((r["conv_id"], seq, role, text))
                    seq += 1
            if out:
                types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv_id", "seq", "role", "text"])

    return _in_order(rows, parsed).mapInArrow(run, f"conv_id {kind}, seq long, role string, text string")


def _in_order(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """A conversation's audit, its rows in order, and a closing row, in one task."""
    heads = parsed.withColumn("head", F.lit(0))
    ends = parsed.select("conv_id", F.lit(2).alias("head"), F.lit(True).alias("closing"))
    both = heads.unionByName(rows.withColumn("head", F.lit(1)), allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(ORDER[0], "head", *ORDER[1:])


def with_digests(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """``parsed`` with the sha256 of the repaired turns' ``role:text``, joined by newlines."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = head = digest = None
        for batch in batches:
            heads, digests = [], []
            kept = np.asarray(batch.column("head"))
            columns = [batch.column(c).to_pylist() for c in ("role", "text", "copies")]
            audits = batch.column("audit")
            for k, (what, role, text, copies) in enumerate(zip(kept.tolist(), *columns)):
                if what == 0:
                    head = pa.RecordBatch.from_arrays([batch.column(c).slice(k, 1) for c in parsed_names], names=parsed_names)
                    own, digest = Repaired(audits[k].as_py()), hashlib.sha256()
                    continue
                made = own.insertions() if what == 2 else (x for _ in range(copies) for x in own.row(role, text))
                for said in made:
                    digest.update(("\n" if own.put else "").encode() + ":".join(said).encode())
                if what == 2:
                    heads.append(head)
                    digests.append(digest.hexdigest())
            if heads:
                whole_heads = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*whole_heads.columns, pa.array(digests)], names=[*parsed_names, "repaired_sha256"])

    parsed_names = parsed.columns
    return _in_order(rows, parsed).mapInArrow(run, f"{fields}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, parsed) of turns with ``copies``: stored rows, and per conversation its faults, cost and audit."""
    held = rows.select("conv_id", "turn", "role", "text", "copies").withColumn("digest", F.unhex(F.sha2("text", 256)))
    held = staged(held, "repair-rows")
    ordered = _slim(held).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return held, staged(_parsed(staged(_partials(ordered), "repair-cells")), "repair-parsed")


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """Every conversation with its faults, the cheapest repair and the digest of its repaired text."""
    return with_digests(*repair(damaged(turns))).select(*RETURNED)


_CLOSURE = "(0,0,0),(1,1,0),(2,2,0),(3,3,0),(0,2,1),(1,2,1),(3,2,1),(2,3,1),(0,3,2),(1,3,2)"
_MOVES = ",".join(f"({p},{q},'{c}')" for c, moves in MOVES.items() for p, q in moves)

SQL = rf"""
WITH RECURSIVE {_CRC},
  given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c,
      {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS hit
    FROM conversations, crc_table),
  hurt AS (
    SELECT c, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
      CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM given, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE hit <> 0),
  placed AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
  judged AS (
    SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
      NOT regexp_matches(text, '[^{SPACE}]') AS blank, NOT regexp_matches(text, '[.!?][{SPACE}]*\z') AS open,
      left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) AS prior, left(role, 1) AS initial FROM placed),
  faults AS (
    SELECT c, i, role, text, initial, blank OR again AS gone, (open AND NOT blank AND NOT again)::INT AS cut,
      turn, blank, again AND NOT blank AS duplicate,
      prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au') AS illegal FROM judged),
  inserts(p, q, k) AS (VALUES {_CLOSURE}),
  moves(p, q, initial) AS (VALUES {_MOVES}),
  edits AS (
    SELECT p, q, initial, 'K' AS letter, 0 AS price FROM moves
    UNION ALL SELECT p, q, NULL, 'R', 2 FROM moves WHERE initial <> 's'
    UNION ALL SELECT p, p, NULL, 'D', 3 FROM (VALUES (0), (1), (2), (3)) AS states(p)),
  parse(c, i, state, cost, audit, said) AS (
    SELECT DISTINCT c, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM given
    UNION ALL
    SELECT d.c, f.i, e.q, d.cost + 2 * s.k + e.price + CASE e.letter WHEN 'D' THEN 0 ELSE f.cut END AS cost,
      d.audit || repeat('I', s.k) || e.letter AS audit,
      list_concat(list_concat(d.said, CASE s.k WHEN 0 THEN [] WHEN 2 THEN ['user:', 'assistant:']
          ELSE [CASE s.q WHEN 2 THEN 'user:' ELSE 'assistant:' END] END),
        CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
          ELSE [CASE e.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END) AS said
    FROM parse d JOIN faults f ON f.c = d.c AND f.i = d.i + 1 JOIN inserts s ON s.p = d.state
      JOIN edits e ON e.p = s.q AND (e.letter = 'D' OR NOT f.gone) AND (e.initial IS NULL OR e.initial = f.initial)
    QUALIFY row_number() OVER (PARTITION BY d.c, e.q ORDER BY d.cost + 2 * s.k + e.price + CASE e.letter WHEN 'D' THEN 0 ELSE f.cut END,
      d.audit || repeat('I', s.k) || e.letter) = 1),
  ended AS (
    SELECT d.c, d.cost + 2 * s.k AS cost, d.audit || repeat('I', s.k) AS audit,
      list_concat(d.said, CASE s.k WHEN 0 THEN [] WHEN 2 THEN ['user:', 'assistant:']
        ELSE [CASE s.q WHEN 2 THEN 'user:' ELSE 'assistant:' END] END) AS said
    FROM (SELECT * FROM parse QUALIFY i = max(i) OVER (PARTITION BY c)) d JOIN inserts s ON s.p = d.state AND s.q IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY d.c ORDER BY d.cost + 2 * s.k, d.audit || repeat('I', s.k)) = 1),
  counted AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
      count(*) FILTER (duplicate) AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (illegal) AS illegal
    FROM faults GROUP BY c)
SELECT g.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
  coalesce(n.truncated, 0)::BIGINT AS truncated, coalesce(n.illegal, 0) AS illegal, e.cost::BIGINT AS cost, e.audit,
  sha256(array_to_string(e.said, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM given) g JOIN ended e USING (c) LEFT JOIN counted n USING (c)
"""
