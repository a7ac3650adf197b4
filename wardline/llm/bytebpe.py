"""Byte-level BPE through a sentencepiece model that is written straight from the rank file.

Every byte becomes one letter, every token the word of its bytes' letters, and a token's score is
its negative rank. Merging the best-scored neighbours, left ones first, is then what byte-pair
encoding by rank does. The normaliser is the identity and nothing is added, so pre-tokens go in
as they are, and a token's bytes come back by the inverse mapping.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.base import byte_slices

LETTER = 0x100  # byte b is written as the letter LETTER + b
MAX_PIECES = 400_000
# Message and enumeration numbers of sentencepiece_model.proto; fixed values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE = 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def to_letters(raw: bytes) -> str:
    return (np.frombuffer(raw, np.uint8).astype("<u4") + LETTER).tobytes().decode("utf-32-le")


def to_bytes(letters: str) -> bytes:
    return (np.frombuffer(letters.encode("utf-32-le"), "<u4") - LETTER).astype(np.uint8).tobytes()


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the tokens' ranks, the unknown piece last."""
    out = []
    for rank, token in enumerate(tokens):
        body = _block(PIECE, to_letters(token).encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", -float(rank))
        out.append(_block(PIECES, body))
    unknown = len(tokens)
    out.append(_block(PIECES, _block(PIECE, b"<unk>") + _number(TYPE, UNKNOWN)))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, unknown + 1) + _number(UNK_ID, unknown)
    trainer += b"".join(_number(field, -1) for field in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _block(NAME, b"identity") + b"".join(
        _number(field, 0) for field in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES)
    )
    return b"".join(out) + _block(TRAINER, trainer) + _block(NORMALIZER, normalizer)


class ByteBpe:
    """Encodes texts pre-token by pre-token and decodes ids; each different pre-token is encoded once."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.model = SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.split(text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self._learn(parts)
            return b"".join(map(self.known.__getitem__, parts))

    def _learn(self, parts: list[str]) -> None:
        if len(self.known) > MAX_PIECES:
            self.known = {}
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        merged = []
        for part in new:  # a pre-token that is itself in the vocabulary is that token
            rank = self.rank.get(part.encode())
            if rank is None:
                merged.append(part)
            else:
                self.known[part] = struct.pack("<I", rank)
        if merged:
            found = self.model.encode([to_letters(p.encode()) for p in merged], num_threads=1)
            self.known.update((p, struct.pack(f"<{len(ids)}I", *ids)) for p, ids in zip(merged, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder of a vocabulary file, kept between tasks."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary.

    Nulls: a null text counts as empty and has no ids; a null id is kept. Repeated rows are encoded
    each. Texts and pre-tokens may have any length. An empty table gives an empty result; other columns are
    not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids = [own.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_documents(coded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids, decoded): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary, pattern)
        for batch in batches:
            for part in byte_slices(batch, "ids"):
                raw = [own.decode(x.as_py() or b"") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"]
                )

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of every text's ids and of what they decode to."""
    both = decode_documents(encode_documents(docs, vocabulary, pattern), vocabulary, pattern)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
