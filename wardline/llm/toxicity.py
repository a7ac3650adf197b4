"""Toxicity by noisy-channel deobfuscation and a classifier over the restored words.

1. A character trigram model is counted over all documents.
2. A word that may hide another (digits or signs for letters, letters repeated, marks or spaces
   between letters) becomes a lattice of readings, and Viterbi decoding picks the likeliest under
   that model. Other words have one reading only. A run of one sign stands for three letters at most,
   as a word has no letter more often in a row.
3. Restored words and their beginnings get weights from labelled training documents; a logistic
   regression over each text's strongest weights gives the score.

Only texts and the labels of training documents are read. The weights and the regression are fitted
on at most MAX_TRAINING labelled documents (those with the lowest CRC-32 of their id), counted in
full below that; every document is scored over its whole text.

Nulls: a null text counts as empty; empty texts get the score of a text without any weighted word.
Null labels and null ids are not trained on; of several labels of an id the highest holds. Repeated
rows are scored each. Without labels of both kinds the score is the share of toxic labels, 0 if
there are none. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wardline.llm.base import byte_slices, kept, release, staged

MAX_TRAINING = 40_000
MIN_DOCS = 2  # a feature of fewer toxic training documents is no evidence
SHRINK = 5.0
STRONG = 2.0
BEGINNINGS = (4, 5, 6)
MAX_WORDS = 100_000  # readings and weights a worker keeps
SLICE = 1 << 20  # bytes of text that are taken apart at once
HELD_OUT = 5

# Signs that stand for letters; fixed values.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}
BETWEEN = ".-_*~^'"
# Costs of the channel in nats: reading a sign as a letter or as itself, dropping or keeping a mark
# between letters, and shortening a run of one letter or leaving it.
AS_LETTER, AS_SIGN, DROP, KEEP, SHORTER, LONG_RUN = 1.0, 1.5, 1.0, 1.0, 0.7, 1.5

# Symbols of the language model: 0 a word boundary, then letters, digits together, all else together.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = 64
DIGIT, OTHER = 62, 63


def _symbol_table() -> np.ndarray:
    out = np.full(0x300, OTHER, np.int32)
    for i in range(0x80):
        if not chr(i).isalnum():
            out[i] = 0
    out[[ord(c) for c in "0123456789"]] = DIGIT
    for i, c in enumerate(ALPHABET, 1):
        out[ord(c)] = i
        if len(c.upper()) == 1 and ord(c.upper()) < 0x300:
            out[ord(c.upper())] = i
    return out


SYMBOLS = _symbol_table()


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return SYMBOLS[np.minimum(points, len(SYMBOLS) - 1)]


def count_characters(docs: DataFrame) -> DataFrame:
    """Rows (gram, n): how often each three symbols follow each other in all texts, at most SIZE ** 3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                joined = "  " + "  ".join(t.as_py() or "" for t in part.column("text")) + "  "
                code = _codes(joined)
                total += np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["gram", "n"])

    own = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n long")
    return own.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counted: DataFrame) -> np.ndarray:
    """Log probabilities [before last, last, next], each order smoothed by the one below."""
    three = np.zeros(SIZE**3)
    for r in counted.collect():  # SIZE ** 3 rows at most
        three[r["gram"]] = r["n"]
    three = three.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi decoding of obfuscated words."""

    edge = re.compile(r"^[^\w$@]+|[^\w]+$")
    hidden = re.compile(r"[0-9@$!+]|(.)\1\1|\w[.\-_*~^']+\w")
    letter = re.compile(r"[^\W\d_]")

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def word(self, raw: str) -> str:
        """The word's letters in lower case, restored; several words if a mark parts them."""
        core = self.edge.sub("", raw.lower())
        if core.isalpha() and not self.hidden.search(core):
            return core
        if not self.letter.search(core) or not self.hidden.search(core):
            return core
        return self.decode(core)

    def spaced(self, letters: list[str]) -> str:
        """Single letters that stood apart: read together or apart."""
        return self.decode(" ".join(x.lower() for x in letters))

    def lattice(self, text: str) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        while i < len(text):
            c, j = text[i], i
            while j < len(text) and text[j] == c:
                j += 1
            n = j - i
            if c in SIGNS:
                one = [(x, AS_LETTER) for x in SIGNS[c]] + [(c, AS_SIGN)]
                out.extend([one] * min(n, 3))
            elif c == " " or c in BETWEEN:
                out.append([("", DROP), (" ", KEEP)])
            elif n >= 3 and c.isalpha():
                out.append([(c, SHORTER), (c + c, SHORTER), (c * n, LONG_RUN * (n - 2))])
            else:
                out.append([(c * n, 0.0)])
            i = j
        return out

    def decode(self, text: str) -> str:
        """The likeliest reading; each state points back to its predecessor, so that time is linear in the length."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for readings in [*self.lattice(text), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, done) in states.items():
                for said, cost in readings:
                    x, y, total = a, b, score - cost
                    for c in said:
                        z = int(SYMBOLS[min(ord(c), len(SYMBOLS) - 1)])
                        total += self.model[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or total > new[x, y][0]:
                        new[x, y] = (total, (done, said))
            states = new
        highest = max(score for score, _ in states.values())
        return max(self._said(at) for score, at in states.values() if score == highest).strip()

    @staticmethod
    def _said(at: tuple | None) -> str:
        out = []
        while at:
            at, said = at
            out.append(said)
        return "".join(reversed(out))


def features(restored: str) -> list[str]:
    """A restored word and its beginnings."""
    out = []
    for word in restored.split():
        out.append(word)
        out.extend("^" + word[:n] for n in BEGINNINGS if len(word) >= n)
    return out


class _Words:
    """Restored readings of a worker's words, kept between batches, and where letters stand apart."""

    def __init__(self, model: np.ndarray):
        self.restorer = Restorer(model)
        self.known: dict[str, str] = {}

    def reading(self, raw: str) -> str:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > MAX_WORDS:
                self.known.clear()
            found = self.known[raw] = self.restorer.word(raw)
        return found

    def split(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """Different raw words, code and row of each word, and each different (row, word) read from letters that stand apart."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = np.asarray(coded.indices).astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(parts)).astype(np.int64))
        single = np.fromiter((len(w) == 1 and (w.isalpha() or w in SIGNS) for w in words), bool, len(words))
        apart = []
        marked = single[codes] if len(codes) else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
        for start, stop in zip(edges[::2], edges[1::2]):
            for row in np.unique(rows[start:stop]) if stop - start >= 3 else ():
                run = np.flatnonzero(rows[start:stop] == row) + start
                if len(run) >= 3:
                    reading = self.restorer.spaced([words[codes[k]] for k in run])
                    apart.extend((int(row), word) for word in reading.split())
        return words, codes, rows, list(dict.fromkeys(apart))


def _words(model: np.ndarray) -> _Words:
    return kept(("words", model[::7, ::5, ::3].tobytes()), lambda: _Words(model))


def training_rows(labels: DataFrame, limit: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, y) of at most ``limit`` ids outside the held-out fifth."""
    code = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(code % HELD_OUT != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    return known.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(limit)


def count_features(training: DataFrame, model) -> DataFrame:
    """Rows (feature, toxic, clean): in how many training documents of either kind a feature stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _words(model.value)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                words, codes, rows, apart = own.split(part.column("text"))
                index: dict[str, int] = {}
                owner, feature = [], []
                for w in words:
                    feature.append([index.setdefault(f, len(index)) for f in features(own.reading(w))])
                width = np.array([len(f) for f in feature], np.int64)
                flat = np.array([i for f in feature for i in f], np.int64)
                pairs = np.unique(rows * max(len(words), 1) + codes)
                row, word = np.divmod(pairs, max(len(words), 1))
                starts = np.cumsum(width) - width
                spread = np.repeat(starts[word] - (np.cumsum(width[word]) - width[word]), width[word])
                owner = np.repeat(row, width[word])
                found = flat[np.arange(len(owner)) + spread] if len(owner) else np.zeros(0, np.int64)
                for r, reading in apart:
                    more = [index.setdefault(f, len(index)) for f in features(reading)]
                    owner = np.concatenate([owner, np.full(len(more), r)])
                    found = np.concatenate([found, np.array(more, np.int64)])
                n = max(len(index), 1)
                row, at = np.divmod(np.unique(owner * n + found), n)
                y = np.asarray(part.column("y"))[row.astype(np.int64)] == 1
                at = at.astype(np.int64)
                toxic, clean = np.bincount(at[y], minlength=len(index)), np.bincount(at[~y], minlength=len(index))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(index), pa.string()), pa.array(toxic.astype(np.int64)), pa.array(clean.astype(np.int64))],
                    names=["feature", "toxic", "clean"],
                )

    found = training.select("text", "y").mapInArrow(count, "feature string, toxic long, clean long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def weigh(counted: DataFrame, share: float) -> dict[str, float]:
    """Log odds against the share of toxic documents, shrunk towards none, of all features that tell anything.

    They come from MAX_TRAINING documents at most, and from MIN_DOCS toxic ones at least.
    """
    rate = (F.col("toxic") + SHRINK * share) / (F.col("toxic") + F.col("clean") + SHRINK)
    weight = F.log(rate / (1 - rate)) - F.log(F.lit(share / (1 - share)))
    heavy = counted.where(f"toxic >= {MIN_DOCS}").select("feature", weight.alias("w")).where("w > 0.5")
    return {r["feature"]: r["w"] for r in heavy.collect()}


EVIDENCE = ["strongest", "second", "strong"]


def evidence(docs: DataFrame, model, weights, with_text: bool = False) -> DataFrame:
    """The other columns of ``docs`` plus the two strongest weights of different words, and how many are strong.

    ``with_text`` keeps the text, too.
    """
    other = [c for c in docs.columns if c != "text"]
    slim = docs.select(*other, F.col("text").cast("string").alias("text"))
    keep = slim.columns if with_text else other
    fields = [*slim.select(*keep).schema.fields, *(StructField(c, DoubleType()) for c in EVIDENCE)]

    def weigh_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heavy = _words(model.value), weights.value
        known: dict[str, float] = {}

        def weight(reading: str) -> float:
            return max((heavy.get(f, 0.0) for f in features(reading)), default=0.0)

        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                words, codes, rows, apart = own.split(part.column("text"))
                if len(known) > MAX_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = weight(own.reading(w))
                each = np.fromiter(map(known.__getitem__, words), float, len(words))
                hit = np.flatnonzero(each[codes] > 0) if len(codes) else np.zeros(0, np.int64)
                pairs = np.unique(rows[hit] * max(len(words), 1) + codes[hit])
                row, word = np.divmod(pairs, max(len(words), 1))
                value = each[word.astype(np.int64)]
                if apart:
                    row = np.concatenate([row, [r for r, _ in apart]]).astype(np.int64)
                    value = np.concatenate([value, [weight(x) for _, x in apart]])
                out = np.zeros((3, part.num_rows))
                order = np.lexsort((-value, row))
                row, value = row[order].astype(np.int64), value[order]
                first = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
                out[0, row[first]] = value[first]
                nxt = first + 1
                ok = nxt < len(row)
                ok[ok] &= row[nxt[ok]] == row[first[ok]]
                out[1, row[first[ok]]] = value[nxt[ok]]
                np.add.at(out[2], row[value > STRONG], 1.0)
                out[2] = np.log1p(out[2])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(x) for x in out)], names=[*keep, *EVIDENCE]
                )

    return slim.mapInArrow(weigh_texts, StructType(fields))


def fit_scores(found: DataFrame) -> list[float]:
    """Intercept and coefficients of a logistic regression, by Newton steps over sums that Spark adds up."""
    names = ["one", *EVIDENCE]
    rows = found.select(F.lit(1.0).alias("one"), *[F.col(c) for c in EVIDENCE], F.col("y").cast("double").alias("y"))
    beta = np.zeros(len(names))
    # Texts of the same evidence, rounded, are one weighted row; there are far fewer than texts.
    rows = rows.select("y", "one", *[F.round(c, 2).alias(c) for c in EVIDENCE]).groupBy("y", *names).agg(F.count("*").alias("n"))
    grid = rows.toPandas()  # MAX_TRAINING rows at most
    x, y, n = grid[names].to_numpy(float), grid["y"].to_numpy(float), grid["n"].to_numpy(float)
    ridge = np.diag([1e-6, *[1.0] * len(EVIDENCE)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge @ beta
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta.tolist()


def with_toxicity(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, with_text: bool = False) -> DataFrame:
    """``docs`` (columns doc_id and text, others are kept, text ``with_text``) with score and predicted.

    ``docs`` is read three times; its rows are scored where they lie, without a shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(language_model(count_characters(docs)))
    chosen = staged(training_rows(labels, max_training), "toxic-labels")
    training = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # MAX_TRAINING ids at most are broadcast.
    training = staged(training.join(F.broadcast(chosen), "doc_id").select("text", "y"), "toxic-training")
    n = training.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    share = (n["toxic"] or 0) / n["n"] if n["n"] else 0.0
    weights: dict[str, float] = {}
    beta = None
    if 0 < share < 1:
        weights = weigh(count_features(training, model), share)
        weights_sent = spark.sparkContext.broadcast(weights)
        beta = fit_scores(evidence(training, model, weights_sent))
    else:
        weights_sent = spark.sparkContext.broadcast(weights)
    found = evidence(docs, model, weights_sent, with_text)
    if beta is None:
        score = F.lit(float(share))
    else:
        z = F.lit(beta[0])
        for b, c in zip(beta[1:], EVIDENCE):
            z = z + F.lit(b) * F.col(c)
        score = 1 / (1 + F.exp(-z))
    kept = [c for c in found.columns if c not in EVIDENCE]
    return found.select(*kept, score.cast("double").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per document."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT == 0
    found = with_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
