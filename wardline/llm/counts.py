"""Exact token counts at every prefix by dynamic programming over byte-pair encodings.

The encoding of a prefix differs from that of a shorter one by its last token, and the last token
is the one candidate whose boundary to the token before it survives all merges. So each prefix
needs its last token and its count only, both from a shorter prefix. Prefixes are remembered once
for all words that share them. Truncation and budget questions read the counts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.base import byte_slices
from wardline.llm.tokens import TAIL

LIMIT = 2048
MAX_PREFIXES = 900_000
MAX_WORDS = 600_000
LONG = 40
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NEVER = 1 << 30
LATIN = "\u024f"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PrefixCounts:
    """Counts for a word-end byte-pair vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.end = spec["model"]["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile("|".join(map(regex.escape, self.special)))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.letters = dict(enumerate(byte_letters()))
        self.rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        vocabulary = spec["model"]["vocab"]
        self.open = {t for t in vocabulary if not t.endswith(self.end)}
        self.closed = {t[: -len(self.end)] for t in vocabulary if t.endswith(self.end) and t != self.end}
        self.longest = max(map(len, self.open | self.closed))
        parent = {a + b: (a, b) for a, b in self.rank}
        self.left = {t: self._spine(t, parent, 0) for t in vocabulary}
        self.right = {t: self._spine(t, parent, 1) for t in vocabulary if t in self.open}
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.words: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.decided: dict[tuple[str, str], bool] = {}

    def _spine(self, token: str, parent: dict, side: int) -> list[tuple[str, int]]:
        """From the outermost symbol up to the token itself: each part, and the rank at which it is absorbed."""
        out, absorbed = [], NEVER
        while True:
            out.append((token, absorbed))
            if token not in parent:
                return out[::-1]
            absorbed = self.rank[parent[token]]
            token = parent[token][side]

    def stays(self, a: str, b: str) -> bool:
        """Whether no merge reaches over the boundary between tokens ``a`` and ``b``.

        Parts on both sides are followed in the order in which merges make them. Equal ranks go
        left to right.
        """
        found = self.decided.get((a, b))
        if found is None:
            found = self.decided[a, b] = self._stays(a, b)
        return found

    def _stays(self, a: str, b: str) -> bool:
        left, right = self.right[a], self.left[b]
        i = j = 0
        rank = self.rank
        while True:
            x, x_until = left[i]
            y, y_until = right[j]
            over = rank.get((x, y), NEVER)
            if over < x_until and over <= y_until and over < NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until < y_until:
                i += 1
            else:
                j += 1

    def _extend(self, s: str, n: int, last, count) -> tuple[str, int]:
        """(last token, count) of the unfinished prefix of length ``n``, given those of all shorter ones."""
        for size in range(min(n, self.longest), 0, -1):
            token = s[n - size : n]
            if token in self.open:
                before = last(n - size)
                if not before or self.stays(before, token):
                    return token, count(n - size) + 1
        raise ValueError(f"no encoding of {s[:n]!r}")

    def _close(self, s: str, n: int, last, count) -> int:
        """Count of the prefix of length ``n`` as a finished word."""
        for size in range(min(n, self.longest), 0, -1):
            token = s[n - size : n]
            if token in self.closed:
                before = last(n - size)
                if not before or self.stays(before, token + self.end):
                    return count(n - size) + 1
        raise ValueError(f"no encoding of {s[:n]!r}")

    def finished(self, s: str) -> int:
        """Count of the word ``s``, whose last symbol carries the word end."""
        if not s:
            return 0
        if len(s) > LONG:
            return self.ends(s, only_last=True)[-1]
        known, is_open, stays = self.last, self.open, self.stays
        top = self.longest
        at = len(s) - 1
        while s[:at] not in known:
            at -= 1
        for n in range(at + 1, len(s)):
            for start in range(max(0, n - top), n):
                token = s[start:n]
                if token in is_open:
                    before, count = known[s[:start]]
                    if not before or stays(before, token):
                        known[s[:n]] = (token, count + 1)
                        break
        n, end, closed = len(s), self.end, self.closed
        for start in range(max(0, n - top), n):
            token = s[start:]
            if token in closed:
                before, count = known[s[:start]]
                if not before or stays(before, token + end):
                    return count + 1
        raise ValueError(f"no encoding of {s!r}")

    def ends(self, s: str, only_last: bool = False) -> list[int]:
        """Count of every prefix of ``s`` as a finished word, the empty one first."""
        tokens, counts, out = [""], [0], [0]
        for n in range(1, len(s) + 1):
            if not only_last or n == len(s):
                out.append(self._close(s, n, tokens.__getitem__, counts.__getitem__))
            token, count = self._extend(s, n, tokens.__getitem__, counts.__getitem__)
            tokens.append(token)
            counts.append(count)
        return out

    def spell(self, text: str) -> str:
        return text if text.isascii() and text.isalnum() else text.encode().decode("latin-1").translate(self.letters)

    def word(self, word: str) -> int:
        """Count of a word between white space, as the library has it."""
        stem = word.rstrip(TAIL)
        if stem.isalpha():
            lowered = stem.lower()
            if stem.isascii() or lowered.isalpha() and unicodedata.is_normalized("NFC", stem):
                return self._letters(lowered) + self.finished(word[len(stem) :])
        count, at = 0, 0
        for m in self.special_split.finditer(word):
            count += self._plain(word[at : m.start()]) + 1
            at = m.end()
        count += self._plain(word[at:])
        return self._checked(word, count)

    def _letters(self, word: str) -> int:
        """Count of a word of letters only, in normal form and lower case."""
        found = self.stems.get(word)
        if found is None:
            found = self.finished(self.spell(word))
            found = self.stems[word] = self._checked(word, found)
        return found

    def _checked(self, word: str, count: int) -> int:
        """The count itself; for scripts beyond Latin, whose letters and cases hang on the library's edition of Unicode, as it says."""
        if word.isascii() or max(word) <= LATIN:
            return count
        return len(self.library.encode(word, add_special_tokens=False).ids)

    def _plain(self, text: str) -> int:
        lowered = unicodedata.normalize("NFC", text).lower()
        return sum(self.finished(self.spell(t)) for t in self.pattern.findall(lowered))

    def count_words(self, words: list[str]) -> np.ndarray:
        if len(self.words) > MAX_WORDS or len(self.last) + len(self.decided) > MAX_PREFIXES:
            self.clear()
        known = self.words
        for w in words:
            if w not in known:
                known[w] = self.word(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def longest_fit(self, word: str, budget: int) -> int:
        """Characters of the longest beginning of ``word`` with at most ``budget`` tokens.

        Cuts inside runs of letters; other pre-tokens, and words whose normal form has other
        characters, stay whole.
        """
        lowered = word.lower()
        changed = not unicodedata.is_normalized("NFC", word) or any(len(c.lower()) > 1 for c in set(word))
        if changed or self.special_split.search(word):
            return 0
        at = 0
        for m in self.pattern.finditer(lowered):
            spelled = self.spell(m.group())
            whole = self.finished(spelled)
            if whole > budget:
                if m.group().isalpha():
                    ends = self.ends(spelled)
                    bytes_to = np.cumsum([len(c.encode()) for c in m.group()])
                    fits = [k for k, b in enumerate(bytes_to, 1) if ends[b] <= budget]
                    return m.start() + max(fits) if fits else at
                return at
            budget -= whole
            at = m.end()
        return at


_COUNTERS: dict[str, PrefixCounts] = {}


def counter(path: str) -> PrefixCounts:
    """The worker's counter of a vocabulary file, kept between tasks."""
    if path not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _COUNTERS[path] = PrefixCounts(path)
    return _COUNTERS[path]


def _nth_word(text: str, n: int) -> tuple[int, str]:
    """Start and characters of part ``n`` of a split at white space; leading white space makes an empty part 0."""
    n -= text[0] in " \t\n\v\f\r"
    for m in islice(WORD.finditer(text), n, None):
        return m.start(), m.group()
    return len(text), ""


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit, fit_chars), one per document.

    ``fit_chars`` is how many characters of the text fit the limit, a cut inside a word included.

    Nulls: a null text counts as empty (no tokens, fits); a null id is kept. Repeated rows are counted
    each. Words of any length are handled. An empty table gives an empty result; other columns are
    not looked at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                split = pc.ascii_split_whitespace(texts)
                coded = split.flatten().dictionary_encode()
                each = own.count_words(coded.dictionary.to_pylist())
                codes = np.asarray(coded.indices).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(each[codes] if len(codes) else codes)])
                bounds = np.asarray(split.offsets).astype(np.int64)
                bounds = bounds - bounds[0]
                total = np.diff(upto[bounds])
                fits = np.asarray(pc.utf8_length(texts)).astype(np.int64).copy()
                for row in np.flatnonzero(total > limit):
                    first = bounds[row]
                    word = int(np.searchsorted(upto[first + 1 : bounds[row + 1] + 1], upto[first] + limit, side="right"))
                    left = int(limit - (upto[first + word] - upto[first]))
                    start, text = _nth_word(texts[row].as_py(), word)
                    # A word of white space of another script counts nothing and fits.
                    fits[row] = start + own.longest_fit(text, left)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(total),
                        pa.array(total > limit), pa.array(fits),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, ends, upto): for every word of a text where it ends, in characters, and the tokens up to there.

    Nulls and empty texts have no words; the rest as for ``token_counts``. Stored once, the table answers
    any budget, see ``within_budget``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ends, upto = [], []
                for value in part.column("text"):
                    found = list(WORD.finditer(value.as_py() or ""))
                    ends.append([m.end() for m in found])
                    upto.append(np.cumsum(own.count_words([m.group() for m in found])).tolist())
                kinds = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ends, kinds), pa.array(upto, kinds)], names=["doc_id", "ends", "upto"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(count, f"doc_id {kind}, ends array<long>, upto array<long>")


def within_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """Rows (doc_id, n_tokens, fit_chars, fit_tokens): the longest beginning of whole words within ``budget`` tokens."""
    words = F.size(F.filter("upto", lambda n: n <= budget))
    return prefixes.select(
        "doc_id", F.coalesce(F.try_element_at("upto", F.lit(-1)), F.lit(0)).alias("n_tokens"),
        F.when(words > 0, F.get("ends", words - 1)).otherwise(0).alias("fit_chars"),
        F.when(words > 0, F.get("upto", words - 1)).otherwise(0).alias("fit_tokens"),
    )
