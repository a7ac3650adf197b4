"""Token ids of whole texts by the ``tokenizers`` library, each different word encoded once per worker.

The vocabulary's own rules never let a token or a normalisation reach over ASCII white space, so a
text's ids are those of its white-space words, one after the other. A word that is letters plus a
run of plain punctuation is again the ids of the letters plus those of the run: the pre-tokenizer
cuts there. Everything else, special strings included, goes to the library as it is.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wardline.llm.base import kept

# No apostrophe (contractions) and no character of a special string.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
MAX_PARTS = 400_000
# So many words go to the library as one text: it takes longer over each word of a long one.
LINE = 100


class WordEncoder:
    """Ids of texts as one array plus each text's number of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Starts over with an empty memory."""
        self.parts: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.lengths = np.zeros(1, np.int64)
        self.uses = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keeps what came in several batches, half of MAX_PARTS at most; most words of a corpus come once.

        So what is remembered is bounded by MAX_PARTS parts of words and a batch's.
        """
        often = np.flatnonzero(self.uses > 1)
        if len(often) > MAX_PARTS // 2:
            often = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: MAX_PARTS // 2]])
        often = np.concatenate([[0], often[often > 0]])  # the empty part stays the first
        number = np.full(len(self.uses), -1, np.int64)
        number[often] = np.arange(len(often))
        self.parts = {part: k for part, k in zip(self.parts, number[list(self.parts.values())].tolist()) if k >= 0}
        lengths = self.lengths[often]
        self.ids = self.ids[_index(self.starts[often], lengths)]
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.uses = self.uses[often] // 2  # what is not met any more goes in time

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        parts = self.word_parts(coded.dictionary)[codes].reshape(-1) if len(codes) else np.zeros(0, np.int64)
        counts = self.lengths[parts]
        ids = self.ids[_index(self.starts[parts], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.asarray(split.offsets).astype(np.int64)
        bounds = (bounds - bounds[0]) * 2
        return ids, np.diff(ends[bounds])

    def word_parts(self, words: pa.Array) -> np.ndarray:
        """The two parts of every word: letters and the run behind them, or the whole word and nothing."""
        if len(self.parts) > MAX_PARTS:
            self.forget()
        stem = pc.ascii_rtrim(words, TAIL)
        plain = pc.string_is_ascii(stem)
        cut = np.asarray(pc.and_(plain, pc.ascii_is_alpha(stem)).to_numpy(zero_copy_only=False)).copy()
        foreign = np.flatnonzero(~np.asarray(plain.to_numpy(zero_copy_only=False)))
        if len(foreign):
            other = stem.take(pa.array(foreign)).dictionary_encode()
            # Letters that lower to more than letters would meet the run behind them.
            letters = np.array([w.isalpha() and w.lower().isalpha() for w in other.dictionary.to_pylist()], bool)
            cut[foreign] = letters[np.asarray(other.indices)]
        lowered = pc.if_else(plain, pc.ascii_lower(stem), stem)
        keys = pc.if_else(pa.array(cut), lowered, words).dictionary_encode()
        at = np.asarray(keys.indices)
        joined = np.zeros(len(keys.dictionary), bool)
        joined[at] = cut
        first = self._known(keys.dictionary.to_pylist(), joined)[at]
        size = np.where(cut, np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(stem)), 0)
        bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[_index(bounds[1:] - size, size)]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        tails = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        tails = tails.dictionary_encode()
        known = self._known(tails.dictionary.to_pylist(), np.ones(len(tails.dictionary), bool))
        return np.stack([first, known[np.asarray(tails.indices)]], axis=1)

    def _known(self, parts: list[str], joined: np.ndarray) -> np.ndarray:
        """Numbers of different parts; those not met before are encoded, ``joined`` ones many at a time."""
        out = np.fromiter(map(self.parts.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            for flag in (True, False):
                some = missing[joined[missing] == flag]
                out[some] = np.arange(len(self.starts), len(self.starts) + len(some))
                self._store([parts[k] for k in some.tolist()], joined=flag)
        self.uses[out] += 1
        return out

    def _store(self, parts: list[str], joined: bool) -> None:
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            ids = lengths = None
            if joined:
                lines = [" ".join(some[k : k + LINE]) for k in range(0, len(some), LINE)]
                ids = np.concatenate([np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(lines, add_special_tokens=False)])
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(some):  # each part is one pre-token, unless normalisation made more of it
                    lengths = np.diff(np.concatenate([[0], ends]))
            if lengths is None:
                each = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                lengths = np.array([len(e) for e in each], np.int64)
                ids = np.concatenate([np.array(e, np.int32) for e in each])
            first = len(self.starts)
            self.parts.update(zip(some, range(first, first + len(some))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.uses = np.concatenate([self.uses, np.zeros(len(some), np.int64)])
            self.ids = np.concatenate([self.ids, ids])


def _index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("encoder", path), lambda: WordEncoder(path))
