"""Restoring long words, and long runs of letters that stand apart."""

import collections
import gc
import itertools
import math
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import simhash, tokens, toxicity
from wardline.llm.catalog import WORD_VOCABULARY


@pytest.fixture(scope="module")
def model():
    text = "  " + "  ".join(["you are a stupid person and so it goes on "] * 200) + "  "
    code = toxicity._codes(text)
    three = np.bincount((code[:-2] * toxicity.SIZE + code[1:-1]) * toxicity.SIZE + code[2:], minlength=toxicity.SIZE**3)

    class Counted:
        @staticmethod
        def collect():
            return [{"gram": int(i), "n": int(three[i])} for i in np.flatnonzero(three)]

    return toxicity.language_model(Counted)


def test_words_of_any_length_are_restored(model):
    own = toxicity.Restorer(model)
    assert own.word("st" + "u" * 60 + "pid") == "stupid"
    assert "stupid" in own.word("you-are-a-st0pid-person-and-so-it-goes-on-you-are-a-stup1d").split()
    assert len(own.word("st0pid-" * 20_000)) > 100_000  # linear in the length


def test_a_word_over_the_fortieth_letter_is_read_whole(model):
    for before in range(30, 45):
        letters = list(("youareapersonandsoitgoeson" * 3)[:before] + "stupid")
        apart = toxicity._Words(model).split(pa.array([" ".join(letters)]))[3]
        assert any("stupid" in word for _, word in apart), before


def test_a_worker_keeps_the_memory_of_one_stage_only(model):
    def gone(kept):
        gc.collect()
        return kept() is None

    packing = weakref.ref(tokens.encoder(WORD_VOCABULARY))
    assert tokens.encoder(WORD_VOCABULARY) is packing()  # within a stage it stays
    words = weakref.ref(toxicity._words(model))
    assert gone(packing)
    assert toxicity._words(model) is words()
    list(simhash._fingerprints(iter([])))
    assert gone(words)
    words = weakref.ref(toxicity._words(model))
    tokens.encoder(WORD_VOCABULARY)
    assert gone(words)


# -- the whole way, against plain Python ------------------------------------------------------------------


def plain_decode(model, readings):
    """The likeliest of all paths through a lattice, by trying each."""
    best = None
    for path in itertools.product(*[*readings, [(" ", 0.0)]]):
        said, cost = "".join(x for x, _ in path), sum(c for _, c in path)
        score, a, b = -cost, 0, 0
        for c in said:
            z = int(toxicity.SYMBOLS[min(ord(c), len(toxicity.SYMBOLS) - 1)])
            score, a, b = score + float(model[a][b][z]), b, z
        best = max(best, (score, said)) if best else (score, said)
    return best


@pytest.mark.parametrize("text", ["st0p1d", "5tuuupid", "s-t-u-p", "y0u", "a$$", "!d!0t", "s t u p i d", "p3r5on", "zz0zz", "1"])
def test_decoding_is_the_likeliest_path(model, text):
    own = toxicity.Restorer(model)
    score, said = plain_decode(model, own.lattice(text))
    got = own.decode(text)
    costs = [(sum(c for _, c in path), "".join(x for x, _ in path)) for path in itertools.product(*own.lattice(text))]
    again = max(plain_decode(model, [[(s, c)]])[0] for c, s in costs if s.strip() == got)
    assert again == pytest.approx(score, abs=1e-3), (got, said)


def plain_scores(docs, labels):
    """The operator once more in plain Python: language model, readings, weights, regression."""
    three = np.zeros(toxicity.SIZE**3, np.int64)
    for _, text in docs:
        code = toxicity._codes("  " + (text or "") + "  ")
        np.add.at(three, (code[:-2] * toxicity.SIZE + code[1:-1]) * toxicity.SIZE + code[2:], 1)

    class Counted:
        @staticmethod
        def collect():
            return [{"gram": int(i), "n": int(three[i])} for i in np.flatnonzero(three)]

    own = toxicity.Restorer(toxicity.language_model(Counted))

    def readings(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out, k = [own.word(w) for w in dict.fromkeys(words)], 0
        apart = []
        while k < len(words):
            run = k
            while run < len(words) and len(words[run]) == 1 and (words[run].isalpha() or words[run] in toxicity.SIGNS):
                run += 1
            if run - k >= 3:
                apart.extend(own.spaced(words[k:run]).split())
            k = max(run, k + 1)
        return out + list(dict.fromkeys(apart))

    y = {}
    for doc, toxic in labels:
        if doc is not None and toxic is not None and zlib.crc32(str(doc).encode()) % 5:
            y[doc] = max(toxic, y.get(doc, 0))
    train = [(readings(text), y[doc]) for doc, text in docs if doc in y]
    share = sum(v for _, v in train) / len(train)
    seen = collections.Counter(), collections.Counter()
    for words, v in train:
        seen[v].update({f for w in words for f in toxicity.features(w)})
    weights = {}
    for f, toxic in seen[1].items():
        rate = (toxic + toxicity.SHRINK * share) / (toxic + seen[0][f] + toxicity.SHRINK)
        w = math.log(rate / (1 - rate)) - math.log(share / (1 - share))
        if toxic >= toxicity.MIN_DOCS and w > 0.5:
            weights[f] = w

    def evidence(words):
        found = sorted((max((weights.get(f, 0.0) for f in toxicity.features(w)), default=0.0) for w in words), reverse=True)
        return [*(found + [0.0, 0.0])[:2], math.log1p(sum(w > toxicity.STRONG for w in found))]

    x = np.array([[1.0, *(round(e, 2) for e in evidence(words))] for words, _ in train])
    goal, beta, ridge = np.array([v for _, v in train], float), np.zeros(4), np.diag([1e-6, 1.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (goal - p) - ridge @ beta)
    return [1 / (1 + math.exp(-float(np.dot(beta, [1.0, *evidence(readings(text))])))) for _, text in docs]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("bar", "tol", "mek", "sun") for b in ("in", "or", "al") for c in ("da", "te", "mo")]
    docs, labels = [], []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 30))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["stupid", "st0pid", "stuuupid", "s-t-u-p-i-d", "s t u p i d", "STUP1D!"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs += [(900, None), (901, ""), (None, "a stupid row"), (902, "tolinda " * 20_000), (903, docs[0][1]), (903, docs[0][1])]
    labels += [(None, 1), (901, None), (3, 0), (3, 1), (3, 1)]
    return docs, labels


def frames(spark, docs, labels):
    one = spark.createDataFrame([(*r, 9, "x") for r in docs], "doc_id long, text string, toxic int, score string")
    return one, spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, toxic int, predicted int")


def test_scores_equal_plain_python(spark, table):
    docs, labels = table
    got = toxicity.toxicity(*frames(spark, docs, labels)).collect()
    want = plain_scores(docs, labels)
    held = [zlib.crc32(str("" if d is None else d).encode()) % 5 == 0 for d, _ in docs]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    mine = sorted(((d, h, s, int(s >= 0.5)) for (d, _), h, s in zip(docs, held, want)), key=key)
    assert len(got) == len(mine)
    for a, b in zip(sorted(map(tuple, got), key=key), mine):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6) and a[3] == b[3]
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[d] == int(d % 3 == 0) for d, _ in docs[:150]) and by[900] == by[901] == by[902] == 0 and by[None] == 1


def test_labels_of_the_held_out_fifth_are_not_read(spark, table):
    docs, labels = table
    turned = [(d, 1 - t if d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    one = {tuple(r) for r in toxicity.toxicity(*frames(spark, docs, labels)).collect()}
    assert one == {tuple(r) for r in toxicity.toxicity(*frames(spark, docs, turned)).collect()}


def test_without_labels_of_both_kinds(spark, table):
    docs = table[0][:20]
    for labels, score in (([], 0.0), ([(i, 1) for i in range(20)], 1.0), ([(i, 0) for i in range(20)], 0.0), ([(None, 1)], 0.0)):
        assert {r.score for r in toxicity.toxicity(*frames(spark, docs, labels)).collect()} == {score}
    assert toxicity.toxicity(*frames(spark, [], [(1, 1), (2, 0)])).collect() == []
