"""Token ids, counts and byte-level coding against the libraries they stand for."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer
from wardline.llm import bytebpe, counts, packing, tokens

SF = "/root/testdata/sf0.001"
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LETTERS = "abеé'sßΣİ.!#<|> \n\t1٣́ 日T▁\\"
rng = random.Random(7)
ODD = [
    "", " ", "a" * 3000, "日本語" * 300, "don't they'll I'LL 's ''", "<|endoftext|>x<|ENDOFTEXT|> a<|startoftext|>",
    "éa ́b İstanbul ΣΑΣ ﬁ ß Ǆ", "x y　z \x00\x01 a\x1cb", "\U0001f600\U0001f468‍\U0001f469 ...!!!###",
    "1234 12.34 a1b2 c3-po's", "  lead\n\ntrail \t", "word,word.word!", "▁ ▁▁a",
] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 50))) for _ in range(150)]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(WORDS)
    found.no_truncation()
    return found


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]


def test_ids(library, texts):
    ids, n = tokens.WordEncoder(WORDS).encode(pa.array([*texts, None]))
    ends = np.cumsum(n)
    for text, start, end in zip([*texts, ""], ends - n, ends):
        assert ids[start:end].tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_with_a_small_memory(library, texts, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PARTS", 50)
    own = tokens.WordEncoder(WORDS)
    for text in texts:
        ids, _ = own.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_full_memory_keeps_frequent_words(library, monkeypatch):
    """Words of every batch are encoded once, however often rare ones fill the memory."""
    monkeypatch.setattr(tokens, "MAX_PARTS", 100)
    own, encoded = tokens.WordEncoder(WORDS), []
    store = own._store
    monkeypatch.setattr(own, "_store", lambda parts, joined: (encoded.extend(parts), store(parts, joined)))
    common = [f"often{a}{b}" for a in "abcd" for b in "xyz"]
    common = [*common, "a1b2", "don't"]
    for batch in range(30):
        rare = [f"rare{'abcdefghij'[batch % 10]}{'klm'[batch // 10]}{c}" for c in "abcdefghijklmnopqrst"]
        text = " ".join([*common, *rare, "end."])
        ids, n = own.encode(pa.array([text, "", f"{rare[0]}!"]))
        expected = [library.encode(t, add_special_tokens=False).ids for t in (text, "", f"{rare[0]}!")]
        assert ids.tolist() == sum(expected, []) and n.tolist() == list(map(len, expected))
        assert len(own.parts) <= 100 + 50 == 3 * tokens.MAX_PARTS // 2
        assert len(own.parts) == len(own.starts) == len(own.lengths) == len(own.uses)
    assert all(encoded.count(word) == 1 for word in [*common, "end", "."])


def test_what_is_kept_of_a_full_memory_is_bounded(library, monkeypatch):
    """Also where every word comes again."""
    monkeypatch.setattr(tokens, "MAX_PARTS", 40)
    own = tokens.WordEncoder(WORDS)
    words = [f"word{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    for start in [0, 30, 60, 0, 30, 60, 0, 0, 30]:
        text = " ".join(words[start : start + 30])
        assert own.encode(pa.array([text, text]))[0].tolist() == 2 * library.encode(text, add_special_tokens=False).ids
        assert len(own.parts) <= 40 + 30


def test_counts_at_every_prefix(library, texts):
    own = counts.PrefixCounts(WORDS)
    for word in {w for t in texts for w in t.split()}:
        assert own.word(word) == len(library.encode(word, add_special_tokens=False).ids), word
    for word in ["internationalisation", "worthless", "thththth", "aaaaaaaaaaaab"]:
        want = [len(library.encode(word[:n], add_special_tokens=False).ids) for n in range(len(word) + 1)]
        assert own.ends(word) == want
        assert [own.word(word[:n]) if n else 0 for n in range(len(word) + 1)] == want


def test_token_counts_query(spark, library, texts):
    rows = [(i, t) for i, t in enumerate([*texts, None])] + [(None, "a b"), (0, ""), (0, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = counts.token_counts(df, WORDS, limit=40).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, text in rows:
        text, r = text or "", by[doc]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 40)
        assert len(library.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 40
        assert n > 40 or r.fit_chars == len(text)
    assert counts.token_counts(df.limit(0), WORDS).collect() == []


def test_truncation_is_the_longest(spark, library):
    text = "internationalisation worthless unbelievably " * 5
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for limit in (1, 2, 5, 9, 12):
        want = max(n for n in range(len(text)) if len(library.encode(text[:n], add_special_tokens=False).ids) <= limit)
        assert counts.token_counts(df, WORDS, limit).first().fit_chars == want


def test_the_programs_own_counts_of_latin_words(library):
    """Without the library's word: every word of the documents whose letters are Latin."""
    own = counts.PrefixCounts(WORDS)
    own.library = None
    docs = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    words = sorted({w for t in docs for w in (t or "").split() if max(w) <= counts.LATIN})
    assert len(words) > 10_000 and sum(not w.isascii() for w in words) > 2_000
    for word in words:
        assert own.word(word) == len(library.encode(word, add_special_tokens=False).ids), word


def test_stored_prefixes_answer_any_budget(spark, library, texts):
    rows = [(i, t) for i, t in enumerate([*texts, None, "", " \n"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, upto int")
    table = counts.prefix_counts(df, WORDS).cache()
    for budget in (0, 1, 7, 40, 10**6):
        for r in counts.within_budget(table, budget).collect():
            text = rows[r.doc_id][1] or ""
            assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
            fits = [0]
            for m in counts.WORD.finditer(text):
                if len(library.encode(text[: m.end()], add_special_tokens=False).ids) > budget:
                    break
                fits.append(m.end())
            assert r.fit_chars == fits[-1]
            assert r.fit_tokens == len(library.encode(text[: fits[-1]], add_special_tokens=False).ids) <= budget


def test_byte_level_round_trip(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in enumerate([*texts, None])] + [(None, "a b"), (0, texts[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = bytebpe.round_trip_digests(df, BYTES, P.PATTERN).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, text in rows:
        ids = np.array(plain.encode_ordinary(text or ""), "<u4")
        assert by[doc].n_tokens == len(ids)
        assert by[doc].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert by[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bytebpe.round_trip_digests(df.limit(0), BYTES, P.PATTERN).collect() == []


def test_pieces_of_documents(spark, library):
    rows = [(1, "a b c"), (2, None), (2, ""), (None, "x " * 50), (3, "worthless " * 23)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, piece int")
    got = packing.cut_documents(df, WORDS, capacity=20).orderBy("doc_id", "piece").collect()
    for doc, text in rows:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        parts = [r for r in got if r.doc_id == doc]
        if doc == 2:
            assert [np.frombuffer(r.ids, "<u4").tolist() for r in parts] == [[0], [0]]
            continue
        assert [i for r in parts for i in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert all(r.length == 20 for r in parts[:-1]) and [r.start for r in parts] == [20 * r.piece for r in parts]
