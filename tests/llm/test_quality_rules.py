"""Counts of the quality rules against plain Python, and what the robust fit rejects."""

import collections
import re

import pytest
from wardline.llm import quality
from wardline.llm.base import staged

SF = "/root/testdata/sf0.001"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    count = collections.Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked))


def result(df):
    return {r["doc_id"]: r for r in quality.quality_rules(df).collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = result(docs)
    good = bad = good_kept = bad_kept = 0
    for r in docs.collect():
        own = got[r.doc_id]
        want = plain_counts(r.text)
        assert tuple(own[c] for c in COUNTS) == want
        assert own.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (own.base_failed and own.kept)
        if not own.base_failed and r.doc_id in labels:
            good, good_kept = good + labels[r.doc_id], good_kept + labels[r.doc_id] * own.kept
            bad, bad_kept = bad + 1 - labels[r.doc_id], bad_kept + (1 - labels[r.doc_id]) * own.kept
    assert good_kept == good and bad_kept <= 0.1 * bad


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "\n \n", "en", None), (4, words, "en", "a"), (4, words, "en", "a"),
        (None, words, None, "b"), (5, "a b a b a b", "en", "a"), (6, words + " | ###" * 50, "en", "a"),
        (7, "é ß\x0b日本 x\n" * 30_000, "de", "a"), (8, "a b c a b c a", "en", "a"),
    ]
    docs = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_words int, kept string"
    )
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc, text, *_ in rows:
        assert tuple(by[doc][c] for c in COUNTS) == plain_counts(text)
    assert by[4].kept and by[None].kept and not by[6].kept and not by[1].kept


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string, lang string, source string")) == {}


def test_junk_up_to_nearly_half_of_a_group_is_rejected(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k * (i % 5 + 1)) % 997}" for k in range(80 + i % 40)), "en", "a") for i in range(150)]
    rows += [(1000 + i, " ".join(f"### | w{k + i}%" for k in range(60)), "en", "a") for i in range(120)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert all(got[i].kept for i in range(150))
    assert not any(got[1000 + i].kept for i in range(120))


@pytest.mark.parametrize("dof", [4, 6])
def test_chi_square(dof):
    for p in (0.1, 0.5, 0.975, 1 - 1e-6):
        assert quality.chi2_cdf(quality.chi2_quantile(p, dof), dof) == pytest.approx(p, abs=1e-9)


def plain_fit(cells):
    """Minimum covariance determinant over (vector, documents), the operator's steps in plain Python."""
    import numpy as np

    scale = quality.consistency(quality.HALF, 4)
    floor = np.array([(f / s) ** 2 for f, s in zip(quality.FLOOR, quality.STEP)])
    x, w = np.array([c for c, _ in cells], float), np.array([n for _, n in cells])

    def moments(weight, factor):
        t = max(weight.sum(), 1)
        mean = (weight[:, None] * x).sum(0) / t
        return mean, ((weight[:, None] * x).T @ x / t - np.outer(mean, mean)) * factor + np.diag(floor)

    def distance(mean, cov):
        y = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
        return (y**2).sum(0)

    def inner(d2):
        before = np.array([w[d2 < d].sum() for d in d2])
        return np.where(before < np.ceil(w.sum() * quality.HALF), w, 0)

    medians = []
    for k in range(4):
        order = np.argsort(x[:, k], kind="stable")
        medians.append(x[order[np.searchsorted(2 * np.cumsum(w[order]), w.sum())], k])
    away = (((x - medians) * np.array(quality.STEP) / np.array(quality.FLOOR)) ** 2).sum(1)
    best = None
    for start, d2 in enumerate((away, np.zeros(len(x)))):
        for _ in range(quality.STEPS + 1):
            mean, cov = moments(inner(d2), scale)
            d2 = distance(mean, cov)
        best = min(best or (np.inf,), (np.prod(np.diag(np.linalg.cholesky(cov))), start, d2), key=lambda b: b[:2])
    near = np.where(best[2] <= quality.chi2_quantile(0.975, 4), w, 0)
    return moments(near, quality.consistency(0.975, 4))


def test_verdict_is_that_of_a_plain_estimate(spark):
    """Every document of the table by counts, vectors, groups, estimates and distances in plain Python."""
    import math

    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    units = lambda v: math.floor(v * quality.GRID + 0.5)
    rows = []
    for r in docs.collect():
        n, chars, symbols, dup, repeat = plain_counts(r.text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (r.text or "").split("\n"))
        vector = (units((symbols / max(n, 1)) ** 0.5), units(math.log(max(chars / max(n, 1), 1.0))), units(repeat / max(n, 1)), units(dup / max(lines, 1)))
        rows.append((r.doc_id, r.lang, r.source, n < 50 or 100 * repeat > 50 * n, vector))
    fits = {}
    good = [r for r in rows if not r[3]]

    def group(key):
        if key not in fits:
            own = collections.Counter(
                tuple(math.floor(v / s + 0.5) for v, s in zip(r[4], quality.STEP))
                for r in good if all(k is ... or k == own for k, own in zip(key, r[1:3]))
            )
            fits[key] = plain_fit(list(own.items())), sum(own.values())
        return fits[key]

    got = result(docs)
    judged = quality.with_verdict(staged(quality.with_counts(docs), "test-quality"))
    far = {r.doc_id: r.distance2 for r in judged.select("row.doc_id", "distance2").collect()}
    cutoff, close, wrong = quality.chi2_quantile(1 - quality.REJECT_BELOW, 4), 0, []
    for doc, lang, source, failed, vector in rows:
        key = next(k for k in ((lang, source), (lang, ...), (..., ...)) if group(k)[1] >= quality.MIN_GROUP or k == (..., ...))
        (mean, cov), _ = group(key)
        y = np.linalg.solve(np.linalg.cholesky(cov), np.array(vector) / np.array(quality.STEP) - mean)
        d2 = float((y**2).sum())
        if abs(d2 - cutoff) < 1e-6 * cutoff:
            close += 1
        elif got[doc].kept != (not failed and d2 <= cutoff):
            wrong.append((doc, d2))
        if not failed:
            assert far[doc] == pytest.approx(d2, rel=1e-6, abs=1e-6)
    assert not wrong and close < 5
