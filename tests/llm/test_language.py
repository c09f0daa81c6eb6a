"""Language identification: the field against enumeration, its gradient, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pytest

from assayloom.llm import language, queries


@pytest.mark.parametrize("n, k", [(1, 1), (1, 3), (6, 3), (7, 2), (9, 2)])
def test_forward_backward_against_enumeration(n, k):
    rng = np.random.default_rng(n * k)
    scores, move, start = rng.normal(size=(n, k)) * 3, rng.normal(size=(k, k)) * 2, rng.normal(size=k)
    first = np.r_[True, rng.random(n - 1) < 0.3]
    p, moves, total = language.forward_backward(scores, first, move, start)
    want, pairs, z = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for y in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[t, y[t]] + (start[y[t]] if first[t] else move[y[t - 1], y[t]]) for t in range(n)))
        z += w
        for t in range(n):
            want[t, y[t]] += w
            if not first[t]:
                pairs[y[t - 1], y[t]] += w
    assert np.allclose(p, want / z) and np.allclose(moves, pairs / z) and np.isclose(total, np.log(z))


def test_long_chains_equal_the_plain_recursion():
    rng = np.random.default_rng(3)
    n, k = 5000, 4
    scores, move, start = rng.normal(size=(n, k)) * 6, np.eye(k) * 9, np.zeros(k)
    first = np.r_[True, rng.random(n - 1) < 0.002]
    p, _, _ = language.forward_backward(scores, first, move, start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    e, m, s = np.exp(scores), np.exp(move), np.exp(start)
    for t in range(n):
        a[t] = (s if first[t] else a[t - 1] @ m) * e[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = (s @ (e[t + 1] * b[t + 1])) if first[t + 1] else m @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    want = a * b
    assert np.allclose(p, want / want.sum(axis=1, keepdims=True), atol=1e-12)


def test_gradient():
    rng = np.random.default_rng(5)
    vocabulary = [b"the", b"und", "été".encode(), b"a", b"thethe"]
    model = language.Model(["x", "y", "z"], {b"the": 0, b"a": 1}, rng.normal(size=(language.BUCKETS + 2, 3)) * 0.1, rng.normal(size=3), rng.normal(size=(3, 3)), rng.normal(size=3))
    chain, label, first = rng.integers(0, 5, 40), rng.integers(0, 3, 40), np.r_[True, rng.random(39) < 0.2]
    occurrences = model.occurrences(vocabulary)
    loss, gradient = language.loss_and_gradient(model, occurrences, chain, first, label, 5)
    for values, slope in zip((model.weights, model.bias, model.move, model.start), gradient, strict=True):
        for at in [np.unravel_index(i, slope.shape) for i in np.argsort(-abs(slope), axis=None)[:4]] + [np.unravel_index(slope.size // 2, slope.shape)]:
            values[at] += 1e-5
            more = language.loss_and_gradient(model, occurrences, chain, first, label, 5)[0]
            values[at] -= 1e-5
            assert abs((more - loss) / 1e-5 - slope[at]) < 1e-4


def test_words():
    assert language.words("Don't É2é—x  ١٢") == [b"don", b"t", "é".encode(), "é—x".encode(), "١٢".encode()]
    assert [language.has_letter(w) for w in (b"a", "é".encode(), "—".encode(), "—a".encode(), "١٢".encode(), "—日".encode())] == [True, True, False, True, False, True]
    owner, bucket = language.features([b"ab", b"abcde", b"ab"])
    assert bucket[owner == 0].tolist() == bucket[owner == 2].tolist() and len(bucket[owner == 0]) == 5 and len(bucket[owner == 1]) == 15


@pytest.fixture(scope="module")
def rows(spark):
    return queries.op11_language_id(spark, "/root/testdata/sf0.1").collect()


def test_held_out_accuracy(spark, rows):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    for lang in {*truth.values()}:
        own = [r.lang_pred == lang for r in rows if r.held_out and truth[r.doc_id] == lang]
        assert len(own) > 200 and np.mean(own) > 0.985


def test_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs)
    held = docs.where(language.crc_held_out(docs.doc_id)).orderBy("doc_id").limit(400).collect()
    by = {lang: [w for r in held if r.lang == lang for w in r.text.split()[:60]] for lang in ("en", "de")}
    text = " ".join(by["en"][:40] + by["de"][:40] + by["en"][40:80])
    runs = language.language_runs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).collect()
    found = sorted(runs)[0].runs
    assert sum(r.words for r in found if r.lang in ("en", "de")) > 0.95 * len(language.words(text)) and len(found) <= 6 and sorted(runs)[1].runs == []
    label = [r.lang for r in found for _ in range(r.words)]
    third = len(label) // 3
    assert all(np.mean([x == lang for x in label[i * third + 4 : (i + 1) * third - 4]]) > 0.9 for i, lang in enumerate(("en", "de", "en")))


def test_odd_rows(spark, monkeypatch):
    docs = [(i, f"the of and {w} with", "en", "x", 1) for i, w in enumerate("on in to at by it as".split())] + [(20 + i, f"der die {w} und nicht", "de", "x", 1) for i, w in enumerate("von zu am im ein den".split())]
    odd = [(50, None, "en", "x", 1), (51, "", "de", "x", 1), (52, "12 — !", "en", "x", 1), (None, "und der", "de", "x", 1), (53, "the of", None, "x", 1), (54, "the and with " * 30_000, None, "x", 1), (0, "the of and on with", "en", "x", 1)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string, score string, lang_pred int").repartition(3)
    got = sorted(map(tuple, language.document_languages(df).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(docs) + len(odd) and [by[i][2:] for i in (50, 51, 52)] == [("und", 0.0)] * 3
    assert by[None][1:3] == (False, "de") and by[53][2] == by[54][2] == "en" and by[54][3] > 0.9 and len([r for r in got if r[0] == 0]) == 2
    monkeypatch.setattr(language, "CHAIN", 1000)  # the long text in many chains, over several calls
    monkeypatch.setattr(language, "REMEMBERED", 2)
    labeller = language.Labeller(language.fit(df))
    share, n = labeller.shares(["the and with " * 2_000, "", "und der", None])
    assert n.tolist() == [6000, 0, 2, 0] and share[0].argmax() == 1 and share[2].argmax() == 0
    alone = language.document_languages(df.where("lang is null"))
    assert {r[2:] for r in map(tuple, alone.collect())} == {("und", 0.0)} and language.document_languages(df.limit(0)).count() == 0
