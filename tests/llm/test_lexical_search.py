"""Ranked lexical search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assayloom.llm import lexical_search

SCHEMA = "doc_id long, text string, term array<int>, n string, score int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    docs = [(d, Counter(cut(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, total, df = len(docs), sum(x for *_, x in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c, size in docs:
            m = 100 - 75 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(k))
    docs = [(i, text(rng.choice([1, 3, 20, 60]))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(15)] + [docs[5], docs[5], (None, docs[3][1]), (None, None), (-1, None), (-2, ""), (-3, " .,!"), (-4, "Été ÉTÉ naïve-Été\x00w3"), (-5, "w1 " * 40_000)]
    items = [(i, text(rng.choice([1, 2, 8, 30]))) for i in range(25)] + [(25, None), (26, ""), (27, "?!"), (28, "unheard of"), (29, "été Été W3 w3"), (30, docs[3][1]), (31, docs[3][1]), (30, docs[3][1]), (30, "w7"), (None, "w9 w9 w9 w1")]
    return docs, items


@pytest.mark.parametrize("top, pairs", [(10, 1 << 20), (3, 40)])
def test_against_brute_force(spark, monkeypatch, top, pairs):
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    docs, items = corpus(top, 120)
    table = spark.createDataFrame([(*d, None, "x", 1) for d in docs], SCHEMA).repartition(4)
    got = lexical_search.search(table, spark.createDataFrame(items, "item_id long, text string"), top).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items, top)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(8, 60)
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 900)
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items)


def test_bounds_prune_and_lose_nothing(spark):
    """Terms that no item must look up leave documents unscored, and the bound is never above the kth score."""
    docs, items = corpus(5, 400)
    texts = [(i, t) for i, (_, t) in enumerate(items) if t and i < 25]
    block = lexical_search.Block.of(texts)
    postings = lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string"), block)
    weights = lexical_search.weigh(postings, block)
    rows = lexical_search.plan(spark, block, lexical_search.best_impacts(postings, block, weights, 5)).collect()
    kth = {q: min(s for *_, s in own) for q in range(25) if len(own := [r for r in brute(docs, texts, 5) if r[0] == q]) == 5}
    assert all(r.least <= kth[r.item] for r in rows if r.item in kth) and any(r.least > 0 for r in rows)
    assert any(not r.essential for r in rows) and {r.item for r in rows if r.essential} == {q for q, _ in texts}


def test_terms_and_empty_tables(spark):
    assert [t.decode() for t in lexical_search.terms("Don't STOP-é_É9\x00z~Ünder")] == ["don", "t", "stop", "é", "É9", "z", "Ünder"]
    assert lexical_search.terms(None) == []
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0 == lexical_search.search(docs, items.limit(0)).count()
    assert [tuple(r) for r in lexical_search.search(docs, items).collect()] == [(1, 1, 1, lexical_search.weight(1, 1) * (1000000000 // (1000 + 800)))]
    assert np.array_equal(lexical_search._places(np.array([1, 1, 2, 5, 5, 5])), [0, 1, 0, 0, 1, 2])
