"""Near duplicates against all pairs, components, and odd rows."""

import re

import numpy as np
import pytest

from assayloom.llm import components, minhash, queries, store
from assayloom.llm.minhash import Banding

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = Banding(shingle=3, percent=85, bands=26, rows=5)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(texts, k, percent):
    """id -> (set size, component) by all pairs."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    comp, ids = {i: i for i in sets}, sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                lo, hi = sorted((comp[i], comp[j]))
                comp = {x: lo if c == hi else c for x, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def crowd(groups=6, size=60, seed=2):
    """Copies of a few texts with so many words changed that pairs lie around the threshold, so that stars miss links."""
    rng = np.random.default_rng(seed)
    out = {}
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(size):
            w = list(base)
            for at in rng.choice(len(w), rng.integers(0, 6), replace=False):
                w[at] = f"v{rng.integers(0, 9)}"
            out[len(out)] = " ".join(w)
    return out


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    want = brute({r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, 3, 85)
    got = queries.op2_minhash_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("tile", [16, 1024])
def test_pairs_around_the_threshold(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE_MAX", tile)
    texts = crowd()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, banding=WIDE).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 3, 85)


def test_signatures_estimate_similarity():
    rng, b = np.random.default_rng(1), Banding(bands=32, rows=4)
    donors = minhash._donors(b.bins, 64 * b.bins)
    for n in (3, 40, 400):
        errors = []
        for _ in range(200):
            pool = rng.integers(0, 2**63, n + n // 4, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            x, y = np.unique(pool[:n]), np.unique(pool[n // 4 :])
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append((minhash.signature(x, b.bins, donors) == minhash.signature(y, b.bins, donors)).mean() - true)
        assert abs(np.mean(errors)) < 0.04


def test_odd_rows(spark):
    rows = [(1, "One two THREE four"), (2, "one two three  four\n"), (3, None), (4, ""), (5, " \t"), (None, "one two three four"), (6, "a"), (7, "A"), (8, "É x"), (9, "é x"), (10, "long " * 40_000), (10, "long " * 40_000), (12, "one two"), (12, "one two three four")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, rep string, n int, fp string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, banding=WIDE).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 2, None, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True), (10, 1, 10, True), (10, 1, 10, True), (12, 2, 1, False), (12, 2, 1, False)]
    assert [x if x[0] is not None else (None, 2, None, True) for x in got] == sorted(want, key=str)
    kept = minhash.one_of_each(docs, banding=WIDE)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(400).tolist()
    links = list(zip(ids[:200], ids[1:200], strict=False)) + [(ids[250], x) for x in ids[251:400]] + [(5, 5), (None, 3), (3, None), (ids[0], ids[1])]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: min(ids[:200]) for x in ids[:200]} | {x: min(ids[250:400]) for x in ids[250:400]}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_meet_every_open_pair_once_and_grow_with_the_rest_alone(spark, monkeypatch):
    members = [(k, r, c) for k, comps in ((1, [7] * 40 + [8, 9, 9]), (2, [1] * 6 + [2] * 5 + [3] * 9), (3, [4, 4])) for r, c in enumerate(comps, 100 * k)]
    rows = spark.createDataFrame(members, "key long, rep long, comp long").repartition(3)
    assert {r.key: r["count"] for r in minhash._tiles(rows).groupBy("key").count().collect()} == {1: 43, 2: 20}
    monkeypatch.setattr(minhash, "TILE_MAX", 4)
    met, sizes = {}, {}
    for r in minhash._tiles(rows).collect():
        met.setdefault((r.key, r.tile), []).append(r)
    pairs = []
    for (key, _), group in met.items():
        assert len(group) <= 16
        low, high = [r for r in group if r.side & 1], [r for r in group if r.side & 2]
        pairs += [(key, *sorted((a.rep, b.rep))) for a in low for b in high if a.comp != b.comp and (a.side != 3 or a.rep < b.rep)]
        sizes[key] = sizes.get(key, 0) + len(group)
    want = [(k, a, b) for k, a, x in members for j, b, y in members if k == j and a < b and x != y]
    assert sorted(pairs) == sorted(want) and 3 not in sizes and sizes[1] == 40 + 3 * (10 + 1)


def test_rows_of_buckets_with_one_member_are_not_shuffled_to_their_join(spark, monkeypatch):
    """At 0.51 GB the pipeline's join of all bands' rows took more than an executor's memory; nearly all of them have no partner."""
    written, saved = {}, minhash.saved

    def spy(df, label):
        written[label] = df._jdf.queryExecution().executedPlan().toString()
        return saved(df, label)

    monkeypatch.setattr(minhash, "saved", spy)
    texts = crowd(2, 20) | {1000 + i: " ".join(f"u{i}x{k}" for k in range(30)) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, banding=WIDE).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 3, 85)
    assert "SortMergeJoin" not in written["members"] and "hashpartitioning" not in written["members"]


@pytest.mark.parametrize("most", [0, 500_000])
def test_shared_buckets_of_any_number(spark, monkeypatch, most):
    monkeypatch.setattr(store, "BROADCAST_ROWS", most)
    texts = crowd(2, 20)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(docs, banding=WIDE).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, 3, 85)
