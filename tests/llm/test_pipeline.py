"""The pipeline stage by stage against brute force, and on odd rows."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from assayloom.llm import mixing, secrets
from assayloom.llm.store import saved

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(saved(stage(spark, frames[-1], SF), name))
    return frames


def words(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_columns(stages):
    assert all(f.columns == stages[0].columns and f.dtypes == stages[0].dtypes for f in stages[1:-1])
    assert "doc_id" in stages[-1].columns


def test_quality_stage(spark, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    truth = [(r.doc_id in kept, r.quality == 1) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert sum(k for k, good in truth if good) >= 0.99 * sum(good for _, good in truth)
    assert sum(k for k, good in truth if not good) <= 0.1 * sum(not good for _, good in truth)


def test_near_duplicate_stage(stages):
    sets = {r.doc_id: words(r.text) for r in stages[1].collect()}
    kept, group = {r.doc_id for r in stages[2].collect()}, {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and top(i) != top(j):
                group[max(top(i), top(j))] = min(top(i), top(j))
    assert kept == {i for i in ids if top(i) == i}


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = stages[3].collect()
    assert len(after) == len(before)
    for r in after:
        old = before[r.doc_id]
        found = secrets.scan(old.text or "")
        assert (r.text == old.text) == (not any(found)) and not any(secrets.scan(r.text)[0])
        assert r.n_chars == (len(r.text) if any(found) else old.n_chars)


def test_mixing_stage(stages):
    docs, mixed = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for r in docs}
    sums, took, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs:
        sums[r.source] += size[r.doc_id]
        took[r.source] += size[r.doc_id] * mixed[r.doc_id]
        longest[r.source] = max(longest[r.source], size[r.doc_id])
        assert mixed[r.doc_id] <= 2
    names = sorted(sums)
    import numpy as np

    target = mixing.capped_targets(np.array([sums[s] for s in names]), np.array([(5, 2, 1)[i % 3] for i in range(len(names))], float), 1.5 * sum(sums.values()), 2.0)
    for s, t in zip(names, target, strict=True):
        assert abs(took[s] - t) <= longest[s] + mixing.BLOCK_WORDS


def test_run_is_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.dtypes == stages[-1].dtypes and sorted(map(str, rows.collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_rows(spark):
    odd = [(1, None, None, None, None), (None, "a few words here", "en", "a", 16), (2, "", "en", "b", 0), (3, "w " * 30_000, "en", "a", 60_000), (4, "same text of some words", "en", "a", 23), (4, "same text of some words", "en", "a", 23), (5, "Same text of some words", None, None, 23)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, rep string, n int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = saved(stage(spark, frame, SF), f"odd-{name}")
            if name != "sentencepiece":
                assert out.columns == docs.columns
            if name == "near_duplicates":
                assert frame.isEmpty() or sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4]
            if name in ("quality", "secrets"):
                assert out.count() <= frame.count()
