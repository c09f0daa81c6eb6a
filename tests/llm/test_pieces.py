"""Sampled SentencePiece segmentations: lossless, reproducible, and drawn from the lattice's distribution."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from assayloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", "  lead", "trail  ", "a  b\n c ▁ x\t", "ﬁ Å 日本語 😀 \x00 z", None, " ", "▁", "▁▁ ▁", "word " * 5, "x" * 3000, "é" * 40, "it's (fine). http://a.b/c?d=e;\n\n end"]


@pytest.fixture(scope="module")
def model():
    return pieces.Sampler(PATH)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def sampled(model, texts, keys):
    ids, n = model.sample(pa.array(texts, pa.string()), keys)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_lossless_and_the_library_agrees(model, library):
    keys = pieces._seeds(np.arange(len(TEXTS)), 3)
    lists = sampled(model, TEXTS, keys)
    data, ends = model.decode(np.array([i for x in lists for i in x], np.int32), np.array(list(map(len, lists))))
    for k, (text, ids) in enumerate(zip(TEXTS, lists, strict=True)):
        assert data[ends[k] : ends[k + 1]].tobytes().decode() == (text or "") == library.decode(ids)


def test_distribution(model, library):
    """Every segmentation of a word comes as often as its weight says."""
    weight = {}
    for n, (_, ids, logs, _) in enumerate(model.tables, 1):
        weight.update({library.id_to_piece(int(i)): float(np.exp(w)) for i, w in zip(ids, logs, strict=True) if len(library.id_to_piece(int(i))) == n})
    word, want = "▁ofthe", {}

    def walk(at, path, p):
        if at == len(word):
            want[tuple(path)] = p
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in weight:
                walk(end, [*path, word[at:end]], p * weight[word[at:end]])

    walk(0, [], 1.0)
    total = sum(want.values())
    many = 20_000
    got = Counter(tuple(map(library.id_to_piece, ids)) for ids in sampled(model, ["ofthe"] * many, pieces._seeds(np.arange(many), 9)))
    assert set(got) <= set(want) and len(want) > 8
    for path, p in want.items():
        share = p / total
        assert abs(got[path] / many - share) < 5 * np.sqrt(share * (1 - share) / many) + 1e-4


def test_reproducible_and_independent_of_batches(model):
    texts = ["the same words of the very same text, again and again"] * 3
    keys = pieces._seeds(np.array([7, 8, 7]), 1)
    together = sampled(model, texts, keys)
    fresh = pieces.Sampler(PATH)
    assert [sampled(fresh, [t], k)[0] for t, k in zip(texts, np.split(keys, 3), strict=True)] == together
    assert together[0] == together[2] != together[1]


def test_frames(spark, sf):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, TEXTS[3], "x")], "doc_id long, text string, n_pieces string")
    rows = pieces.decode(pieces.encode(docs.repartition(3), PATH), PATH).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.decoded == r.text and (r.pieces is None) == (r.text is None) for r in rows)
    assert pieces.encode(docs.limit(0), PATH).count() == 0
    got = queries.op1_sentencepiece_sampling(spark, sf).collect()
    again = {r.doc_id: r for r in pieces.sampled_digests(spark.read.parquet(f"{sf}/documents.parquet").repartition(5), PATH).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.lossless and again[r.doc_id] == r for r in got)
    assert {(r.doc_id, r.n_pieces) for r in pieces.sampled_digests(docs, PATH).collect()} >= {(0, 0), (6, 0)}


def test_long_texts_without_cuts(model, library):
    texts = ["数学是研究数量结构" * 8_000, "é" * 60_000, "x" * 60_000]
    lists = sampled(model, texts, pieces._seeds(np.arange(3), 3))
    for text, ids in zip(texts, lists, strict=True):
        assert library.decode(ids) == text and len(ids) > 1000
