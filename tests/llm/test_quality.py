"""The quality classifier: features, held-out accuracy and odd rows."""

import math
import zlib

import numpy as np
import pyarrow as pa

from assayloom.llm import quality, queries, text


def test_features_do_not_cross_texts():
    texts = ["one two two", "", None, "  three\n", "É !! x" * 3]
    alone = [quality.sparse_counts(*text.string_buffers(pa.array([t], pa.string())))[0] for t in texts]
    together = quality.sparse_counts(*text.string_buffers(pa.array(texts, pa.string())))
    for (a, b), (c, d) in zip(alone, together, strict=True):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
    score = np.random.default_rng(0).normal(size=quality.BUCKETS)
    total, count = quality.document_sums(*text.string_buffers(pa.array(texts, pa.string())), score)
    for (b, c), t, n in zip(alone, total, count, strict=True):
        assert abs(score[b] @ c - t) < 1e-9 and c.sum() == n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 500 and np.mean([p == y for p, y in held]) > 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "some words here", "a"), (2, None, "b"), (3, "", None), (None, "words", "c"), (5, "a " * 40_000, "d"), (5, "a " * 40_000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 0), (7, 0, 0), (1, 1, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        rows = quality.quality_scores(docs, l).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        kept = quality.accepted(docs.withColumnRenamed("score", "lang"), l)
        assert kept.columns == ["doc_id", "text", "lang"]
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels.limit(0)).count() == 6


def plain_gradient(embed, output, bias, features, y):
    """Loss of one document and its gradients, number by number; features: bucket -> share."""
    width = len(output)
    mean = [sum(s * embed[b][k] for b, s in features.items()) for k in range(width)]
    z = [sum(mean[k] * output[k][c] for k in range(width)) + bias[c] for c in (0, 1)]
    norm = math.log(sum(math.exp(v) for v in z))
    g = [math.exp(z[c] - norm) - (c == y) for c in (0, 1)]
    down = [sum(output[k][c] * g[c] for c in (0, 1)) for k in range(width)]
    return norm - z[y], {b: [s * d for d in down] for b, s in features.items()}, [[mean[k] * g[c] for c in (0, 1)] for k in range(width)], g


def test_training_against_a_plain_trainer(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 7)
    rng = np.random.default_rng(1)
    examples = []
    for i in range(9):
        bucket = np.sort(rng.choice(7, rng.integers(1, 5), replace=False))
        examples.append((bucket, rng.integers(1, 4, len(bucket)), int(i % 3 == 0)))
    examples.append((np.zeros(0, np.int64), np.zeros(0, np.int64), 1))
    width, epochs, rate = 3, 2, 0.4
    got = quality.train(examples, 5, epochs, rate, width)
    rng = np.random.default_rng(5)
    embed, output, bias = rng.uniform(-1 / width, 1 / width, (7, width)).tolist(), [[0.0, 0.0] for _ in range(width)], [0.0, 0.0]
    labels = [y for *_, y in examples]
    weight = [min(4.0, len(labels) / (2 * labels.count(c))) for c in (0, 1)]
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            bucket, count, y = examples[i]
            lr = rate * (1 - step / (epochs * len(examples)))
            step += 1
            if not len(bucket):
                continue
            shares = {int(b): float(c) / float(count.sum()) for b, c in zip(bucket, count, strict=True)}
            _, to_embed, to_output, to_bias = plain_gradient(embed, output, bias, shares, y)
            spread = sum(s * s for s in shares.values())
            for b, d in to_embed.items():
                embed[b] = [e - lr * weight[y] * x / spread for e, x in zip(embed[b], d, strict=True)]
            output = [[output[k][c] - lr * weight[y] * to_output[k][c] for c in (0, 1)] for k in range(width)]
            bias = [bias[c] - 0.1 * lr * weight[y] * to_bias[c] for c in (0, 1)]
    want = [sum(embed[b][k] * (output[k][1] - output[k][0]) for k in range(width)) for b in range(7)]
    assert np.allclose(got.margin, want) and np.isclose(got.bias, bias[1] - bias[0])


def test_the_plain_trainers_gradient_is_the_losses():
    rng = np.random.default_rng(2)
    embed, output, bias, features = rng.normal(size=(4, 3)).tolist(), rng.normal(size=(3, 2)).tolist(), [0.3, -0.2], {0: 0.5, 2: 0.25, 3: 0.25}
    loss, to_embed, to_output, to_bias = plain_gradient(embed, output, bias, features, 1)
    for values, slopes in ((embed, [to_embed.get(b, [0, 0, 0]) for b in range(4)]), (output, to_output), ([bias], [to_bias])):
        for row, slope in zip(values, slopes, strict=True):
            for k, s in enumerate(slope):
                row[k] += 1e-6
                more = plain_gradient(embed, output, bias, features, 1)[0]
                row[k] -= 1e-6
                assert abs((more - loss) / 1e-6 - s) < 1e-4
