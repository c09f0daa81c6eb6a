"""Operator 6: a quality classifier of supervised subword embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import SMALL_BATCH_BYTES, bounded_batches, saved
from .text import IS_SPACE, LOWER, chain, mix, slices, string_buffers, tidy, word_hashes, words

#: Hash buckets of the features, embedding width, labelled rows of each class that training sees at most.
BUCKETS, WIDTH, PER_CLASS = 1 << 16, 8, 2000
#: Passes over the sample and the first learning rate.
EPOCHS, RATE = 8, 0.5


def _fold(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 16)).astype(np.int64)


def feature_stream(data: np.ndarray, offsets: np.ndarray):
    """(bucket, place) arrays of every feature occurrence in some texts; place: the byte in data at which it starts.

    Features are hashes of words, word pairs, character n-grams of 3 and 4 bytes within a word and its borders, and the pattern
    in which a word repeats among the five before it (which position equals it), with and without the pattern before. The pattern
    is what n-grams of unseen words can't say; README gives the accuracy with and without it.
    """
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return
    w = word_hashes(LOWER[data], starts, ends)
    yield _fold(mix(w + np.uint64(1))), starts
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = doc[1:] == doc[:-1]
    yield _fold(chain([w[:-1], w[1:]], 2)[same]), starts[:-1][same]
    back = np.full(len(w), 6, np.uint64)
    for k in range(5, 0, -1):
        hit = np.zeros(len(w), bool)
        hit[k:] = (w[k:] == w[:-k]) & (doc[k:] == doc[:-k])
        back[hit] = k
    yield _fold(mix(back + np.uint64(0xBACC))), starts
    before = np.concatenate([[np.uint64(9)], back[:-1]])
    before[first[:-1][first[:-1] < len(w)]] = 9
    yield _fold(chain([before, back], 3)), starts
    # character n-grams: any white space is one border sign; a border stands before and after each text
    text = np.where(IS_SPACE[data], np.uint8(32), data).astype(np.uint64)
    text = np.insert(text, offsets, 32)
    place = np.insert(np.arange(len(data)), offsets, np.minimum(offsets, max(len(data) - 1, 0)))
    row_end = np.zeros(len(text), bool)
    row_end[offsets + np.arange(len(offsets))] = True  # a border between texts: n-grams may end or start there, not cross
    solid = text != 32
    for n in (3, 4):
        inner = np.logical_and.reduce([solid[1 + i : len(text) - n + 2 + i] for i in range(n - 2)]) if len(text) >= n else np.zeros(0, bool)
        at = np.flatnonzero(inner)
        h = text[at]
        for i in range(1, n):
            h = h << np.uint64(8) | text[at + i]
        # a start at the border before a text belongs to the text after it
        yield _fold(mix(h + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))), np.where(row_end[at], place[np.minimum(at + 1, len(place) - 1)], place[at])


def document_sums(data: np.ndarray, offsets: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of score[bucket] over the features of each text, and their number."""
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for bucket, place in feature_stream(data, offsets):
        row = np.searchsorted(offsets, place, "right") - 1
        total += np.bincount(row, score[bucket], len(total))
        count += np.bincount(row, minlength=len(total))
    return total, count


def sparse_counts(data: np.ndarray, offsets: np.ndarray):
    """For each text its distinct buckets and how often each occurs."""
    parts = list(feature_stream(data, offsets))
    if not parts:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(offsets) - 1)
    bucket, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    row = np.searchsorted(offsets, place, "right") - 1
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    bounds = np.searchsorted(key, np.arange(len(offsets)) * BUCKETS)
    return [(key[a:b] % BUCKETS, count[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@dataclass
class Model:
    """score(text) = softmax(mean embedding @ output + bias)[1]. As the output is linear in the mean, one number per bucket, the
    difference of the two outputs of its embedding, gives the same softmax."""

    margin: np.ndarray
    bias: float

    def probabilities(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = np.divide(total, count, out=np.zeros(len(total)), where=count > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int, epochs: int = EPOCHS, rate: float = RATE, width: int = WIDTH) -> Model:
    """Stochastic gradient descent over documents (buckets, counts, label): embeddings and a two-class softmax output.

    Classes weigh equally in the updates and the bias then takes up the classes' shares; the rate falls to 0. With one class
    only, or none, the model is that class's share (1 without labels) for every text.
    """
    labels = np.array([y for *_, y in examples], int)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), 40.0 if not len(labels) else float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / width, 1 / width, (BUCKETS, width))
    output = np.zeros((width, 2))
    bias = np.zeros(2)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps, total = 0, epochs * len(examples)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            bucket, count, y = examples[i]
            lr = rate * (1 - steps / total)
            steps += 1
            if not len(bucket):
                continue
            share_of = (count / count.sum())[:, None]
            mean = (embed[bucket] * share_of).sum(axis=0)
            z = mean @ output + bias
            p = np.exp(z - z.max())
            grad = p / p.sum()
            grad[y] -= 1
            grad *= min(weight[y], 4.0)
            down = output @ grad
            output -= lr * np.outer(mean, grad)
            bias -= 0.1 * lr * grad
            # the mean's gradient is spread over few or many buckets: scaled so that a step moves the mean by about lr
            embed[bucket] -= lr * down * share_of / float((share_of**2).sum())
    return Model(embed @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out, seed: int, per_class: int):
    """Sparse features of at most per_class labelled rows of each class, those of smallest seeded hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    known = known.where(~held_out(F.col("id")))
    order = F.xxhash64(F.lit(seed), "id")
    chosen = saved(known.where("y = 0").orderBy(order, "id").limit(per_class).unionByName(known.where("y = 1").orderBy(order, "id").limit(per_class)), "train-ids")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got = sparse_counts(*string_buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([b.astype(np.uint16).tobytes() for b, _ in got]), pa.array([np.minimum(c, 2**31 - 1).astype(np.int32).tobytes() for _, c in got])], ["id", "y", "bucket", "count"])

    # at most 2 * per_class ids, so broadcasting them is bounded
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.mapInArrow(tidy(run), "id long, y int, bucket binary, count binary").groupBy("id").agg(F.min(F.struct("y", "bucket", "count")).alias("r")).select("id", "r.*").toArrow().to_pylist()
    rows.sort(key=lambda r: r["id"])
    return [(np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.frombuffer(r["count"], np.int32), r["y"]) for r in rows]


def crc_held_out(id_column):
    """The rows that labels are not learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out=crc_held_out, seed: int = 31, per_class: int = PER_CLASS) -> Model:
    """Trains on a bounded sample: at most per_class labelled, not held-out rows of each class. Where an id repeats in
    labels, the lower label counts; where it has several texts, the one whose features sort first."""
    return train(_examples(docs, labels, id_col, text_col, label_col, held_out, seed, per_class), seed)


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", without: tuple[str, ...] = ()) -> DataFrame:
    """docs (less the columns in without) with a score from 0 to 1 per row. Null and empty texts, and texts without words, get the bias alone. One narrow pass."""
    bounded_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    stay = [i for i, c in enumerate(docs.columns) if c not in without]
    text_at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers: of fixed size

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[text_at]):
                score = shared.value.probabilities(*document_sums(*string_buffers(part.column(text_at)), shared.value.margin))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), pa.array(score)], [*(batch.schema.names[i] for i in stay), name])

    return docs.mapInArrow(tidy(run), StructType(docs.drop(*without).schema.fields.copy()).add(name, "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.7) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted (1 from cut on).

    Only the text decides the score. Null ids are allowed (not held out). Repeated rows get equal scores; very long texts are scored whole, in slices of
    rows of bounded size. A score of exactly cut counts as 1. Other columns, of any name, aren't read. An empty table gives an empty table; without
    usable labels every score is near 1.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    out = scored(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")), model, "__text", without=("__text",))
    return out.select(id_col, crc_held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.7) -> DataFrame:
    """docs without the rows that score under cut; the same columns, of any name. Null and empty texts score the bias alone. Rows that
    repeat score alike. Without usable labels all rows stay."""
    model = fit(docs, labels, id_col, text_col, label_col)
    score = next("score" + "_" * k for k in range(len(docs.columns) + 1) if "score" + "_" * k not in docs.columns)
    return scored(docs, model, text_col, score).where(F.col(score) >= cut).drop(score)
