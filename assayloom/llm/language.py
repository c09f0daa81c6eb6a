"""Operator 11: the language of each word and each text, by a linear-chain conditional random field."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, saved
from .text import mix, slices, tidy

#: Hash buckets of affixes and n-grams; what a word needs to be in the lexicon: occurrences in the sample.
BUCKETS, LEXICON_MIN = 1 << 16, 3
#: The bounded sample that is learnt from: languages (the most frequent), documents of each, words of a document (in a row, from a seeded place).
LANGUAGES, PER_LANGUAGE, SAMPLE_WORDS = 64, 300, 200
#: Mean words of a run in the code-switched chains that the sample is spliced into; the share of runs that begin a chain.
RUN, NEW_CHAIN = 15, 0.3
#: Steps of gradient descent, their size, and what draws weights to 0.
STEPS, RATE, SHRINK = 40, 0.15, 1e-5
#: Words of a chain at most: a longer text is several chains, all of whose words count. Distinct words that a task remembers.
CHAIN, REMEMBERED = 1 << 19, 300_000

_ONLY_LETTERS = bytes(b if 0x61 <= b < 0x7B or b >= 0x80 else 32 for b in range(256))

_BEYOND_ASCII = bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased maximal runs of ASCII letters and of all beyond ASCII; some of those hold no letter (see has_letter)."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_ONLY_LETTERS).split()


def has_letter(word: bytes) -> bool:
    return bool(word.translate(None, _BEYOND_ASCII)) or any(c.isalpha() for c in word.decode("utf-8", "replace"))


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket): hashed prefixes and suffixes of 1 to 4 bytes, and n-grams of 2 and 3 bytes, of each word."""
    data = np.frombuffer(b"".join(vocabulary), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    end = np.cumsum(size)
    owners, buckets = [], []

    def add(kind: int, owner, at, n):
        h = np.full(len(at), kind, np.uint64)
        for i in range(n):
            h = h << np.uint64(8) | data[at + i]
        owners.append(owner)
        buckets.append((mix(h) >> np.uint64(64 - 16)).astype(np.int64))

    for n in (1, 2, 3, 4):
        long = np.flatnonzero(size >= n)
        add(n, long, (end - size)[long], n)
        add(8 + n, long, end[long] - n, n)
    owner = np.repeat(np.arange(len(vocabulary)), size)
    for n in (2, 3):
        at = np.flatnonzero(np.arange(len(data)) + n <= end[owner])
        add(16 + n, owner[at], at, n)
    return np.concatenate(owners), np.concatenate(buckets)


def forward_backward(scores: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Chains of words laid end to end: scores (words x languages), first (where a chain begins; its first entry must be True), move
    (log weight of a language after another) and start (log weight of a chain's first language).

    Gives each word's marginal probabilities, the expected number of each move, and the log of the summed weight of all labellings.
    Words are cut into blocks that step together: one pass finds what each block makes of any message into it, the messages then
    run over blocks, and the forward and backward pass start from them; so a chain of any length takes few numpy steps.
    """
    n, k = scores.shape
    top = scores.max(axis=1)
    weight, a, pi = np.exp(scores - top[:, None]), np.exp(move - move.max()), np.exp(start - start.max())
    depth = max(1, min(256, int(np.sqrt(n))))
    blocks = -(-n // depth)
    e = np.concatenate([weight, np.ones((blocks * depth - n, k))]).reshape(blocks, depth, k).transpose(1, 0, 2).copy()
    begins = np.concatenate([first, np.ones(blocks * depth - n, bool)]).reshape(blocks, depth).T.copy()
    through = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(depth):
        onward = (through.reshape(-1, k) @ a).reshape(blocks, k, k)
        if begins[t].any():
            onward[begins[t]] = through[begins[t]].sum(axis=2, keepdims=True) * pi
        onward *= e[t][:, None, :]
        through = onward / onward.sum(axis=(1, 2), keepdims=True)
    into, back = np.full((blocks, k), 1 / k), np.ones((blocks, k))
    for b in range(1, blocks):
        x = into[b - 1] @ through[b - 1]
        into[b] = x / x.sum()
    for b in range(blocks - 1, 0, -1):
        x = through[b] @ back[b]
        back[b - 1] = x / x.max()
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((depth, blocks))
    for t in range(depth):
        x = into @ a
        x[begins[t]] = pi
        x *= e[t]
        scale[t] = x.sum(axis=1)
        into = alpha[t] = x / scale[t][:, None]
    for t in range(depth - 1, -1, -1):
        beta[t] = back
        x = e[t] * back
        y = x @ a.T
        y[begins[t]] = (x[begins[t]] @ pi)[:, None]
        back = y / y.max(axis=1, keepdims=True)
    alpha, beta, scale = (x.swapaxes(0, 1).reshape(blocks * depth, *x.shape[2:])[:n] for x in (alpha, beta, scale))
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(~first)
    before, after = alpha[inner - 1], weight[inner] * beta[inner]
    moves = ((before / (before @ a * after).sum(axis=1, keepdims=True)).T @ after) * a
    return p, moves, float(np.log(scale).sum() + top.sum() + len(inner) * move.max() + first.sum() * start.max())


@dataclass
class Model:
    """weights: a row per bucket, then per word of the lexicon; bias, move, start: per language."""

    languages: list[str]
    lexicon: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def occurrences(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        owner, bucket = features(vocabulary)
        known = np.array([(i, j) for i, w in enumerate(vocabulary) if (j := self.lexicon.get(w)) is not None], np.int64).reshape(-1, 2)
        return np.concatenate([owner, known[:, 0]]), np.concatenate([bucket, BUCKETS + known[:, 1]])

    def scores(self, vocabulary: list[bytes]) -> np.ndarray:
        """Log weight of each language for each word by itself."""
        owner, bucket = self.occurrences(vocabulary)
        return np.stack([np.bincount(owner, self.weights[bucket, k], len(vocabulary)) for k in range(len(self.languages))], axis=1) + self.bias


def loss_and_gradient(model: Model, occurrences, chain: np.ndarray, first: np.ndarray, label: np.ndarray, n_words: int):
    """Negative log-likelihood, a word, of the labels of chains of vocabulary numbers, and its gradient by weights, bias, move and start."""
    owner, bucket = occurrences
    k, n = len(model.languages), len(chain)
    scores = np.stack([np.bincount(owner, model.weights[bucket, j], n_words) for j in range(k)], axis=1) + model.bias
    p, moves, total = forward_backward(scores[chain], first, model.move, model.start)
    inner = np.flatnonzero(~first)
    gold = scores[chain, label].sum() + model.move[label[inner - 1], label[inner]].sum() + model.start[label[first]].sum()
    p[np.arange(n), label] -= 1
    word = np.stack([np.bincount(chain, p[:, j], n_words) for j in range(k)], axis=1)
    weights = np.stack([np.bincount(bucket, word[owner, j], len(model.weights)) for j in range(k)], axis=1)
    np.subtract.at(moves, (label[inner - 1], label[inner]), 1)
    return (total - gold) / n, [weights / n, p.sum(axis=0) / n, moves / n, p[first].sum(axis=0) / n]


def train(samples: list[tuple[list[bytes], str]], seed: int = 17, steps: int = STEPS, rate: float = RATE) -> Model | None:
    """Learns from (words, language). The words of each document are cut into runs, and the runs of all languages spliced in random order into
    code-switched chains, from which the moves are learnt together with the words' weights, by gradient descent with momentum and a step per
    weight. None without words."""
    samples = [(w, lang) for w, lang in samples if w]
    if not samples:
        return None
    languages = sorted({lang for _, lang in samples})
    rng, number = np.random.default_rng(seed), {lang: i for i, lang in enumerate(languages)}
    runs = []
    for w, lang in samples:
        at = 0
        while at < len(w):
            end = at + int(rng.geometric(1 / RUN))
            runs.append((w[at:end], number[lang]))
            at = end
    runs = [runs[i] for i in rng.permutation(len(runs))]
    count = Counter(x for w, _ in runs for x in w)
    vocabulary = {w: i for i, w in enumerate(sorted(count))}
    chain = np.array([vocabulary[x] for w, _ in runs for x in w], np.int64)
    size = np.array([len(w) for w, _ in runs])
    label = np.repeat([y for _, y in runs], size)
    first = np.zeros(len(chain), bool)
    first[(np.cumsum(size) - size)[np.r_[True, rng.random(len(runs) - 1) < NEW_CHAIN]]] = True
    lexicon = {w: i for i, w in enumerate(w for w in vocabulary if count[w] >= LEXICON_MIN)}
    k = len(languages)
    model = Model(languages, lexicon, np.zeros((BUCKETS + len(lexicon), k)), np.zeros(k), np.zeros((k, k)), np.zeros(k))
    occurrences = model.occurrences(list(vocabulary))
    values = [model.weights, model.bias, model.move, model.start]
    first_moment, second_moment = ([np.zeros_like(v) for v in values] for _ in range(2))
    for step in range(1, steps + 1):
        _, gradient = loss_and_gradient(model, occurrences, chain, first, label, len(vocabulary))
        for v, g, m, s in zip(values, gradient, first_moment, second_moment, strict=True):
            g = g + SHRINK * v
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Labeller:
    """Labels whole texts; remembers the scores of words between batches."""

    def __init__(self, model: Model):
        self.model, self.number = model, _Words()
        self.score, self.real = np.zeros((0, len(model.languages))), np.zeros(0, bool)

    def _numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self.__init__(self.model)
        get, known = self.number.__getitem__, len(self.number)
        out = [np.fromiter(map(get, found), np.int64, len(found)) for t in texts for found in (words(t),)]
        if new := list(self.number)[known:]:
            self.score = np.concatenate([self.score, self.model.scores(new)])
            self.real = np.concatenate([self.real, np.fromiter(map(has_letter, new), bool, len(new))])
        return [x[self.real[x]] for x in out]

    def marginals(self, texts: list[str | None]):
        """(text's place, marginals of some of its words in a row): every word of every text, in order."""
        group, held = [], 0
        for i, x in enumerate(self._numbers(texts)):
            for at in range(0, len(x), CHAIN):
                group.append((i, x[at : at + CHAIN]))
                held += len(group[-1][1])
                if held >= CHAIN:
                    yield from self._run(group)
                    group, held = [], 0
        if group:
            yield from self._run(group)

    def _run(self, group):
        chain, size = np.concatenate([x for _, x in group]), np.array([len(x) for _, x in group])
        start = np.cumsum(size) - size
        first = np.zeros(len(chain), bool)
        first[start] = True
        p, _, _ = forward_backward(self.score[chain], first, self.model.move, self.model.start)
        for (i, _), a, n in zip(group, start, size, strict=True):
            yield i, p[a : a + n]

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's expected share of words in each language, and its number of words (without words: zeros)."""
        total, n = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        for i, p in self.marginals(texts):
            total[i] += p.sum(axis=0)
            n[i] += len(p)
        return total / np.maximum(n, 1)[:, None], n


def crc_held_out(id_column):
    """The rows that aren't learnt from: crc32 of the id as text leaves 1 when divided by 3. A null id isn't held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=crc_held_out, seed: int = 17) -> Model | None:
    """Trains on a bounded sample of rows with a language and an id that aren't held out: of the LANGUAGES most frequent ones PER_LANGUAGE
    rows each, those of smallest seeded hash of the id, and of each at most SAMPLE_WORDS words in a row, from a place that the hash
    gives. None where there is nothing to learn from. Where an id repeats with a language, the least text counts."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null")
    known = known.where(~held_out(F.col("id")))
    most = saved(known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES), "languages")
    order = Window.partitionBy("lang").orderBy("key", "id")
    chosen = known.join(F.broadcast(most), "lang").withColumn("key", F.xxhash64(F.lit(seed), "id"))  # most: LANGUAGES rows at most
    # the smallest PER_LANGUAGE of `count` even hashes lie under this bound; without it a language's ids would all meet in one task
    chosen = chosen.where(F.col("key") / F.lit(2.0**64) + 0.5 < F.lit(8.0 * PER_LANGUAGE) / F.col("count")).select("id", "lang", "key").distinct()
    chosen = saved(chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_LANGUAGE).select("id", "lang", "key"), "language-sample")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for t, key in zip(part.column("text").to_pylist(), part.column("key").to_pylist(), strict=True):
                    found = [w for w in words(t) if has_letter(w)]
                    at = key % max(1, len(found) - SAMPLE_WORDS + 1)
                    out.append(b" ".join(found[at : at + SAMPLE_WORDS]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array(out, pa.binary())], ["id", "lang", "words"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), ["id", "lang"]).where("text is not null")  # chosen: LANGUAGES * PER_LANGUAGE rows at most
    rows = texts.mapInArrow(tidy(run), "id long, lang string, words binary").groupBy("id", "lang").agg(F.min("words").alias("words")).toArrow().to_pylist()
    return train([(r["words"].split(), r["lang"]) for r in sorted(rows, key=lambda r: (r["id"], r["lang"]))], seed)


def languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of each row of docs: the language with the greatest expected share of the text's words, and that share.

    `und` and 0 where the text is null or has no letter, and everywhere without a model. Texts are labelled whole; one of more than
    CHAIN words is labelled in chains of that length. Ties go to the language that sorts first; repeated rows get equal results. One narrow pass.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS, and the bounded sample's lexicon

    def run(batches):
        labeller = shared.value and Labeller(shared.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                name, score = np.full(len(part), "und", object), np.zeros(len(part))
                if labeller:
                    share, n = labeller.shares(part.column("__text").to_pylist())
                    name = np.where(n > 0, np.array(labeller.model.languages, object)[share.argmax(axis=1)], "und")
                    score = np.where(n > 0, np.round(share.max(axis=1), 6), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {dict(rows.dtypes)[id_col]}, lang_pred string, score double")


def language_runs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, runs of each row of docs: its words (those with a letter, numbered from 0) as runs in one language, each the word's likeliest."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                label = [[] for _ in range(len(part))]
                for i, p in labeller.marginals(part.column("__text").to_pylist()):
                    label[i].append(p.argmax(axis=1))
                out = []
                for x in (np.concatenate(y) if y else np.zeros(0, np.int64) for y in label):
                    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else x
                    out.append([{"lang": labeller.model.languages[x[a]], "first": int(a), "words": int(b - a)} for a, b in zip(at, np.r_[at[1:], len(x)], strict=True)] if len(x) else [])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], [id_col, "runs"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` {dict(rows.dtypes)[id_col]}, runs array<struct<lang string, first long, words long>>")


def document_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score. See fit() for what is learnt from and languages() for odd texts. Null ids
    aren't held out and aren't learnt from; an empty table gives an empty one. Other columns, of any name, aren't read."""
    found = languages(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select(id_col, crc_held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
