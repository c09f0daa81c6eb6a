"""Operator 13: the best-scoring documents of each item, by integer term weights, found from stored impacts of single terms."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import bounded_batches, saved
from .text import slices, tidy

#: A term is a maximal run of digits, ASCII letters and whatever lies beyond ASCII; only A-Z are lower-cased.
_TERMS = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))
#: Characters of the distinct texts of items that one scan takes: a block of items and its vocabulary are broadcast.
BLOCK_CHARS = 4 << 20
#: Pairs of a document and an item that are scored at a time.
PAIRS = 1 << 20


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """A bounded set of distinct item texts: their vocabulary, and for each text its terms and how often it has them."""

    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(texts: list[tuple[int, str]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        rows = [(q, vocabulary.setdefault(t, len(vocabulary)), n) for q, text in texts for t, n in sorted(Counter(terms(text)).items())]
        return Block(vocabulary, *(np.array([r[i] for r in rows], np.int64) for i in range(3)))


def index(docs: DataFrame, block: Block, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs that has a term: doc_id, n (its terms with repeats), and for the terms of the block that it holds their
    numbers and counts. Written in the shared folder."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches):
        number = shared.value.get
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                size, held = [], []
                for text in part.column("text").to_pylist():
                    found = terms(text)
                    size.append(len(found))
                    count = Counter(map(number, found))
                    count.pop(None, None)
                    held.append(count)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in held])]).astype(np.int32))
                term, tf = (pa.array(np.fromiter((x for c in held for x in f(c)), kind)) for f, kind in ((Counter.keys, np.int32), (Counter.values, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, term), pa.ListArray.from_arrays(offsets, tf)], ["doc_id", "n", "term", "tf"]).filter(pa.array(np.array(size) > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return saved(rows.mapInArrow(tidy(run), "doc_id long, n long, term array<int>, tf array<long>"), "postings")


@dataclass
class Weights:
    """What impacts follow from: N, L, and the weight of each term of a block."""

    n_docs: int
    n_terms: int
    weight: np.ndarray

    def impacts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, impact) of each posting in a batch of the index. An impact is what one occurrence of the term in an item scores."""
        lists = batch.column("term")
        row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
        term, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
        m = 25 + 75 * batch.column("n").to_numpy() * self.n_docs // self.n_terms
        return row, term, self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))


def weigh(postings: DataFrame, block: Block) -> Weights:
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    # at most a row per term of the block
    for term, n in postings.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        df[term] = n
    return Weights(n_docs, n_terms, np.array([weight(n_docs, n) for n in df.tolist()], np.int64))


def _places(key: np.ndarray) -> np.ndarray:
    """How many equal entries stand before each entry of a sorted array."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))


def _greatest(parts: list[tuple[np.ndarray, np.ndarray]], top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` greatest impacts of each term, terms in order."""
    term, impact = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort([-impact, term])
    order = order[_places(term[order]) < top]
    return term[order], impact[order]


def best_impacts(postings: DataFrame, block: Block, weights: Weights, top: int) -> DataFrame:
    """(term, best, kth): each term's greatest impact and its top-th greatest (0 if fewer documents hold it). A task gives at most
    `top` impacts of a term."""
    shared = postings.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        term, impact, more, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            more.append(shared.value.impacts(batch)[1:])
            n += len(more[-1][0])
            if n > max(PAIRS, 2 * len(term)):
                (term, impact), more, n = _greatest([(term, impact), *more], top), [], 0
        term, impact = _greatest([(term, impact), *more], top)
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[starts, len(term)].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(term[starts].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(impact))], ["term", "impacts"])

    rows = postings.mapInArrow(tidy(run), "term int, impacts array<long>").groupBy("term").agg(F.sort_array(F.flatten(F.collect_list("impacts")), False).alias("all"))
    return rows.select("term", F.col("all")[0].alias("best"), F.coalesce(F.get("all", F.lit(top - 1)), F.lit(0)).alias("kth"))


def plan(spark: SparkSession, block: Block, best: DataFrame) -> DataFrame:
    """(item, term, times, least, essential) for each term of each item.

    least: the greatest stored kth impact of the item's terms, times its repeats: that many documents score as much by this term alone, so
    the item's kth score is at least that. Terms are ordered by the most they can add; where all that an item's terms from one on can add
    together is under least, a document with none of the terms before it can't be among the best, so those terms
    needn't be looked up: essential is false.
    """
    rows = spark.createDataFrame(pa.table({"item": block.item, "term": block.term.astype(np.int32), "times": block.times}))
    rows = rows.join(F.broadcast(best), "term").withColumn("most", F.col("times") * F.col("best"))
    rest = Window.partitionBy("item").orderBy(F.desc("most"), "term").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"least": F.max(F.col("times") * F.col("kth")).over(Window.partitionBy("item")), "rest": F.sum("most").over(rest)})
    return rows.select("item", "term", "times", "least", ((F.col("rest") >= F.col("least")) & (F.col("most") > 0)).alias("essential"))


class Lookup:
    """A block's plan as arrays: for each term the items that look it up, and the items' terms in full."""

    def __init__(self, rows: pa.Table, n_terms: int, n_items: int):
        item, term, times, least, essential = (rows.column(c).to_numpy() for c in ("item", "term", "times", "least", "essential"))
        self.n_items, self.least = n_items, np.zeros(n_items, np.int64)
        self.least[item] = least
        self.full = self._by_term(item, term, times, n_terms)
        self.entry = self._by_term(item[essential], term[essential], times[essential], n_terms)

    @staticmethod
    def _by_term(item, term, times, n_terms):
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(n_terms + 1)), item[order], times[order]

    @staticmethod
    def _joined(lists, term):
        """For each posting, in its order, the entries of its term: (which posting, item, times)."""
        starts, item, times = lists
        n = starts[term + 1] - starts[term]
        which = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term], n)
        return which, item[at], times[at]

    def candidates(self, row, term, impact, n_rows: int):
        """(row, item, score) of each pair that shares a looked-up term and scores at least the item's bound, and above 0."""
        wide = np.cumsum(np.bincount(row, self.full[0][term + 1] - self.full[0][term], n_rows))
        at = 0
        while at < n_rows:  # so many rows that their pairs, and a table of rows x items, stay bounded
            end = max(at + 1, min(at + max(1, PAIRS // self.n_items), int(np.searchsorted(wide, (wide[at - 1] if at else 0) + PAIRS, "right"))))
            own = slice(*np.searchsorted(row, [at, end]))
            which, item, _ = self._joined(self.entry, term[own])
            asked = np.zeros((end - at, self.n_items), bool)
            asked[row[own][which] - at, item] = True
            score = np.zeros((end - at) * self.n_items, np.int64)
            which, item, times = self._joined(self.full, term[own])
            np.add.at(score, (row[own][which] - at) * self.n_items + item, times * impact[own][which])
            score = score.reshape(end - at, self.n_items)
            r, q = np.nonzero(asked & (score >= self.least) & (score > 0))
            yield r + at, q, score[r, q]
            at = end


def _best(item, score, doc, known, top: int) -> np.ndarray:
    """The places of the `top` best of each item: greater score, then smaller id, ids that are null last."""
    order = np.lexsort([doc, ~known, -score, item])
    return order[_places(item[order]) < top]


def search_block(postings: DataFrame, block: Block, n_items: int, top: int) -> DataFrame:
    """(item, doc_id, score, rank) for the texts of one block."""
    spark = postings.sparkSession
    weights = weigh(postings, block)
    rows = plan(spark, block, best_impacts(postings, block, weights, top)).toArrow()  # a row per term of an item of the block
    shared = spark.sparkContext.broadcast((weights, Lookup(rows, len(block.vocabulary), n_items)))

    def run(batches):
        weights, lookup = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            ids = batch.column("doc_id")
            doc, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            for r, q, score in lookup.candidates(*weights.impacts(batch), len(batch)):
                held = [np.concatenate(x) for x in zip(held, (q, score, doc[r], known[r]), strict=True)]
                if len(held[0]) > 4 * top * lookup.n_items:
                    at = _best(held[0], held[1], held[2], held[3], top)
                    held = [x[at] for x in held]
        at = _best(held[0], held[1], held[2], held[3], top)
        item, score, doc, known = (x[at] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=~known), pa.array(score)], ["item", "doc_id", "score"])

    found = postings.mapInArrow(tidy(run), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item with a score above 0, ties to the smaller doc_id.

    Items are taken as queries in blocks of bounded size, each against all documents: one pass indexes the terms that
    the block asks for, one keeps each term's best impacts, from which every item gets a lower bound of its kth score and the terms that it must
    look up, and one scores what those terms find, exactly. Bounds are never above the truth, so the result is exact.

    Documents with a null text, or without a term, are none; a null id is a document and sorts last. Repeated rows of docs are documents
    each; rows of items that repeat id and text count once, an id with several texts gets a list for each. Items without terms, or
    whose terms no document holds, and empty tables give no rows. Texts of any length are read whole. Other columns aren't read.
    """
    spark = docs.sparkSession
    items = saved(items.select(F.col(item_col).alias("item_id"), F.col(query_col).cast("string").alias("item_text")).where("item_text is not null").distinct(), "items")
    texts = saved(items.select("item_text").distinct(), "item-texts")
    n_blocks = 1 + (texts.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]) // BLOCK_CHARS
    out = None
    for b in range(n_blocks):
        own = texts.where(F.pmod(F.xxhash64("item_text"), F.lit(n_blocks)) == b)
        numbered = [(i, r.item_text) for i, r in enumerate(own.orderBy("item_text").collect())]  # of bounded size: BLOCK_CHARS
        block = Block.of(numbered)
        if not len(block.item):
            continue
        found = search_block(index(docs, block, id_col, text_col), block, len(numbered), top)
        found = found.join(spark.createDataFrame(numbered, "item int, item_text string"), "item").join(items, "item_text").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
