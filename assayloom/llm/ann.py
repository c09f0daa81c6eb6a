"""Operator 4: nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking within proven bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .text import tidy
from .vectors import common_length, packed, sample, stack, unit

#: Vectors that codebooks are fitted on; rows of the index in a file; queries that one scan of the index takes (they are broadcast: their bytes
#: are bounded); candidates by table score, in each task, that set each query's bound.
FIT, BLOCK, QUERIES, FIRST = 8192, 8192, 16_384, 64
#: Rows and queries whose scores a task holds at a time.
ROWS, AT_ONCE = 4096, 128
#: Inner product from which errors matter; it sets how much an error along the vector costs beside one across it.
THRESHOLD = 0.2
#: Rounding that a blocked product of unit vectors may be off by.
EPS = 1e-9


class Quantiser:
    """Product quantiser with 16 centres for each component, fitted to the anisotropic loss.

    For a unit vector x coded with residual r the loss is |r|^2 + (eta - 1) (x . r)^2: errors along x, which move the largest
    inner products, cost eta times as much as errors across it, with eta = (d - 1) t^2 / (1 - t^2). Codes are found by
    coordinate descent over the components, centres by the normal equations of that loss.
    """

    def __init__(self, x: np.ndarray, rounds: int = 8):
        self.d = x.shape[1]
        self.eta = max(1.0, (self.d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        spread = x.std(axis=0)[:, None] + 1e-6
        # centres of a normal's 16 parts at first: they lie closer in the middle than its quantiles do
        self.books = x.mean(axis=0)[:, None] + spread * (np.sign(np.arange(-7.5, 8)) * (np.abs(np.arange(-7.5, 8)) / 7.5) ** 1.15 * 2.6)[None, :]
        for _ in range(rounds):
            codes = self.codes(x)
            hot = np.zeros((len(x), self.d, 16))
            np.put_along_axis(hot, codes[:, :, None], x[:, :, None], axis=2)
            hot = hot.reshape(len(x), -1)
            count = (codes[:, :, None] == np.arange(16)).sum(axis=0).reshape(-1)
            a = (self.eta - 1) * hot.T @ hot + np.diag(count + 1e-3)
            self.books = np.linalg.solve(a, self.eta * hot.sum(axis=0) + 1e-3 * self.books.reshape(-1)).reshape(self.books.shape)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """n x d codes of unit vectors."""
        r = x[:, :, None] - self.books[None]  # residual of each choice
        across, along = r * r, x[:, :, None] * r
        codes = across.argmin(axis=2)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        at = np.arange(len(x))
        for _ in range(sweeps):
            for s in range(self.d):
                total -= along[at, s, codes[:, s]]
                codes[:, s] = (across[:, s] + (self.eta - 1) * (total[:, None] + along[:, s]) ** 2).argmin(axis=1)
                total += along[at, s, codes[:, s]]
        return codes

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, two to a byte."""
        c = self.codes(x).astype(np.uint8)
        if self.d % 2:
            c = np.concatenate([c, np.zeros((len(c), 1), np.uint8)], axis=1)
        return c[:, ::2] | c[:, 1::2] << 4

    def errors(self, x: np.ndarray, packed_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The residual of each coded unit vector: its part along the vector, and its length across it."""
        codes = np.stack([packed_codes & 15, packed_codes >> 4], axis=2).reshape(len(x), -1)[:, : self.d]
        r = x - self.books[np.arange(self.d), codes]
        along = np.einsum("nd,nd->n", r, x)
        return along, np.sqrt(np.maximum(0, np.einsum("nd,nd->n", r, r) - along**2))

    def scores(self, queries: np.ndarray, packed_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Approximate inner products, queries x codes: sums of table entries, looked up a byte (two codes) at a time; and how far each
        query's sums may be off by rounding."""
        tables = (queries[:, :, None] * self.books[None]).astype(np.float32)
        if self.d % 2:
            tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], axis=1)
        both = (tables[:, 1::2, :, None] + tables[:, ::2, None, :]).reshape(len(queries), -1, 256)
        out = np.zeros((len(queries), len(packed_codes)), np.float32)
        for s in range(both.shape[1]):
            out += np.take(both[:, s], packed_codes[:, s], axis=1)
        return out, (self.d + 3) * 2.0**-23 * np.abs(tables).max(axis=2).sum(axis=1, dtype=np.float64) + EPS


def needed(scores: np.ndarray, slack: np.ndarray, least: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Which candidates (queries x codes) may have an inner product of `least` or more, from their approximate scores.

    With x = code + r the score is x.q - r.q. For x.q = cos(t), r.q is at most along cos(t) + across sin(t), so the score is at
    least (1 - along) cos(t) - across sin(t). For along < 1 this falls as t grows to a right angle: a candidate of least >= 0 or
    more scores (1 - along) least - across sqrt(1 - least^2) at least. Where that does not hold, every candidate may.
    """
    lowest = np.outer(least, 1 - along) - np.outer(np.sqrt(np.maximum(0, 1 - least**2)), across) - slack[:, None]
    return (scores >= lowest) | (least < 0)[:, None] | (along >= 1)[None, :]


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, each row alone: equal rows give equal numbers wherever they stand."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def build_index(table: DataFrame, id_col: str, vec_col: str, copies: int, seed: int) -> tuple[Quantiser | None, int, DataFrame, DataFrame]:
    """The quantiser, the vectors' length, ids (vec_id, fp) and the index, a row per distinct vector: (fp, rep, ids, vec, code, along, across).

    ids are a vector's `copies` smallest; a window that stops at them in each task before it shuffles picks them, so a vector that
    a third of all rows repeat is no hot spot."""
    rows = saved(packed(table, id_col, vec_col), "ann-vectors")
    d = common_length(rows)
    one = rows.where("vec_id is not null").where(F.expr("octet_length(vec)") == 4 * d).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    ids = saved(one.withColumn("fp", F.md5("vec")), "ann-ids")
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("vec_id"))
    distinct = ids.withColumn("k", rank).where(F.col("k") <= copies).groupBy("fp").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec").alias("vec"))
    fit = sample(distinct.select(F.col("rep").alias("vec_id"), "vec"), FIT, d, seed)
    q = Quantiser(fit) if len(fit) else None

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, len(batch), 2048)):
                x = unit(stack(part.column("vec").to_pylist(), d))
                code = q.pack(x)
                along, across = q.errors(x, code)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(along), pa.array(across)], [*part.schema.names, "code", "along", "across"])

    index = distinct.mapInArrow(tidy(run), "fp string, rep long, ids array<long>, vec binary, code binary, along double, across double")
    # scanning costs far more than a row's bytes say: files of BLOCK rows spread over as many tasks as there are cores
    return q, d, ids.select("vec_id", "fp"), saved(index.repartition(max(1, -(-ids.count() // BLOCK)), "rep"), "ann-index")


class Best:
    """Each query's `top` greatest scores so far, with the candidates' names; ties to the smaller name."""

    def __init__(self, queries: int, top: int):
        self.score, self.rep = np.full((queries, top), -np.inf), np.full((queries, top), np.iinfo(np.int64).max)

    def add(self, query: int, score: np.ndarray, rep: np.ndarray) -> None:
        s, r, top = np.concatenate([self.score[query], score]), np.concatenate([self.rep[query], rep]), self.score.shape[1]
        order = np.lexsort([r, -s])[:top]
        self.score[query], self.rep[query] = s[order], r[order]

    def batch(self, asks: np.ndarray) -> pa.RecordBatch:
        query, at = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(asks[query]), pa.array(self.rep[query, at]), pa.array(self.score[query, at])], ["ask", "rep", "score"])


def _scan(index: DataFrame, asked: list, d: int, find, top: int) -> DataFrame:
    """(ask, rep, score): each task of the index goes through its own rows for all queries of a block (rep, vec, least), and gives each query's `top` of what
    find(raw rows, codes, along, across, rep, queries, least) yields, (query, rows' places, exact scores). The index is neither shuffled nor copied."""
    if not asked:
        return index.select(F.col("rep").alias("ask"), "rep", F.lit(0.0).alias("score")).limit(0)
    asks = np.array([r["rep"] for r in asked], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((asks, stack([r["vec"] for r in asked], d), np.array([r["least"] for r in asked])))

    def run(batches):
        asks, raw, least = shared.value
        best = Best(len(asks), top)
        for batch in batches:
            for rows in (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS)):
                x, rep = stack(rows.column("vec").to_pylist(), d), rows.column("rep").to_numpy()
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
                along, across = rows.column("along").to_numpy(), rows.column("across").to_numpy()
                for at in range(0, len(asks), AT_ONCE):
                    for i, these, exact in find(x, codes, along, across, rep, raw[at : at + AT_ONCE], least[at : at + AT_ONCE]):
                        best.add(at + i, exact, rep[these])
        yield best.batch(asks)

    return index.select("rep", "vec", "code", "along", "across").mapInArrow(tidy(run), "ask long, rep long, score double")


def nearest(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, top: int = 5, seed: int = 29) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the `top` rows of largest cosine but itself.

    Every row is in the index, once per distinct vector. Queries are taken in blocks of QUERIES, each in two scans of the index. (1) Codes are
    scanned by table; in each task a query's FIRST best codes are reranked by the exact cosine, and over all tasks the last of its
    best top + 1 is a bound that the result can't fall below. (2) Codes are scanned again; candidates whose code does not prove
    them to be below the bound (see needed) are reranked on the original vectors in double precision. So the result is exact, whatever
    the codes are worth, and the share of rows reranked falls as the table grows. (3) Distinct vectors give their ids. Ties go to the smaller
    id.

    Rows with a null id, and vectors that are null, empty, zero, hold null or non-finite components or are not of the table's
    commonest length take no part. Repeated rows count once: a candidate is an id; of an id with several vectors the one of least
    bytes counts. Copies under other ids are candidates of each other. With fewer candidates than top, all are returned. An empty
    table gives an empty table. Other columns are not read.
    """
    q, d, ids, index = build_index(table, id_col, vec_col, top + 1, seed)
    wanted = ids.where(F.col("vec_id") % every == 0)
    asked = saved(index.select("fp", "rep", "vec").join(wanted.select("fp").distinct(), "fp", "left_semi").select("rep", "vec"), "ann-asked")
    blocks = max(1, -(-asked.count() // QUERIES))
    best_of = lambda most: F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "rep")) <= most

    def first(x, codes, along, across, rep, queries, least):
        scores, _ = q.scores(unit(queries), codes)
        many = min(FIRST, scores.shape[1])
        for i, these in enumerate(np.argpartition(-scores, many - 1, axis=1)[:, :many]):
            yield i, these, cosines(x[these], queries[i])

    def rerank(x, codes, along, across, rep, queries, least):
        scores, slack = q.scores(unit(queries), codes)
        for i, need in enumerate(needed(scores, slack, least, along, across)):
            if len(these := np.flatnonzero(need)):
                yield i, these, cosines(x[these], queries[i])

    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(blocks)) == block).withColumn("least", F.lit(-1.0)).collect()  # about QUERIES rows
        bound = _scan(index, own, d, first, top + 1).withColumn("keep", best_of(top + 1)).where("keep")
        bound = bound.groupBy("ask").agg(F.when(F.count("*") == top + 1, F.min("score") - EPS).otherwise(-1.0).alias("least"))
        least = {r["ask"]: r["least"] for r in bound.collect()}  # a number per query of the block
        hits = _scan(index, [{"rep": r["rep"], "vec": r["vec"], "least": least.get(r["rep"], -1.0)} for r in own], d, rerank, top + 1)
        hits = hits.withColumn("keep", best_of(top + 1)).where("keep").drop("keep")
        found = hits if found is None else found.unionByName(hits)
    rows = found.join(index.select("rep", "ids"), "rep").select("ask", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    best = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1).groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("best"))
    named = wanted.withColumnRenamed("vec_id", "query_id").join(index.select("fp", F.col("rep").alias("ask")), "fp").join(best, "ask")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top)
    return named.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
