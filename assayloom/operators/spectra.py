"""Components and distances of samples from passes over features, and the closest pairs of features: no samples x samples matrix, and no
table of all pairs of features, on the driver or anywhere else."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a component search takes beyond those asked for, numbers of its basis at which it starts afresh from its best, passes at most.
EXTRA, BASIS, PASSES = 8, 8_000_000, 100
#: Numbers of a side table (samples x permutations x levels) that one pass sends to its tasks.
SIDE = 4_000_000
_ROWS = 512


class Features:
    """A complete matrix, features x samples, centred by feature, kept as a row per feature; what is asked of it is a pass over those rows.

    The driver holds the samples' names and a few numbers for each. Features with gaps count 0 there, the feature's mean. close() frees the rows.
    """

    def __init__(self, cells: DataFrame, value: str = "y"):
        spark = cells.sparkSession
        self.names = [r["sample"] for r in cells.select("sample").distinct().orderBy("sample").collect()]  # a row per sample
        order = spark.createDataFrame([(s, i) for i, s in enumerate(self.names)], "sample string, at int")
        y = F.col(value).cast("double")
        here = cells.where(y.isNotNull()).join(order, "sample").groupBy("feature").agg(F.collect_list(F.struct("at", y.alias("y"))).alias("c"), F.avg(y).alias("m"))
        self.rows, self._use, self._of = here.select(F.col("c.at").alias("at"), F.transform("c.y", lambda v: v - F.col("m")).alias("y")).persist(), None, len(self.names)

    def only(self, use: list[int]) -> Features:
        """The same rows seen by some of the samples alone, centred on them."""
        out = Features.__new__(Features)
        out.names, out.rows, out._use, out._of = [self.names[i] for i in use], self.rows, np.array(use, int), self._of
        return out

    def close(self) -> None:
        self.rows.unpersist()

    def _pass(self, of, side, shape: tuple[int, ...]) -> np.ndarray:
        """The sum over blocks of features of of(block, side); each task gives one array, and they are added in a tree."""
        n, use, shared = self._of, self._use, self.rows.sparkSession.sparkContext.broadcast(side)

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                for at in range(0, len(batch), _ROWS):
                    part = batch.slice(at, _ROWS)
                    y = np.zeros((len(part), n))
                    row = np.repeat(np.arange(len(part)), part.column(0).value_lengths().to_numpy(zero_copy_only=False))
                    y[row, part.column(0).flatten().to_numpy()] = part.column(1).flatten().to_numpy()
                    if use is not None:
                        y = y[:, use]
                        y -= y.mean(axis=1, keepdims=True)
                    total += of(y, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["z"])

        parts = self.rows.mapInArrow(run, "z binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(shape))
        return parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(shape)

    def times(self, q: np.ndarray) -> np.ndarray:
        """K q for the samples' Gram matrix K and a few columns q."""
        return self._pass(lambda y, s: y.T @ (y @ s), q, q.shape)

    def facts(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Each sample's sum and sum of squares over features, and the number of features."""
        got = self._pass(lambda y, s: np.stack([y.sum(axis=0), (y**2).sum(axis=0), np.full(y.shape[1], len(y))]), None, (3, len(self.names)))
        return got[0], got[1], int(got[2][0]) if len(self.names) else 0

    def between(self, codes: np.ndarray, numeric: bool = False) -> np.ndarray:
        """For each row of codes (arrangements x samples) the sum of squares that its levels, or its numbers, explain."""
        codes = np.atleast_2d(codes)
        levels = np.unique(codes) if not numeric else np.zeros(1)
        step, out = max(1, SIDE // max(1, codes.shape[1] * len(levels))), []
        for at in range(0, len(codes), step):
            block = np.asarray(codes[at : at + step])
            if numeric:
                side = block - block.mean(axis=1, keepdims=True)
                size = np.sqrt((side**2).sum(axis=1, keepdims=True))
                side = np.divide(side, size, out=np.zeros_like(side, float), where=size > 0).T
            else:
                hot = (block[:, None, :] == levels[None, :, None]).astype(float)
                size = np.sqrt(hot.sum(axis=2, keepdims=True))
                side = np.divide(hot, size, out=np.zeros_like(hot), where=size > 0).reshape(-1, block.shape[1]).T
            found = self._pass(lambda y, s: ((y @ s) ** 2).sum(axis=0), side, (side.shape[1],))
            out.append(found.reshape(len(block), -1).sum(axis=1))
        return np.concatenate(out)


def top(times, n: int, k: int, seed: int = 0, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues and their vectors (as columns) of a symmetric matrix of n rows that `times` multiplies with a block of columns.

    A block Krylov search from random columns: each pass multiplies the newest block, and the best approximations in all that the blocks
    span are taken until what the matrix makes of them is they themselves, to the tolerance. A basis that has grown to BASIS numbers is replaced
    by its best columns. If the blocks span everything, the result is exact.
    """
    k = min(k, n)
    if not k:
        return np.zeros(0), np.zeros((n, 0))
    block = min(n, k + EXTRA)
    v = np.linalg.qr(np.random.default_rng([seed, 12]).normal(size=(n, block)))[0]
    av = times(v)
    for _ in range(PASSES):
        h = v.T @ av
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        best = values[:k], v @ u[:, :k]
        left = np.linalg.norm(av @ u[:, :k] - best[1] * best[0], axis=0).max()
        if v.shape[1] >= n or left <= tolerance * max(abs(values[0]), 1e-300):
            break
        new = av[:, -block:]
        if v.shape[1] + block > max(BASIS // n, 8 * block):
            keep = 2 * block
            v, av = v @ u[:, :keep], av @ u[:, :keep]
        for _ in range(2):
            new = new - v @ (v.T @ new)
        new, r = np.linalg.qr(new)
        new = new[:, np.abs(np.diag(r)) > 1e-12 * max(abs(values[0]), 1e-300)][:, : n - v.shape[1]]
        for _ in range(2):
            new = np.linalg.qr(new - v @ (v.T @ new))[0] if new.shape[1] else new
        if not new.shape[1]:
            break
        v, av, block = np.hstack([v, new]), np.hstack([av, times(new)]), new.shape[1]
    return best


def components(features: Features, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Scores (samples x k) and variance shares of the first components; each one's largest absolute score is positive."""
    total = features.facts()[1].sum()
    values, vectors = top(features.times, len(features.names), k, seed)
    scores = vectors * np.sqrt(np.maximum(values, 0))
    if len(scores):
        scores *= np.where(scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])] < 0, -1.0, 1.0)
    return scores, np.maximum(values, 0) / total if total > 0 else np.zeros(len(values))


def correlation_components(features: Features, share: float, least: int = 3, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and shares of the principal components of the samples' correlation matrix: as many as are needed for their shares to
    sum to more than `share`, at least `least`. The correlation matrix is the Gram matrix, less what the samples' means give, between
    the samples' lengths; so it is multiplied by the same passes."""
    sums, squares, p = features.facts()
    n, mean = len(features.names), sums / max(p, 1)
    size = np.sqrt(np.maximum(squares - p * mean**2, 0))
    unit = np.divide(1.0, size, out=np.zeros(n), where=size > 0)
    times = lambda q: unit[:, None] * (features.times(unit[:, None] * q) - p * np.outer(mean, mean @ (unit[:, None] * q)))
    whole, k = (size > 0).sum(), min(n, max(least, 8))
    while True:
        values, vectors = top(times, n, k, seed)
        shares = np.maximum(values, 0) / max(whole, 1)
        if k == n or np.cumsum(shares)[-1] > share:
            keep = min(n, max(least, int(np.searchsorted(np.cumsum(shares), share, "right")) + 1))
            return vectors[:, :keep], shares[:keep]
        k = min(n, 2 * k)


def permanova(features: Features, codes: np.ndarray, numeric: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """R2 and pseudo-F of one factor, or one numeric predictor, for each row of codes (arrangements x samples, in the order of
    features.names): distances enter through each feature's sums by level alone."""
    codes = np.atleast_2d(codes)
    n, total = codes.shape[1], float(features.facts()[1].sum())
    between = features.between(codes, numeric)
    used, left = (1, n - 2) if numeric else (len(np.unique(codes)) - 1, n - len(np.unique(codes)))
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / used) / ((total - between) / left)
    return between / total if total > 0 else between * 0, f


# ---------------------------------------------------------------- features

#: Features of a tile at most, and centres that tiles are formed around at most.
TILE, CENTRES = 1024, 512


def _nearest(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit row's closest centre, whatever the sign, and the angle to it."""
    near = np.abs(z @ centres.T)
    cell = near.argmax(axis=1)
    return cell, np.arccos(np.minimum(1.0, near[np.arange(len(z)), cell]))


def close_tiles(centres: np.ndarray, reach: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs a <= b of tiles that may hold features with |r| >= least: a feature is within its tile's reach of the tile's centre (angles), so two
    features of tiles whose centres are an angle t apart are at least t less both reaches apart."""
    apart = np.arccos(np.minimum(1.0, np.abs(centres @ centres.T))) - reach[:, None] - reach[None, :]
    keep = apart <= math.acos(min(1.0, least)) + 1e-9
    np.fill_diagonal(keep, True)
    return [(int(a), int(b)) for a, b in np.argwhere(keep) if a <= b]


def feature_links(cells: DataFrame, parent: DataFrame, least: float, top: int = 5, value: str = "y", seed: int = 0) -> DataFrame:
    """(feature, rank, other, same_parent, r): each feature's `top` closest others by |r|, of those with |r| >= least; ties by name.

    For features without gaps over the same samples; constant ones correlate with nothing. parent: (feature, parent). Features become unit vectors and
    are dealt to tiles around centres, drawn by seeded hashes of their names; only pairs of tiles that the triangle inequality leaves open are
    multiplied, and a product returns at most `top` rows a feature. So neither the work between distant features nor the output grows with
    the square of the features.
    """
    spark, y = cells.sparkSession, F.col(value).cast("double")
    wide = cells.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("sample", y.alias("y")))).alias("c"), F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.count("*").alias("n"))
    wide = wide.where("v > 1e-24 * (m * m + 1)").select("feature", F.transform("c.y", lambda x: (x - F.col("m")) / F.sqrt(F.col("v") * F.col("n"))).alias("z")).persist()
    n = wide.count()
    drawn = wide.orderBy(F.xxhash64(F.lit(seed), "feature"), "feature").limit(min(CENTRES, max(1, -(-n // TILE)))).select("z").collect()  # CENTRES rows at most
    if not n:
        wide.unpersist()
        return parent.where("false").select("feature", F.lit(1).alias("rank"), F.col("feature").alias("other"), F.lit(True).alias("same_parent"), F.lit(0.0).alias("r"))
    centres = np.array([r.z for r in drawn])
    shared = spark.sparkContext.broadcast(centres)

    def deal(batches):
        for batch in batches:
            z = np.array(batch.column("z").to_pylist()).reshape(len(batch), -1)
            cell, angle = _nearest(z, shared.value) if len(z) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array([x.tobytes() for x in z], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(angle)], ["feature", "z", "cell", "angle"])

    dealt = wide.mapInArrow(deal, "feature string, z binary, cell int, angle double").persist()
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))  # a row per centre
    cut = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("feature"), "parts").cast("int"))
    tiles = cut.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("feature", "z"))).alias("m"), F.max("angle").alias("reach")).persist()
    known = tiles.select("cell", "part", "reach").orderBy("cell", "part").collect()  # a row per tile
    pairs = close_tiles(centres[[r.cell for r in known]], np.array([r.reach for r in known]), least)
    order = spark.createDataFrame([(i, r.cell, r.part) for i, r in enumerate(known)], "tile int, cell int, part int")
    placed = tiles.join(F.broadcast(order), ["cell", "part"]).select("tile", F.col("m.feature").alias("f"), F.col("m.z").alias("z"))
    todo = spark.createDataFrame(pairs, "a int, b int").join(placed.toDF("a", "f1", "z1"), "a").join(placed.toDF("b", "f2", "z2"), "b")

    def multiply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                one, two = (np.array([np.frombuffer(x) for x in row[c]]) for c in ("z1", "z2"))
                r, same = np.clip(one @ two.T, -1, 1), row["a"] == row["b"]
                out: list[tuple[str, str, float]] = []
                for near, mine, others in ((r, row["f1"], row["f2"]), *(() if same else ((r.T, row["f2"], row["f1"]),))):
                    for i, line in enumerate(near):
                        hits = [j for j in np.flatnonzero(np.abs(line) >= least - 1e-12) if not (same and i == j)]
                        hits.sort(key=lambda j: (-abs(line[j]), others[j]))
                        out += [(mine[i], others[j], float(line[j])) for j in hits[:top]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["feature", "other", "r"])

    found = todo.mapInArrow(multiply, "feature string, other string, r double").where(F.abs("r") >= least)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc(F.abs("r")), "other"))).where(F.col("rank") <= top)
    whose = lambda c, p: parent.select(F.col("feature").alias(c), F.col("parent").alias(p))
    return best.join(whose("feature", "__p"), "feature", "left").join(whose("other", "__q"), "other", "left").select("feature", "rank", "other", F.coalesce(F.col("__p") == F.col("__q"), F.lit(False)).alias("same_parent"), "r")
