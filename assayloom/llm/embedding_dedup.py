"""Operator 5: near-duplicate vectors by spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import connected_components
from .store import saved
from .vectors import common_length, packed, sample, spherical_kmeans, stack, unit

#: Vectors that k-means sees, cells at most, rounds of k-means that a number of cells is judged by, and the members a side of a tile.
SAMPLE, CELLS, JUDGING_ROUNDS, TILE_MAX = 16_384, 1024, 3, 1024
#: Seconds that a row in a tile and a compared pair take, about: they weigh visits against the size of cells.
ROW_COST, PAIR_COST = 20e-6, 20e-9
#: Rounding that the geometry of cells and a blocked product may be off by.
EPS = 1e-9


def _gaps(centres: np.ndarray, threshold: float) -> np.ndarray:
    """How far behind its own centre another may be for a vector to visit it; see _placed."""
    return np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) * math.sqrt(2 - 2 * threshold) + EPS


def _visits(near: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own cell, and the cells that it visits (rows x cells), from its cosines with all centres."""
    home = near.argmax(axis=1)
    return home, (near[np.arange(len(near)), home][:, None] - near <= gap[home]) & (np.arange(near.shape[1])[None, :] > home[:, None])


def fit_cells(fit: np.ndarray, n: int, labels: int, threshold: float, seed: int) -> np.ndarray:
    """Centres for n vectors of so many labels, from a sample.

    More cells have fewer members, but vectors that are no cluster's visit more of them. The cost of 1, 4, 16 ... CELLS cells is reckoned from
    the sample's visits, each from a few rounds of k-means, and the cheapest number is taken and fitted in full. All are judged: the cost
    may rise before it falls. A number that would be no cheaper even without visits is passed over.
    """

    def cost(k: int, copies: float) -> float:
        members = n * copies / (labels * k)
        return copies * (math.ceil(members / TILE_MAX) * ROW_COST + members * PAIR_COST)

    best, best_cost, k = 1, cost(1, 1.0), 4
    while k <= min(CELLS, max(1, len(fit) // 4)):
        if cost(k, 1.0) < best_cost:
            centres = spherical_kmeans(fit, k, seed, JUDGING_ROUNDS)
            copies = 1 + _visits(fit @ centres.T, _gaps(centres, threshold))[1].sum(axis=1).mean()
            if cost(k, copies) < best_cost:
                best, best_cost = k, cost(k, copies)
        k *= 4
    return fit[:1] if best == 1 else spherical_kmeans(fit, best, seed)


def _placed(classes: DataFrame, centres: np.ndarray, threshold: float, d: int) -> DataFrame:
    """(rep, vec, label, copies, cell, home) once for each class's own cell, and once more as a visitor for every later cell that may
    hold a partner.

    A partner y of x is within the chord r = sqrt(2 - 2 threshold). If y's cell is c, y lies on c's side of the plane midway
    between c and x's own centre h, so x is within r of that plane: x.h - x.c <= r |h - c|. Both of a pair see each other's cell
    this way; the one in the earlier cell visits the later. No pair is lost, and no pair meets twice.
    """
    gap = _gaps(centres, threshold)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            near = unit(stack(batch.column("vec").to_pylist(), d)) @ centres.T
            home, visits = _visits(near, gap)
            row, cell = np.nonzero(visits)
            at = pa.array(np.concatenate([np.arange(len(near)), row]))
            extra = [pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(np.arange(len(at)) < len(near))]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), *extra], [*batch.schema.names, "cell", "home"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("rep", "vec", "label", "copies").mapInArrow(run, f"rep long, vec binary, label {kind}, copies long, cell int, home boolean")


def _tiles(rows: DataFrame) -> DataFrame:
    """rows with lo, hi: groups (label, cell, lo, hi) of bounded size in which any two members of a cell meet once; side: 1 lower part, 2 higher, 3 both."""
    sizes = rows.groupBy("label", "cell").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / TILE_MAX).cast("int")
    cut = rows.join(sizes.withColumn("p", parts).drop("m"), ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), "p").cast("int"))
    return cut.withColumn("other", F.explode(F.expr("sequence(0, p - 1)"))).withColumns({
        "lo": F.least("part", "other"), "hi": F.greatest("part", "other"),
        "side": F.when(F.col("part") == F.col("other"), 3).when(F.col("part") < F.col("other"), 1).otherwise(2),
    }).drop("p", "part", "other")


def _forest(adjacent: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> list[tuple[int, int]]:
    """(root, other) for the members of each component with links; adjacent: lower x upper, indices into the tile."""
    left, right, out = np.ones(len(lower), bool), np.ones(len(upper), bool), []
    index = {}  # a member can stand on both sides
    for s, m in enumerate(upper.tolist()):
        index[m] = s
    for start in np.flatnonzero(adjacent.any(axis=1)).tolist():
        if not left[start]:
            continue
        left[start] = False
        root, todo, members = int(lower[start]), [start], {int(lower[start])}
        while todo:
            found = adjacent[todo].any(axis=0) & right
            right[found] = False
            members.update(upper[found].tolist())
            own = [i for i in np.flatnonzero(left).tolist() if int(lower[i]) in members]
            reach = np.flatnonzero(adjacent[:, found].any(axis=1) & left).tolist() if found.any() else []
            todo = sorted({*own, *reach})
            left[todo] = False
            members.update(lower[todo].tolist())
        out += [(root, m) for m in members if m != root]
    return out


def _links(placed: DataFrame, threshold: float, d: int) -> DataFrame:
    """(a, b, n): rows with n are link counts of class a from one tile; rows with b join a and b in a component."""

    def run(pdf):
        import pandas as pd

        raw = stack(pdf["vec"], d)
        norm, home, side = np.sqrt(np.einsum("ij,ij->i", raw, raw)), pdf["home"].to_numpy(bool), pdf["side"].to_numpy()
        rep, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        lower, upper = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        near = (raw[lower] @ raw[upper].T) / np.outer(norm[lower], norm[upper])
        for i, j in np.argwhere(np.abs(near - threshold) < EPS):  # by the definition, not by a blocked product's rounding
            near[i, j] = raw[lower[i]] @ raw[upper[j]] / (norm[lower[i]] * norm[upper[j]])
        link = (near >= threshold) & (home[lower][:, None] | home[upper][None, :])
        if side[0] == 3:
            link &= lower[:, None] < upper[None, :]
        counts = np.zeros(len(pdf), np.int64)
        np.add.at(counts, lower, link @ copies[upper])
        np.add.at(counts, upper, copies[lower] @ link)
        got = np.flatnonzero(counts)
        rows = pd.DataFrame({"a": rep[got], "b": pd.array([None] * len(got), "Int64"), "n": counts[got]})
        if side[0] == 3:
            link |= link.T
        joins = _forest(link, lower, upper)
        more = pd.DataFrame({"a": [rep[x] for x, _ in joins], "b": pd.array([rep[y] for _, y in joins], "Int64"), "n": 0})
        return pd.concat([rows, more]).astype({"a": "int64", "n": "int64"})

    return _tiles(placed).groupBy("label", "cell", "lo", "hi").applyInPandas(run, "a long, b long, n long")


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, seed: int = 23) -> DataFrame:
    """One row per row of table: id_col, n_links, component_id, kept.

    Rows of equal, non-null labels link when their cosine in double precision reaches threshold. Equal vectors of a label become
    one class with a count, so that copies never meet pairwise. Spherical k-means, fitted on at most SAMPLE classes, gives each
    class a cell; a class also visits the cells that may hold a partner (see _placed: exact, not a heuristic). Cells are compared
    in tiles of bounded size by matrix products; tiles return counts and spanning links, never all pairs.

    component_id is the smallest id reachable by links (rows that link with nothing: their own id), kept says that it is the row's
    own. Rows with a null id or label, and vectors that are null, empty, zero, hold null or non-finite components or are not of
    the table's commonest length link with nothing: n_links 0. For a null id component_id is null and kept true. Repeated rows
    count as vectors of their own; rows that share an id but not a vector share their links. Other columns are not read.
    """
    base = packed(table.withColumn("__label", F.col(label_col)), id_col, vec_col, "__label").withColumnRenamed("__label", "label")

    def named(batches):
        for batch in batches:
            fp = [hashlib.blake2b(v, digest_size=16).digest() if v is not None else None for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.binary())], [*batch.schema.names, "fp"])

    base = saved(base.mapInArrow(named, StructType([*base.schema.fields, StructField("fp", BinaryType())])), "vectors")
    d = common_length(base)
    valid = base.where((F.col("label").isNotNull()) & (F.expr("octet_length(vec)") == 4 * d))
    sizes = valid.groupBy("label", "fp").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = saved(valid.join(sizes, ["label", "fp", "vec_id"]).dropDuplicates(["label", "fp"]), "vector-classes")
    n = classes.count()
    fit = sample(classes, SAMPLE, d, seed)
    labels = classes.select("label").distinct().count()
    centres = fit_cells(fit, n, labels, threshold, seed) if len(fit) else np.zeros((1, max(d, 1)))
    placed = saved(_placed(classes.withColumnRenamed("vec_id", "rep"), centres, threshold, d), "placed")
    found = saved(_links(placed, threshold, d), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("far"))
    label = connected_components(found.where("b is not null").select("a", "b").distinct())
    known = classes.select("label", "fp", F.col("vec_id").alias("rep"), "copies").join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(label.toDF("rep", "component"), "rep", "left")
    known = known.select("label", "fp", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = base.select("vec_id", "label", "fp").join(known, ["label", "fp"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
