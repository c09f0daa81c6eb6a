"""Shared by the vector operators: reading array columns into numpy, and spherical k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "vec_id long, vec binary"


def packed(table: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """(vec_id, vec, *keep): each row's vector as packed 32-bit floats; vec is null where the row takes no part: its id or vector is
    null, or the vector is empty, zero or holds null or non-finite components."""

    def run(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                x = v.values
                good = i.is_valid and x is not None and len(x) and not x.null_count
                a = x.to_numpy() if good else None
                norm = float(a.astype(np.float64) @ a.astype(np.float64)) if good else 0.0
                out.append(a.tobytes() if 0 < norm < np.inf else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *batch.columns[2:]], ["vec_id", "vec", *keep])

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec"), *keep)
    schema = "vec_id long, vec binary" + "".join(f", {c} {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(run, schema)


def common_length(rows: DataFrame) -> int:
    """The most frequent number of components (ties: the smaller); vectors of another length take no part. 0 without vectors."""
    top = rows.where("vec is not null").groupBy(F.expr("octet_length(vec) div 4").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def stack(buffers, d: int) -> np.ndarray:
    """Packed vectors as rows of a double matrix."""
    return np.frombuffer(b"".join(buffers), np.float32).reshape(-1, d).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def sample(rows: DataFrame, most: int, d: int, seed: int) -> np.ndarray:
    """At most `most` rows' unit vectors, those of smallest seeded hash of the id: a bounded sample, the same on each run."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(most).select("vec").toArrow()
    return unit(stack(got.column(0).to_pylist(), d)) if got.num_rows else np.zeros((0, d))


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k unit centres for the unit vectors x, by Lloyd's rounds under cosine; empty cells restart at the worst-served vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        empty = np.flatnonzero(size < 1e-12)
        if len(empty):
            worst = np.argsort(near[np.arange(len(x)), cell], kind="stable")[: len(empty)]
            sums[empty], size[empty] = x[worst], 1.0
        centres = sums / size[:, None]
    return centres
