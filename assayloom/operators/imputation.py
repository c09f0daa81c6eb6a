"""Filling missing cells, and only those: never part of a plan, run by hand once a method has been chosen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Features with gaps that one scan of all features answers, numbers of them at most, and features that are compared at a time.
ASKED, NUMBERS, AT_ONCE = 4096, 8_000_000, 512


def min_prob(cells: DataFrame, keys: list[str], shift: float = 1.8, scale: float = 0.3, seed: int = 0) -> DataFrame:
    """Missing cells drawn from a normal below their sample's values (mean - shift sd, scale sd), by hash of the cell, so partitions don't
    matter. A sample with fewer than two values keeps its gaps. keys: what parts the cells (unit, batch)."""
    per = cells.groupBy(*keys, "sample").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__sd"))
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys, "sample", "feature"), F.lit(2**52)) + 0.5) / float(2**52)
    normal = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * np.pi * uniform(2))
    drawn = F.col("__m") - shift * F.col("__sd") + scale * F.col("__sd") * normal
    return cells.join(per, [*keys, "sample"]).withColumn("value", F.coalesce("value", drawn)).drop("__m", "__sd")


def _donors(wide: DataFrame, asked: list, samples: int, k: int) -> DataFrame:
    """(feature, at, d, donor, value): for each gap of the asked features the k nearest features of each task that have a value there."""
    names = np.array([r["feature"] for r in asked], object)
    x = np.array([[np.nan if v is None else v for v in r["y"]] for r in asked])
    shared = wide.sparkSession.sparkContext.broadcast((names, x))

    def run(batches):
        names, x = shared.value
        here, zero = np.isfinite(x).astype(float), np.nan_to_num(x)
        gaps = [np.flatnonzero(h == 0) for h in here]
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part in (batch.slice(at, AT_ONCE) for at in range(0, len(batch), AT_ONCE)):
                other = part.column("feature").to_pylist()
                z = np.array(part.column("y").flatten().to_numpy(zero_copy_only=False), float).reshape(len(part), samples)
                m, zz = np.isfinite(z).astype(float), np.nan_to_num(z)
                n = here @ m.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.sqrt(np.maximum(0, (zero**2) @ m.T + here @ (zz**2).T - 2 * zero @ zz.T) / n)
                d[n == 0] = np.inf
                d[names[:, None] == np.array(other, object)[None, :]] = np.inf
                for i, places in enumerate(gaps):
                    order = np.argsort(d[i], kind="stable")
                    order = order[np.isfinite(d[i, order])]
                    for p in places.tolist():
                        found = order[m[order, p] > 0][: k + 1]
                        if len(found):
                            held = best.get((i, p), []) + [(float(d[i, j]), other[j], float(z[j, p])) for j in found]
                            best[i, p] = sorted(held)[:k]
        rows = [(names[i], p, *hit) for (i, p), hits in best.items() for hit in hits]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["feature", "at", "d", "donor", "value"])

    return wide.select("feature", "y").mapInArrow(run, "feature string, at long, d double, donor string, value double")


def knn(cells: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """A missing cell becomes the mean of its feature's k nearest features that have a value in that sample, by root mean square difference
    over the samples that both have (ties by name); where no feature can tell, the sample's mean.

    Features with gaps are taken in blocks of bounded size; all features are scanned where they lie for each block, and a task gives the k
    nearest for each gap. keys: what parts the cells (unit, batch).
    """
    spark = cells.sparkSession
    groups = [r.asDict() for r in cells.select(*keys).distinct().collect()] if keys else [{}]  # units and batches
    filled = None
    for group in groups:
        own = cells
        for c, v in group.items():
            own = own.where(F.col(c).eqNullSafe(F.lit(v)))
        order = {r["sample"]: i for i, r in enumerate(own.select("sample").distinct().orderBy("sample").collect())}  # a row per sample
        at = spark.createDataFrame([(s, i) for s, i in order.items()], "sample string, at long")
        placed = own.join(at, "sample").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("value").cast("double")))).alias("m"))
        wide = placed.select("feature", F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.try_element_at("m", i.cast("long"))).alias("y")).persist()
        lacking = wide.where(F.exists("y", lambda v: v.isNull()))
        blocks = -(-lacking.count() // max(1, min(ASKED, NUMBERS // max(1, len(order)))))
        for b in range(blocks):
            asked = lacking.where(F.pmod(F.xxhash64("feature"), F.lit(blocks)) == b).collect()  # a block of bounded size
            if not asked:
                continue
            found = _donors(wide, asked, len(order), k)
            rank = F.row_number().over(Window.partitionBy("feature", "at").orderBy("d", "donor"))
            mean = found.withColumn("r", rank).where(F.col("r") <= k).groupBy("feature", "at").agg(F.avg("value").alias("__new")).join(at, "at").select("feature", "sample", "__new", *(F.lit(v).alias(c) for c, v in group.items()))
            filled = mean if filled is None else filled.unionByName(mean)
    if filled is None:
        return cells
    middle = cells.groupBy(*keys, "sample").agg(F.avg("value").alias("__mean"))
    joined = cells.join(filled, [*keys, "feature", "sample"], "left").join(middle, [*keys, "sample"], "left")
    return joined.withColumn("value", F.coalesce("value", "__new", "__mean")).select(cells.columns)
