"""Operator 8: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import maybe_broadcast, saved

#: Words in a block, and words in a shard of a source (about; a shard is what one window task orders).
BLOCK_WORDS, SHARD_WORDS = 64, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def capped_targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of total by weight; none above most * size: what is above is shared anew among the others, until none is."""
    cap, out, left = most * sizes.astype(float), np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while left.any():
        level = (total - cap[~left].sum()) / weights[left].sum()
        over = left & (weights * level >= cap)
        if not over.any():
            out[left] = weights[left] * level
            break
        left &= ~over
    out[~left] = cap[~left]
    return out


def sainte_lague(shares: np.ndarray, seats: int) -> np.ndarray:
    """Integer quotas that sum to seats, by highest quotients share / (2 k + 1); ties go to the earlier entry.

    Found by a search for the divisor, then by the highest (lowest) single quotients, not by seating one block at a time.
    """
    shares = np.asarray(shares, float)
    if not len(shares) or shares.sum() <= 0 or seats <= 0:
        return np.zeros(len(shares), np.int64)
    lo, hi = 0.0, 2.0 * seats / shares.sum() + len(shares) / shares.sum()
    for _ in range(200):
        mid = (lo + hi) / 2
        if int(np.floor(shares * mid + 0.5).sum()) <= seats:
            lo = mid
        else:
            hi = mid
    quota = np.floor(shares * lo + 0.5).astype(np.int64)
    left = seats - int(quota.sum())  # entries that tie at the divisor get one more each, the earlier ones first
    quota[np.argsort(-shares / (2 * quota + 1), kind="stable")[:left]] += 1
    return quota


def source_plan(sources: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int) -> DataFrame:
    """sources (source, source_size), one row each, with target and blocks. One task holds the table: a row per source, no documents."""

    def run(pdf):
        order = sorted(range(len(pdf)), key=lambda i: (pdf["source"][i] is None, pdf["source"][i] or ""))
        pdf = pdf.iloc[order].reset_index(drop=True)
        sizes = pdf["source_size"].to_numpy().astype(np.int64)
        w = np.array([weights[i % len(weights)] for i in range(len(pdf))], float)
        total = share * float(sizes.sum())
        target = capped_targets(sizes, w, total, most)
        return pdf.assign(target=target, blocks=sainte_lague(target, round(total / block)))[["source", "source_size", "target", "blocks"]]

    return sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "source string, source_size long, target double, blocks long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK_WORDS, shard: int = SHARD_WORDS) -> DataFrame:
    """One row per row of docs: id_col, source_col, size, source_size, target, taken, and h (a hash of id and text that keys the row).

    size counts words parted by ASCII white space (null text: 0). Sources in code-point order (null last) take weights in turn and
    share `share` of all sizes; targets stop at most * source_size. Sainte-Lague turns targets into whole blocks of `block` words
    per source, and a source's blocks into whole blocks per shard (shards are cut by hash, so that a source that holds a third of
    all rows is many shards). In a shard, documents stand in an order seeded by `seed` and their words, read round and round, are cut
    into blocks of `block` words. The shard gives its quota of blocks in a row from a block on that the seed draws: every word as
    often as the quota goes round, and the words of the last, partial round once more. As the order is random, so are the documents
    of that round, and it cuts two of them at most. No document gives more than ceil(most) times its size, and the same input
    gives the same mix whatever its partitions are.

    Null ids and null texts are allowed; repeated rows are separate rows, of which either may be the one taken. Rows without words
    take no part in shards. Without any word all targets are 0. An empty table gives an empty table. Other columns are not read.
    """
    row = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = saved(row.select("id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "id", "text").alias("h")), "sized")
    plan = saved(source_plan(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, block), "sources")
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("int"))
    keyed = sized.join(plan.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), "shards").cast("int"))
    worded = keyed.where("size > 0")
    by_shard = worded.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))

    def quotas(pdf):  # a row per shard of a source, of about a million words each
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        size = pdf["shard_size"].to_numpy()
        return pdf.assign(quota=np.minimum(sainte_lague(size, int(pdf["blocks"][0])) * block, (most * size).astype(np.int64)))[["source", "shard", "shard_size", "quota"]]

    quota = saved(by_shard.groupBy("source").applyInPandas(quotas, "source string, shard int, shard_size long, quota long"), "quota")
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.ceil(F.col("shard_size") / block)) * block
    q = quota.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", F.expr("quota div shard_size").alias("rounds"), begin.alias("run_from"), (begin + F.expr("quota % shard_size")).alias("run_to"))
    before = Window.partitionBy("source", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = worded.withColumn("from", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("to", F.col("from") + F.col("size"))
    joined = placed.join(q, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    inside = lambda lo, hi: F.greatest(F.lit(0), F.least("to", hi) - F.greatest("from", lo))
    once_more = inside(F.col("run_from"), F.least("run_to", "shard_size")) + inside(F.lit(0), F.col("run_to") - F.col("shard_size"))
    out = joined.withColumn("taken", (F.col("rounds") * F.col("size") + once_more).cast("long")).select("id", "source", "size", "source_size", "target", "taken", "h")
    rest = keyed.where("size = 0").select("id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "h")
    return out.unionByName(rest).withColumnsRenamed({"id": id_col, "source": source_col})


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """docs as the mix takes them: whole documents, each as often as its taken words over its size, rounded (half up); the same columns.

    Documents without words are not in the mix; rows that repeat each get an equal part of their copies, rounded up. A shard's run of blocks cuts two documents at most, and only those are rounded,
    so a source's words stay within two documents' sizes per shard of its quota. Columns of any name are allowed.
    """
    h, copies, rows, n = (next(c + "_" * k for k in range(len(docs.columns) + 1) if c + "_" * k not in docs.columns) for c in ("h", "copies", "rows", "n"))
    took = mix(docs, id_col, text_col, source_col, seed=seed, **how).where("size > 0").select(F.col("h").alias("key"), "taken", "size")
    took = took.groupBy(F.col("key").alias(h)).agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias(copies), F.count("*").alias(rows))
    took = saved(took.where(F.col(copies) > 0), "copies")
    found = docs.withColumn(h, F.xxhash64(F.lit(seed), id_col, F.col(text_col).cast("string"))).join(maybe_broadcast(took), h)
    return found.withColumn(n, F.explode(F.sequence(F.lit(1), F.ceil(F.col(copies) / F.col(rows)).cast("int")))).select(docs.columns)
