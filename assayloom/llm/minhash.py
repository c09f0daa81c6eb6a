"""Operator 2: near-duplicate documents by one-permutation MinHash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import SMALL_BATCH_BYTES, bounded_batches, maybe_broadcast, saved
from .text import LOWER, mix, shingle_sets, slices, string_buffers, tidy

#: Bytes of one signature value.
VALUE = 2
#: Members of a bucket in a side of a tile, at most. Rows of tiles in a task, about: comparing them costs far more than their bytes say, so
#: bytes must not decide on the number of tasks.
TILE_MAX, TASK_ROWS = 1024, 4096


@dataclass(frozen=True)
class Banding:
    """bands of rows values each; the chance that a pair at the threshold meets in no band is (1 - threshold^rows)^bands."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def _donors(bins: int, tries: int) -> np.ndarray:
    """For each bin, the bins that it asks in turn when it is empty: a hash of bin and try, the same for all documents."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x100000001B3) + np.arange(tries, dtype=np.uint64)[None, :]
    return (mix(mix(at) + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def signature(hashes: np.ndarray, bins: int, donors: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification of a sorted, non-empty set of 64-bit hashes.

    The hash range is cut into equal bins; each holds its smallest hash (the low 16 bits are kept). An empty bin copies the first
    non-empty bin among its donors.
    """
    width = (1 << 64) // bins
    edges = np.arange(bins, dtype=np.uint64) * np.uint64(width)
    at = np.searchsorted(hashes, edges)
    full = np.append(at[1:], len(hashes)) > at
    value = (hashes[np.minimum(at, len(hashes) - 1)] & np.uint64(0xFFFF)).astype(np.uint16)
    empty = np.flatnonzero(~full)
    pick = np.full(len(empty), np.flatnonzero(full)[0])
    at, todo = 0, np.arange(len(empty))
    while len(todo) and at < donors.shape[1]:  # most bins find a donor soon
        ask = donors[empty[todo], at : 4 * at + 64]
        found = full[ask]
        got = found.any(axis=1)
        pick[todo[got]] = ask[got, found[got].argmax(axis=1)]
        at, todo = 4 * at + 64, todo[~got]
    value[empty] = value[pick]
    return value


def sketches(docs: DataFrame, id_col: str, text_col: str, b: Banding) -> DataFrame:
    """(id, n, fp, sig) of every row: set size, 128-bit fingerprint of the set, signature; fp and sig are null for empty sets."""

    bounded_batches(docs.sparkSession, SMALL_BATCH_BYTES)

    def run(batches):
        donors = _donors(b.bins, 64 * b.bins)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = string_buffers(part.column("text"))
                n, fp, sig = [], [], []
                for s in shingle_sets(LOWER[data], offsets, b.shingle):
                    n.append(len(s))
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(signature(s, b.bins, donors).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "fp", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "id long, n long, fp binary, sig binary")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, b: Banding) -> DataFrame:
    """(rep, set) for the rows whose id is in wanted.rep: the whole shingle sets, as packed 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = string_buffers(part.column("text"))
                s = [x.tobytes() for x in shingle_sets(LOWER[data], offsets, b.shingle)]
                fp = [hashlib.blake2b(x, digest_size=16).digest() for x in s]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp, pa.binary()), pa.array(s, pa.binary())], ["rep", "fp", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(maybe_broadcast(wanted.select(F.col("rep").alias("id"))), "id", "left_semi").mapInArrow(tidy(run), "rep long, fp binary, set binary")
    return found.join(wanted, ["rep", "fp"], "left_semi").groupBy("rep").agg(F.first("set").alias("set"))


def _similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b, set_a, set_b) of pairs whose sets are similar, as (a, b)."""

    def run(batches):
        for batch in batches:
            keep = [_similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long")


def _slack(n: np.ndarray, bins: int, percent: int) -> np.ndarray:
    """Share of equal bins below which a pair at the threshold falls with a chance under one in a million (five sigma)."""
    p = percent / 100
    return p - 5 * np.sqrt(p * (1 - p) / np.minimum(np.maximum(n, 1), bins))


def _near(sig_a, n_a, sig_b, n_b, b: Banding) -> np.ndarray:
    """Which pairs can be at the threshold, from signatures and set sizes; broadcasts over leading axes."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    equal = np.count_nonzero(sig_a == sig_b, axis=-1) / b.bins
    return (100 * small >= b.percent * large) & (equal >= _slack(small, b.bins, b.percent))


def _plausible(pairs: DataFrame, b: Banding) -> DataFrame:
    """The pairs (a, b, n_a, n_b, sig_a, sig_b) that their signatures do not rule out, as (a, b)."""

    def run(batches):
        for batch in batches:
            if len(batch):
                sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, b.bins) for c in ("sig_a", "sig_b")]
                n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
                yield batch.select(["a", "b"]).filter(pa.array(_near(sig[0], n[0], sig[1], n[1], b)))

    return pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(tidy(run), "a long, b long")


class _Union:
    def __init__(self, labels):
        self.up = {x: x for x in labels}

    def top(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def _shapes(rows: DataFrame) -> DataFrame:
    """(key, most, in_most, in_rest) of buckets (key, comp, ...): their largest component, its members, and the members of all others."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    return sizes.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.max("m").alias("in_most"), (F.sum("m") - F.max("m")).alias("in_rest"))


def _parts(members: str):
    return F.ceil(F.col(members) / TILE_MAX).cast("int")


def _tiles(rows: DataFrame) -> DataFrame:
    """rows (key, rep, comp, ...) of buckets, dealt to (key, tile) groups so that any two members of a bucket that are in different components meet
    in one group.

    A bucket of at most TILE_MAX members is one group. In a larger one the members of the largest component are joined already: they meet
    those of other components alone. Both are cut into parts of TILE_MAX members; each pair of a part of the largest with a part of the
    rest is a group, and each pair of parts of the rest. So a bucket whose stars left k members of m aside takes k * m comparisons,
    and about m rows while k is under TILE_MAX. side: bit 1 for the lower part of the group, bit 2 for the higher.
    """
    cut = rows.join(_shapes(rows).select("key", "most", _parts("in_most").alias("p_most"), _parts("in_rest").alias("p_rest"), _small().alias("small")), "key")
    large = F.col("comp") == F.col("most")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(large, F.col("p_most")).otherwise(F.greatest("p_rest", F.lit(1)))).cast("int"))
    tile = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array().cast("array<struct<tile:struct<kind:int,lo:int,hi:int>,side:int>>"))
    part = F.col("part")
    of = lambda t, side: F.struct(t.alias("tile"), side.cast("int").alias("side"))
    met = F.when(F.col("small"), F.array(of(tile(1, F.lit(0), F.lit(0)), F.lit(3)))).when(large, upto("p_rest", lambda i: of(tile(0, part, i), F.lit(1)))).otherwise(F.concat(
        upto("p_most", lambda i: of(tile(0, i, part), F.lit(2))),
        upto("p_rest", lambda i: of(tile(1, F.least(part, i), F.greatest(part, i)), F.when(i == part, 3).when(part < i, 1).otherwise(2))),
    ))
    return cut.withColumn("met", F.explode(met)).select(*rows.columns, "met.tile", "met.side")


def _small():
    """Whether a bucket fits one group, and has open pairs."""
    return (F.col("in_rest") > 0) & (F.col("in_most") + F.col("in_rest") <= TILE_MAX)


def _dealt(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """rows of tiles, dealt to as many tasks as the rows that narrow (key, comp, ..., a written table) makes need."""
    p, q = _parts("in_most"), _parts("in_rest")
    made = F.when(_small(), F.col("in_most") + F.col("in_rest")).otherwise(F.col("in_most") * q + F.col("in_rest") * (p + q))
    n = _shapes(narrow).agg(F.sum(made).alias("n")).first()["n"] or 0
    return rows.repartition(max(1, -(-n // TASK_ROWS)), "key", "tile").groupBy("key", "tile")


def _in_tile(pdf, b: Banding):
    """Signatures, sizes, labels and the pairs of a tile that this tile has to look at: index arrays i, j."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, b.bins)
    n, comp, band, side = pdf["n"].to_numpy(), pdf["comp"].to_numpy(), int(pdf["band"].iloc[0]), pdf["side"].to_numpy()
    keys = sig.reshape(-1, b.bands, b.rows)
    lower, upper = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    out_i, out_j = [], []
    for i in lower.tolist():
        j = upper[upper > i] if side[i] == 3 else upper
        j = j[comp[j] != comp[i]]
        if not len(j):
            continue
        j = j[_near(sig[i], n[i], sig[j], n[j], b)]
        if band and len(j):  # a pair belongs to the first band that it shares
            j = j[~(keys[j, :band] == keys[i, :band]).all(axis=-1).any(axis=-1)]
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def _rest(members: DataFrame, classes: DataFrame, label: DataFrame, sets: DataFrame, b: Banding) -> DataFrame:
    """Links between members of one bucket that the stars left in different components.

    First signatures alone say which members of a bucket have a partner that may be similar; those members then meet again with
    their whole sets. A tile returns links that join components, never all pairs, and skips pairs that its own links have joined.
    """
    named = members.join(label.toDF("rep", "component"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    sketched = classes.select("rep", "n", "sig")
    named = saved(named.join(mixed, "key", "left_semi"), "mixed")
    rows = _tiles(named).join(sketched, "rep")

    def partners(pdf):
        import pandas as pd

        i, j = _in_tile(pdf, b)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "band": pdf["band"].iloc[0], "rep": pdf["rep"].to_numpy()[np.unique(np.concatenate([i, j]))]})

    near = _dealt(rows, named).applyInPandas(partners, "key long, band int, rep long").distinct()
    near = saved(near.join(named.select("key", "rep", "comp"), ["key", "rep"]), "near")
    full = _tiles(near).join(sketched, "rep").join(sets, "rep")

    def links(pdf):
        import pandas as pd

        i, j = _in_tile(pdf, b)
        rep, comp, n = pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), pdf["n"].to_numpy()
        union, found = _Union(comp.tolist()), []
        sizes = np.array([len(x) // 8 for x in pdf["set"]])
        stacked, local = np.unique(np.frombuffer(b"".join(pdf["set"]), np.uint64), return_inverse=True)
        first, mark = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(stacked), bool)
        for a in np.unique(i).tolist():
            js = [x for x in j[i == a].tolist() if union.top(comp[x]) != union.top(comp[a])]
            mine = local[first[a] : first[a + 1]]
            mark[mine] = True
            for x in js:
                both = int(np.count_nonzero(mark[local[first[x] : first[x + 1]]]))
                if 100 * both >= b.percent * (int(n[a]) + int(n[x]) - both):
                    found.append((rep[a], rep[x]))
                    union.up[union.top(comp[x])] = union.top(comp[a])
            mark[mine] = False
        return pd.DataFrame(found, columns=["a", "b"])

    return _dealt(full, near).applyInPandas(links, "a long, b long").distinct()


def _one_set_per_id(base: DataFrame) -> DataFrame:
    """base; where an id has several sets, each of its rows gets the largest of them (ties: by fingerprint)."""
    repeated = base.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    if repeated.isEmpty():
        return base
    best = base.join(repeated, "id").groupBy("id").agg(F.max(F.struct("n", "fp", "sig")).alias("best"))
    return base.join(best, "id", "left").select("id", *(F.coalesce(f"best.{c}", c).alias(c) for c in ("n", "fp", "sig")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", banding: Banding | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    A document's set holds its distinct word shingles (A-Z lower-cased, words parted by ASCII white space; a shorter document's
    whole sequence counts as one; no words: empty, linked with nothing). Documents link when 100 * |intersection| >= percent *
    |union| on the whole sets. component_id is the smallest id reachable; kept says that it is the row's own id.

    Steps: (1) a sketch per row: set size, set fingerprint, one-permutation signature with optimal densification; (2) equal sets
    become one class, named by its smallest id, so copies never meet pairwise; (3) bands of the signatures bucket the classes and
    each bucket gives a star of candidates around a centre drawn by hash; (4) stars are confirmed on the whole sets, fetched anew
    for classes that share a bucket; (5) connected components; (6) buckets that still hold several components are searched in
    tiles of bounded size for links that the stars missed; (7) components again. Two steps are probabilistic, everything else is
    exact: banding misses a pair at the threshold with a chance of 5e-8 (default; 4e-7 with op2's), and signatures rule out a pair
    whose equal bins lie five deviations under the threshold (a pair at the threshold: under one in a million).

    Null texts count as empty. Rows with a null id link with nothing: component_id null, kept true. Rows that share an id count
    as one document, with the largest of their sets. Repeated rows come out repeated. An empty table gives an empty table; other columns are not read.
    """
    b = banding or Banding()
    base = _one_set_per_id(saved(sketches(docs, id_col, text_col, b), "sketch"))
    valid = base.where("id is not null and n > 0")
    reps = valid.groupBy("fp").agg(F.min("id").alias("id"))
    classes = saved(valid.join(reps, ["fp", "id"]).dropDuplicates(["id"]).withColumnRenamed("id", "rep"), "class")
    key = F.expr(f"transform(sequence(0, {b.bands - 1}), i -> xxhash64(i, substring(sig, i * {b.rows * VALUE} + 1, {b.rows * VALUE})))")
    banded, h = classes.select("rep", F.posexplode(key).alias("band", "key")), F.xxhash64("rep", "key")
    # most buckets have one member: the few others are written first, so that only their rows, not those of all bands, have to be joined
    shared = saved(banded.groupBy("key").agg(F.count("*").alias("m"), F.min(h).alias("top")).where("m > 1").select("key", "top"), "shared")
    members = saved(banded.join(maybe_broadcast(shared), "key").select("key", "band", "rep", (h == F.col("top")).alias("centre")), "members")
    wanted = saved(members.select("rep").distinct().join(classes.select("rep", "fp"), "rep"), "wanted")
    sets = saved(_sets(docs, id_col, text_col, wanted, b), "sets")
    stars = members.where("not centre").select("key", F.col("rep").alias("b")).join(members.where("centre").select("key", F.col("rep").alias("a")), "key").select("a", "b").distinct()
    half = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    stars = saved(_plausible(stars.join(half("a"), "a").join(half("b"), "b"), b), "stars")
    links = saved(confirmed(stars.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b"), b.percent), "links")
    label = connected_components(links)
    more = saved(_rest(members, classes, label, sets, b), "rest")
    if not more.isEmpty():
        label = connected_components(links.unionByName(more))
    known = classes.select("fp", "rep").join(label.toDF("rep", "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = base.select("id", "n", "fp").join(known, "fp", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", banding: Banding | None = None) -> DataFrame:
    """docs without the rows whose near-duplicate group has a smaller id; the same columns. Rows that repeat a kept id count once: the one
    whose text sorts first stays. Rows with a null id all stay. Columns of any name are allowed."""
    found = saved(near_duplicates(docs, id_col, text_col, banding), "dedup")
    gone = saved(found.where("not kept").select(id_col).distinct(), "gone")
    kept = docs.join(maybe_broadcast(gone), id_col, "left_anti").select(docs.columns)
    repeated = saved(found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    if repeated.isEmpty():
        return kept
    rank = next("rank" + "_" * k for k in range(len(docs.columns) + 1) if "rank" + "_" * k not in docs.columns)
    one = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col).cast("string")))
    firsts = kept.join(repeated, id_col, "left_semi").withColumn(rank, one).where(F.col(rank) == 1)
    return kept.join(repeated, id_col, "left_anti").select(docs.columns).unionByName(firsts.select(docs.columns))
