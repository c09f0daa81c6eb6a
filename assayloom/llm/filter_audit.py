"""Operator 12: how filters interact: what each removes, doubles or alone catches, in every order of application."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved

#: The filters' letters; a document's mask has bit i set if it fails LETTERS[i]. The last is the filter of exact copies.
LETTERS = "ABCDE"
COPY = 1 << (len(LETTERS) - 1)
#: Bytes of texts that a task holds back to find copies among its own rows; beyond it they are sent on.
HOLD_BYTES = 24 << 20
#: Bytes of texts that a task of the routed side should get; Python sorts them on disk beyond its memory.
TASK_BYTES = 64 << 20

_CAPITALS = bytes(range(65, 91))
_JUNK = re.compile(rb"[#$%&*|]")


def text_mask(text: str) -> int:
    """Which of the filters A to D a text fails. A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals (A-Z) > 5 *
    code points; D: holds any of # $ % & * |. Words are maximal runs without ASCII white space, as bytes.split() cuts them."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 5 * len(text)) << 2
        | (_JUNK.search(raw) is not None) << 3
    )


def _local(mask_of):
    """Rows (id, part, text) of one task as routed records ((fingerprint, id), (text, id, part, mask, n)).

    Copies within a task meet here: a row that has a smaller id beside it is a copy at once and goes on without its text, dealt round
    robin; only the least id of a text, with how many rows of each part repeat it, is routed with the text. So a text sends at
    most one record for each part, task and HOLD_BYTES, however many rows repeat it.
    """

    def run(rows):
        held, size = {}, 0  # text -> [least id, mask, {part: rows}]
        turn = itertools.count()

        def decided(doc, part, mask, n):
            return (next(turn), 0), (None, doc, part, mask, n)

        for doc, part, text in rows:
            text, part = text or "", part or ""
            if doc is None:
                yield decided(None, part, mask_of(text), 1)
                continue
            entry = held.get(text)
            if entry is None:
                held[text] = [doc, mask_of(text), {part: 1}]
                size += len(text) + 200
                if size > HOLD_BYTES:
                    yield from _sent(held)
                    held, size = {}, 0
            elif doc > entry[0]:
                yield decided(doc, part, entry[1] | COPY, 1)
            elif doc == entry[0]:
                entry[2][part] = entry[2].get(part, 0) + 1
            else:
                for p, n in entry[2].items():
                    yield decided(entry[0], p, entry[1] | COPY, n)
                entry[0], entry[2] = doc, {part: 1}
        yield from _sent(held)

    return run


def _sent(held: dict):
    for text, (doc, mask, parts) in held.items():
        fingerprint = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        for part, n in parts.items():
            yield (fingerprint, doc), (text, doc, part, mask, n)


def _chains(records):
    """Routed records, sorted by (fingerprint, id), as (id, part, mask, n). The chain of a fingerprint holds each of its texts with its
    least id; a later, larger id of the same text is a copy. What is decided already, without a text, passes."""
    at, chain = None, {}
    for (fingerprint, _), (text, doc, part, mask, n) in records:
        if fingerprint != at:
            at, chain = fingerprint, {}
        if text is not None and doc > chain.setdefault(text, doc):
            mask |= COPY
        yield doc, part, mask, n


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", mask_of=text_mask) -> DataFrame:
    """(id, part, mask, n): n rows of docs with this id and part fail the filters in mask.

    Copies are found by exact text: records are partitioned by the xxhash of their text and compared in chains on the whole text. Null
    texts count as empty ones, null parts as the empty string. A row without id is no copy of anything, and nothing is a copy of
    it; rows that repeat an id and text are not copies of each other. Written in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long"), F.col(part_col).cast("string"), F.col(text_col).cast("string").alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(n_bytes // TASK_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = docs.rdd.mapPartitions(_local(mask_of))
    routed = records.repartitionAndSortWithinPartitions(n, lambda key: key[0])
    return saved(spark.createDataFrame(routed.mapPartitions(_chains), "id long, part string, mask int, n long", verifySchema=False), "filter-masks")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids (column id) whose text equals that of a smaller id. Nulls, repeated rows: as in masks()."""
    found = masks(docs.withColumn("__part", F.lit("")), id_col, text_col, "__part", lambda text: 0)
    return found.where(F.col("mask") != 0).select("id").distinct()


#: Fixed shapes over (order, step) x mask: who is removed at a step, was removed before, is still kept; and the order's letters.
def _grid():
    orders = list(itertools.permutations(range(len(LETTERS))))
    mask = np.arange(1 << len(LETTERS))
    rows = []
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = (mask >> f & 1).astype(bool), (mask & before) > 0
            rows.append(("".join(LETTERS[i] for i in order), step, f, ~fails & ~gone, fails & ~gone, fails & gone, mask == 1 << f))
            before |= 1 << f
    return [r[:3] for r in rows], *(np.array([r[i] for r in rows], np.int64) for i in range(3, 7))


def _report(part_and_counts):
    """All rows of one part from its counts by mask: all documents, good ones, toxic ones."""
    part, counts = part_and_counts
    everything, good, toxic = counts.reshape(3, -1)
    rows, kept, removed, redundant, alone = _grid()
    bits = np.array([bin(m).count("1") for m in range(1 << len(LETTERS))])
    # of all orders, a failed filter comes first among the failed ones in one of `bits`
    share = [int((everything * (np.arange(len(bits)) >> f & 1) * math.factorial(len(LETTERS)) // np.maximum(bits, 1)).sum()) for f in range(len(LETTERS))]
    columns = [x.tolist() for x in (kept @ everything, removed @ everything, redundant @ everything, alone @ everything, removed @ good, removed @ toxic)]
    for (order, step, f), *values in zip(rows, *columns, strict=True):
        yield (part, order, step, *values, share[f])


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _merge_row(vector: np.ndarray, row) -> np.ndarray:
    mask, n, good, toxic = row
    size = len(vector) // 3
    vector[mask] += n
    vector[size + mask] += n * good
    vector[2 * size + mask] += n * toxic
    return vector


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", mask_of=text_mask) -> DataFrame:
    """One row per part, order of the five filters and step: see REPORT.

    Everything follows from how many documents of a part have each of the 32 masks: those counts, of all documents and of those that
    labels call good (quality 1) or toxic (toxic 1), are merged as vectors, in each task first. A document counts as
    good or toxic if any of the labels' rows of its id says so; without an id, or without labels, as neither. Repeated rows count
    each. Very long texts pass whole. An empty table gives no rows. Other columns, of any name, are not read.
    """
    size = 1 << len(LETTERS)
    known = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    known = known.where("id is not null and (g or t)").groupBy("id").agg(F.max(F.coalesce("g", F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce("t", F.lit(False)).cast("int")).alias("toxic"))
    found = masks(docs, id_col, text_col, part_col, mask_of).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    rows = found.join(known, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    vectors = saved(rows, "filter-counts").rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: _merge_row(np.zeros(3 * size, np.int64), row), _merge_row, np.add)
    return docs.sparkSession.createDataFrame(vectors.flatMap(_report), REPORT)
