"""Operator 7: exact token counts for every context limit, from a length histogram."""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved
from .text import slices, tidy


@lru_cache(2)
def encoder(path: str):
    """A byte-level BPE encoder from a file of ranks (one base64 token and its rank a line); kept by each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, ranks_path: str, text_col: str = "text", extra: int = 0) -> DataFrame:
    """(length, n_docs): how many rows of docs encode to each number of tokens (extra is added to each, for end tokens).

    Each task counts what it reads, so only (length, count) rows are shuffled. Null texts count as empty.
    """

    def run(batches):
        enc, seen = encoder(ranks_path), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                seen.update(len(enc.encode_to_numpy(t or "", disallowed_special=())) + extra for t in part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n_docs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """One row per distinct length, taken as a context limit, from (length, n_docs).

    n_docs: documents of exactly this length; docs_longer, tokens_longer: documents beyond the limit and their tokens (suffix
    sums); docs_total, tokens_total; tokens_truncated: tokens left when each document is cut at the limit; quantile: share of
    documents of at most this length, so the q-quantile of the lengths is the least length with quantile >= q. Between two
    listed lengths tokens_truncated is linear in the limit, with docs_longer as slope, so the rows answer every limit exactly.

    The ordered sums run over distinct lengths (not documents): there are no more than the longest document has tokens.
    """
    down = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    sums = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens")).withColumns({
        "docs_longer": F.coalesce(F.sum("n_docs").over(down), F.lit(0)),
        "tokens_longer": F.coalesce(F.sum("tokens").over(down), F.lit(0)),
    })
    sums = sums.withColumns({"docs_total": F.sum("n_docs").over(everything), "tokens_total": F.sum("tokens").over(everything)})
    return sums.select(
        F.col("length").alias("context_limit"), "n_docs", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("tokens_truncated"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def answer(table: DataFrame, limit: int) -> DataFrame:
    """One row of limits() for any limit, listed or not: docs_longer and tokens_truncated at limit."""
    above = table.where(F.col("context_limit") > limit)
    cut = above.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_longer"))
    kept = table.where(F.col("context_limit") <= limit).agg(F.coalesce(F.sum(F.col("n_docs") * F.col("context_limit")), F.lit(0)).alias("whole"))
    return cut.join(F.broadcast(kept)).select(F.lit(limit).alias("context_limit"), "docs_longer", (F.col("whole") + F.col("docs_longer") * limit).alias("tokens_truncated"))


def token_counts(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """limits() over the encoded lengths of docs. An empty table gives no rows. Null texts count as empty ones (length 0), repeated rows each; texts of any
    length are encoded whole; documents of equal length share a row, so there are no ties. Other columns, of any name, aren't read."""
    return limits(saved(encoded_lengths(docs, ranks_path, text_col), "lengths"))
