"""Operator 9: token ids in Parquet list columns, and reading them back."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import SMALL_BATCH_BYTES, bounded_batches, maybe_broadcast, new_path, saved
from .text import slices, string_buffers, tidy

#: Bytes of a row group and of a page, and rows of a page: the units of selective reads.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2000
#: Chunks that a worker remembers the ids of, about 120 MB; beyond it keeps the half that most slices held.
REMEMBERED = 600_000
#: ASCII letters, and ASCII signs that are neither letters, digits, white space nor the apostrophe.
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the other bytes in order from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_SIGNS = {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPACE_SIGN = _BYTE_SIGNS[0x20]
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of some runs, one run after the other."""
    upto = np.cumsum(sizes, dtype=np.int32)
    at = np.arange(int(upto[-1]) if len(upto) else 0, dtype=np.int32)
    at += np.repeat(starts - (upto - sizes), sizes)
    return at


class ChunkEncoder:
    """The tokenizers library over texts cut at places where its pre-tokenizer always cuts.

    The byte-level pre-tokenizer starts a new piece at a single space, and before and after a single line end, between two
    characters that are not white space, and where a letter meets a sign other than an apostrophe. No merge crosses pieces, so
    the ids of a text are those of its chunks in a row. Each distinct chunk is encoded once and
    remembered, which saves most of the work; when too many are remembered, the less used half is forgotten. Only files with this pre-tokenizer may be cut so; others are encoded whole.

    literal: the strings of special tokens inside a text are ordinary text. Otherwise they give the tokens' ids, as the library has
    it unless told so. A text that holds the string of an added token is not cut then but encoded whole.
    """

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = literal
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.whole = [t["content"] for t in spec.get("added_tokens") or () if t["content"] and not (literal and t.get("special"))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.starts, self.uses, self.ids, self.filled = *(np.zeros(1 << 16, np.int32) for _ in range(3)), np.zeros(1 << 18, np.int32), 0

    def forget_half(self) -> None:
        """Keeps half of REMEMBERED chunks, those that most slices held (the older of equals); their uses count half from now on."""
        names, uses = list(self.known), self.uses[: len(self.known)]
        keep = np.sort(np.argsort(-uses, kind="stable")[: max(1, REMEMBERED // 2)])
        sizes, uses = self.sizes[keep], uses[keep] // 2
        flat = self.ids[_spread(self.starts[keep], sizes)]
        self.forget()
        self._store([names[i] for i in keep.tolist()], sizes, flat)
        self.uses[: len(keep)] = uses

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's number of ids, and all ids. A chunk of letters, but for a space at its start, is one piece of the
        pre-tokenizer, and goes to the library's model as it is; others take the library's whole way."""
        out, rest, tokenize = [None] * len(chunks), [], self.library.model.tokenize
        for i, c in enumerate(chunks):
            if self.cuts and (c.isalpha() or c[:1] == " " and c[1:].isalpha()):
                out[i] = [t.id for t in tokenize(c.replace(" ", _SPACE_SIGN) if c.isascii() else c.encode().decode("latin-1").translate(_BYTE_SIGNS))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.library.encode_batch([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return np.fromiter(map(len, out), np.int64, len(out)), np.fromiter(chain.from_iterable(out), np.int32)

    def _holding(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The rows whose texts hold an added token's string."""
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        held = np.zeros(len(texts), bool)
        for w in self.whole:
            held |= pc.match_substring(texts, w).to_numpy(zero_copy_only=False)
        return np.flatnonzero(held).tolist()

    def _store(self, chunks: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        first, count = len(self.known), len(chunks)
        while first + count > len(self.sizes):
            self.sizes, self.starts, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts, self.uses))
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.sizes[first : first + count] = sizes
        self.starts[first : first + count] = self.filled + np.cumsum(sizes) - sizes
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)
        self.known.update(zip(chunks, range(first, first + count), strict=True))

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """Where the ids of each of these distinct chunks are remembered; unknown ones are learnt."""
        if len(self.known) > REMEMBERED:
            self.forget_half()
        slot = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int32, len(chunks))
        new = np.flatnonzero(slot < 0)
        slot[new] = np.arange(len(self.known), len(self.known) + len(new))
        for at in range(0, len(new), 20_000):
            part = [chunks[i] for i in new[at : at + 20_000].tolist()]
            self._store(part, *self._ids(part))
        self.uses[slot] += 1
        return slot

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows in a row, each row's followed by end; and each row's number of ids."""
        data, offsets = string_buffers(column)
        rows = len(offsets) - 1
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 2:
            solid = (data > 0x20) & (data != 0x7F)
            lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # the first bytes of all white space beyond ASCII
            tail = np.zeros(len(data), bool)  # a byte of a character that may be such white space
            tail[1:] |= lead[:-1]
            tail[2:] |= lead[:-2]
            before, after = solid & ~((data >= 0x80) & tail), solid & ~lead  # surely no white space ends, or begins, here
            alone = before[:-2] & after[2:]
            cut[1:-2] = (data[1:-1] == 0x20) & alone  # before a single space
            cut[2:-1] |= (data[1:-1] == 0x0A) & alone  # after and before a single line end
            cut[1:-2] |= (data[1:-1] == 0x0A) & alone
            cut[1:-1] |= _LETTER[data[:-1]] & _SIGN[data[1:]]  # between a letter and a sign
        if self.whole and len(data):
            for row in self._holding(data, offsets):
                cut[offsets[row] : offsets[row + 1]] = False
        cut[offsets[:-1]] = True
        begins = np.flatnonzero(cut[: len(data)])
        bounds = np.append(begins, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        slot = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        first = np.searchsorted(begins, offsets)  # of each row, in chunks
        last = first[1:] + np.arange(rows)  # of each row's end id, once those stand among the chunks
        sizes, starts = np.insert(self.sizes[slot], first[1:], 1), np.insert(self.starts[slot], first[1:], 0)
        upto = np.cumsum(sizes, dtype=np.int32)
        out = self.ids[_spread(starts, sizes)]
        ends = upto[last]
        out[ends - 1] = end
        return out, np.diff(ends, prepend=0).astype(np.int64)


@lru_cache(2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path, literal=False)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> None:
    """Encodes docs as the library does by default and writes them to the folder out in ascending order of id_col (nulls first): part after part, row after row.

    A file has a row per document: doc_id, part (range of ids, ascending), start_in_part (ids of the part before it), n_tokens
    (with the end id) and ids, a list column with dictionary encoding (ids have few distinct values), in row groups and pages
    of set sizes with page indexes, so a reader of some doc_ids or of the other columns skips the pages of ids it doesn't need.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, part, start = chunk_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", 3 << 19):
                ids, n = enc.encode(rows.column("text"), end)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(n), part), pa.int32()), pa.array(start + ends - n), pa.array(n), lists], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                start += int(ends[-1])

    bounded_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(tidy(run), SCHEMA).write.option("compression", "zstd").option("parquet.enable.dictionary", "true").option("parquet.block.size", ROW_GROUP)
     .option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(out))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The rows that write_tokens wrote, with start: the number of ids of all documents before, in ascending order of doc_id.

    The offsets of the parts come from the metadata columns alone; there is one number per part.
    """
    rows = spark.read.schema(SCHEMA).parquet(out)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")), "parts")
    return rows.join(maybe_broadcast(parts), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before", "start_in_part")


def select_tokens(spark: SparkSession, out: str, first: int, last: int) -> DataFrame:
    """The written rows with first <= doc_id <= last; row groups and pages outside are skipped by their statistics."""
    return spark.read.schema(SCHEMA).parquet(out).where(F.col("doc_id").between(first, last))


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: the crc32 of the row's ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """Writes docs as token files in the shared folder, reads them back and digests them: a row per row of docs.

    Null texts count as empty (one id, the end). Rows with a null id come first; repeated rows and ids are kept, ordered by text. Very long
    texts are encoded whole, cut only where the tokenizer always cuts. An empty table gives an empty table. Other columns are not read.
    """
    out = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, out, id_col, text_col, end)
    return token_digests(read_tokens(docs.sparkSession, out)).withColumnRenamed("doc_id", id_col)
