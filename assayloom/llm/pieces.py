"""Operator 1: SentencePiece segmentations sampled by forward filtering and backward sampling, and lossless decoding."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .store import bounded_batches
from .text import mix, slices, string_buffers, tidy

#: Lattice edges that a task keeps from slice to slice (about 15 bytes each, and its chunks' texts) before it forgets them all; bytes
#: of text in a slice. A slice's own edges and samples take about 100 bytes for each byte of text while it is worked on.
REMEMBERED, SLICE = 500_000, 1 << 19
#: U+2581 stands for a space in pieces; a literal one in a text gets a number beyond Unicode and so no piece but its bytes.
SPACE, LITERAL = 0x2581, 0x110000
_PRIME = np.uint64(0x9E3779B185EBCA87)


def _seeds(ids: np.ndarray, seed: int) -> np.ndarray:
    return mix(ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


def _uniform(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Grown:
    """Arrays that grow by doubling."""

    def __init__(self, **kinds):
        self.n, self.kinds = 0, kinds
        for k, t in kinds.items():
            setattr(self, k, np.zeros(1 << 12, t))

    def add(self, **parts) -> None:
        count = len(next(iter(parts.values())))
        for k, v in parts.items():
            old = getattr(self, k)
            if self.n + count > len(old):
                new = np.zeros(max(2 * len(old), self.n + count), old.dtype)
                new[: self.n] = old[: self.n]
                setattr(self, k, old := new)
            old[self.n : self.n + count] = v
        self.n += count


class Sampler:
    """Samples segmentations of texts over the lattice of a model's pieces, from p(segmentation) ~ product of piece weights ^ alpha.

    A unigram model's scores are its log weights. A merge model has ranks instead of weights; a piece of rank r then weighs
    1 / (r + 2), the usual rank-frequency law. Where two neighbouring characters stand together in no piece, every segmentation
    passes between them (so before a run of spaces, around a line end): the lattice falls into chunks there, and each distinct
    chunk's forward sums are computed once (in log space, all chunks of a batch at once, place by place) and remembered. Backward sampling then draws, for all chunks of
    a batch at once, one incoming edge at a time by its probability given the place; the random numbers are hashes of the row's
    key, the chunk's number in its text and the place, so a row's sample depends on nothing else. Characters without a piece take
    their UTF-8 bytes' pieces.
    """

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        plain = [i for i in range(self.size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        names = {i: m.id_to_piece(i) for i in plain}
        scores = np.array([m.get_score(i) for i in plain])
        logs = -np.log(2 - scores) if (scores <= 0).all() and (scores == np.round(scores)).all() else scores
        self.byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_log = alpha * float(min(logs.min(), -np.log(self.size)))
        self.longest = max(map(len, names.values()))
        self.tables = []
        for n in range(1, self.longest + 1):
            of = [(k, i) for k, i in enumerate(plain) if len(names[i]) == n and SPACE not in map(ord, names[i].lstrip(chr(SPACE)))]
            code = np.array([[ord(c) for c in names[i]] for _, i in of], np.uint64).reshape(len(of), n)
            h = np.zeros(len(of), np.uint64)
            for c in range(n):
                h = h * _PRIME + code[:, c] + np.uint64(1)
            h = mix(h)
            order = np.argsort(h)
            mask = np.zeros(1 << 18, bool)
            mask[(h >> np.uint64(46)).astype(np.int64)] = True
            self.tables.append((h[order], np.array([i for _, i in of], np.int32)[order], alpha * logs[[k for k, _ in of]][order], mask))
        # pairs of bytes between which a piece may run on; beyond ASCII only a space after another character is known to be a cut
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for i in plain:
            ascii_name = names[i].replace(chr(SPACE), " ")
            for a, b in zip(ascii_name, ascii_name[1:], strict=False):
                if a < "\x80" and b < "\x80":
                    self.joined[ord(a), ord(b)] = True
        self.joined[:, 0x20] = False
        self.joined[0x20, 0x20] = True
        raw = [b""] * self.size
        for i in plain:
            raw[i] = names[i].replace(chr(SPACE), " ").encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_size)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chunks = _Grown(base=np.int32, last=np.int32)
        self.edges = _Grown(upto=np.float32, back=np.uint8, emit=np.int32)  # upto: running probability among a node's edges
        self.nodes = _Grown(edge=np.int32)  # each node's first edge
        self.spelled: dict[int, int] = {}  # characters by bytes: numbers from self.size on
        self.emitted: list[np.ndarray] = []

    def _learn(self, texts: list[str]) -> None:
        if not texts:
            return
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        code[code == SPACE] = LITERAL
        code[code == 32] = SPACE
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        chunk = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(begin + sizes, sizes) - np.arange(len(code))  # characters from here to the chunk's end
        node = np.arange(len(code)) + chunk  # the node before each character; a chunk of n characters has n + 1 nodes
        h, found = np.zeros(len(code), np.uint64), []
        at = np.arange(len(code))
        value = code.astype(np.uint64) + np.uint64(1)
        for n, (keys, ids, logs, mask) in enumerate(self.tables, 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            h[at] = h[at] * _PRIME + value[at + n - 1]
            if len(keys):
                full = mix(h[at])
                maybe = np.flatnonzero(mask[(full >> np.uint64(46)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(keys, full[maybe]), len(keys) - 1)
                hit = keys[slot] == full[maybe]
                where, slot = at[maybe[hit]], slot[hit]
            else:
                where, slot = at[:0], at[:0]
            found.append((node[where] + n, np.full(len(where), n, np.uint8), ids[slot], logs[slot]))
            if n == 1:
                bare = np.ones(len(code), bool)
                bare[where] = False
                bare = np.flatnonzero(bare)
                if len(bare):
                    kinds, which = np.unique(code[bare], return_inverse=True)
                    for c in kinds.tolist():
                        if c not in self.spelled:
                            self.spelled[c] = self.size + len(self.emitted)
                            self.emitted.append(self.byte_ids[np.frombuffer(chr(SPACE if c == LITERAL else c).encode(), np.uint8)])
                    emit = np.array([self.spelled[c] for c in kinds.tolist()], np.int32)[which]
                    count = np.array([len(self.emitted[e - self.size]) for e in emit.tolist()])
                    found.append((node[bare] + 1, np.ones(len(bare), np.uint8), emit, self.byte_log * count))
        end, back, emit, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        end, back, emit, weight = end[order], back[order], emit[order], weight[order]
        first_node = begin + np.arange(len(texts))
        place = end - np.repeat(first_node, sizes + 1)[end]
        forward = np.zeros(len(code) + len(texts))
        turn = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[turn], np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            e = turn[a:b]
            v = forward[end[e] - back[e]] + weight[e]
            heads = np.flatnonzero(np.diff(end[e], prepend=-1))
            top = np.maximum.reduceat(v, heads)
            total = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(heads, len(e))))), heads)
            forward[end[e][heads]] = top + np.log(total)
        share = np.exp(forward[end - back] + weight - forward[end])
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        running = np.cumsum(share)
        within = running - np.repeat(running[heads] - share[heads], np.diff(np.append(heads, len(end))))
        within = np.clip(within, 0.0, 1.0)
        within[np.append(heads[1:], len(end)) - 1] = 1.0
        first, node = len(self.known), self.nodes.n
        self.nodes.add(edge=self.edges.n + np.searchsorted(end, np.arange(len(code) + len(texts))))
        self.edges.add(upto=within, back=back, emit=emit)
        self.chunks.add(base=node + first_node, last=node + first_node + sizes)
        self.known.update(zip(texts, range(first, first + len(texts)), strict=True))

    def sample(self, column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows in a row, and each row's number of ids; keys: a 64-bit seed for each row. Null and empty texts have none."""
        data, offsets = string_buffers(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        own = np.flatnonzero(np.diff(offsets))  # rows with text
        data, offsets = np.insert(data, offsets[own], 0x20), np.append(offsets[own] + np.arange(len(own)), len(data) + len(own))
        cut = np.append(True, ~self.joined[data[:-1], data[1:]])
        cut[offsets[:-1]] = True
        begins = np.flatnonzero(cut)
        bounds = np.append(begins, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        texts = coded.dictionary.to_pylist()
        if self.edges.n > REMEMBERED:
            self.forget()
        self._learn([t for t in texts if t not in self.known])
        slot = np.fromiter((self.known[t] for t in texts), np.int64, len(texts))[coded.indices.to_numpy()]
        first = np.searchsorted(begins, offsets)
        row = np.repeat(np.arange(len(own)), np.diff(first))
        seed = keys[own][row] + (np.arange(len(slot)) - first[row]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        base, now, count, steps = self.chunks.base[slot], self.chunks.last[slot], np.zeros(len(slot), np.int64), []
        upto, back, emit, edges = self.edges.upto, self.edges.back, self.edges.emit, self.nodes.edge
        live = np.arange(len(slot))
        seed = mix(seed)
        while len(live):
            here = now[live]
            u, edge = _uniform(seed[live] + (here - base[live]).astype(np.uint64)), edges[here]
            more = np.flatnonzero(upto[edge] <= u)
            while len(more):  # a node's last edge reaches 1, so none runs on to the next node
                edge[more] += 1
                more = more[upto[edge[more]] <= u[more]]
            steps.append((live, emit[edge]))
            count[live] += 1
            here = here - back[edge]
            now[live] = here
            live = live[here > base[live]]
        ends = np.cumsum(count)
        ids = np.zeros(int(ends[-1]), np.int32)
        for k, (who, what) in enumerate(steps, 1):
            ids[ends[who] - k] = what
        n = ends[first[1:] - 1] - np.concatenate([[0], ends[first[1:-1] - 1]])
        if len(ids) and int(ids.max()) >= self.size:  # spell out characters without a piece
            lengths = np.ones(len(ids), np.int64)
            odd = np.flatnonzero(ids >= self.size)
            parts = [self.emitted[e - self.size] for e in ids[odd].tolist()]
            lengths[odd] = [len(p) for p in parts]
            ends = np.cumsum(lengths)
            n = np.diff(np.concatenate([[0], ends[np.cumsum(n) - 1]]))
            out = np.repeat(ids, lengths)
            spot = np.repeat(ends[odd] - lengths[odd], lengths[odd]) + np.concatenate([np.arange(len(p)) for p in parts])
            out[spot] = np.concatenate(parts)
            ids = out
        counts = np.zeros(rows, np.int64)
        counts[own] = n
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows' texts in a row, and each row's start and the last end in them."""
        sizes = self.raw_size[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        data = self.raw[np.arange(int(upto[-1])) + np.repeat(self.raw_start[ids] - upto[:-1], sizes)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = upto[ends]
        own = np.flatnonzero(counts)
        data = np.delete(data, offsets[own])  # the space that every text begins with
        return data, offsets - np.concatenate([[0], np.cumsum(counts > 0)])


@lru_cache(2)
def sampler(path: str, alpha: float = 1.0) -> Sampler:
    return Sampler(path, alpha)


def _keys(column: pa.Array, seed: int) -> np.ndarray:
    return _seeds(column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False), seed)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", name: str = "pieces", alpha: float = 1.0, seed: int = 41, without: tuple[str, ...] = ()) -> DataFrame:
    """docs (less the columns in without) with a column of sampled piece ids (array<int>), reproducible from id and text: reruns and other partitionings agree.

    Null texts get null, empty ones an empty list; null ids share one seed. Rows that repeat get equal samples. Texts are read
    whole, whatever their length. One narrow pass, no shuffle. name must not be a column of docs.
    """
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    stay = [i for i, c in enumerate(docs.columns) if c not in without]
    bounded_batches(docs.sparkSession)

    def run(batches):
        s = sampler(model_path, alpha)
        for batch in batches:
            for part in slices(batch, batch.schema.names[text_at], SLICE):
                ids, n = s.sample(part.column(text_at), _keys(part.column(id_at), seed))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids), mask=part.column(text_at).is_null())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), lists], [*(batch.schema.names[i] for i in stay), name])
        s.forget()

    return docs.mapInArrow(tidy(run), StructType(docs.drop(*without).schema.fields.copy()).add(name, ArrayType(IntegerType())))


def decode(rows: DataFrame, model_path: str, pieces_col: str = "pieces", name: str = "decoded") -> DataFrame:
    """rows with the text of their piece ids: the very text that was encoded. Null lists get null, empty ones an empty text."""
    at = rows.columns.index(pieces_col)

    def run(batches):
        s = sampler(model_path)
        for batch in batches:
            lists = batch.column(at)
            if lists.null_count:
                lists = pa.array([x if x is not None else [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            offsets = lists.offsets.to_numpy()
            data, ends = s.decode(lists.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets))
            text = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
            text = pa.compute.if_else(batch.column(at).is_valid(), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, name])

    return rows.mapInArrow(tidy(run), StructType(rows.schema.fields.copy()).add(name, "string"))


def sampled_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 41) -> DataFrame:
    """One row per row of docs: id_col, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and lossless: the ids, decoded, are the text.

    Encodes and decodes in one pass, so that the ids stay in the worker. Null texts count as empty: no pieces, lossless.
    """

    def run(batches):
        s = sampler(model_path, alpha)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, n = s.sample(part.column("text"), _keys(part.column("id"), seed))
                data, offsets = s.decode(ids, n)
                want, marks = string_buffers(part.column("text"))
                raw, ends = ids.astype("<i4"), np.cumsum(n)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                if np.array_equal(offsets, marks) and np.array_equal(data, want):
                    good = np.ones(len(n), bool)
                else:
                    good = np.array([data[a:b].tobytes() == want[c:d].tobytes() for a, b, c, d in zip(offsets[:-1], offsets[1:], marks[:-1], marks[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(good)], ["id", "n_pieces", "ids_crc32", "lossless"])
        s.forget()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "id long, n_pieces long, ids_crc32 long, lossless boolean").withColumnRenamed("id", id_col)
