"""Token-id output as one wavelet matrix per shard.

A task encodes its documents (merge replay) and closes a shard at about `shard_tokens` tokens. The
shard's blob is self-contained: one bit-plane per bit of the largest id, from the highest, each
stably partitioned by the plane before it. Planes are cut in blocks of 32,768 bits, compressed
where that is smaller, with a directory of byte offsets and of ones before each block; so access,
rank, select, counting and occurrence lookup decompress only the blocks they touch. write_files() makes
each blob one file; a WaveletFile reads its directory and then only the touched blocks' bytes. No shuffle.

Cases. Ids may be of any type. A null text is kept as a document without tokens, like an empty one. Null ids and repeated
rows are kept as they are. A document is never cut: one of more than shard_tokens tokens is a shard
of its own. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm import bpe_replay as bpe
from rootweave.llm import textkit as tk
from rootweave.llm.common import batched, stored

SHARD_TOKENS = 4_000_000
BLOCK_BITS = 1 << 15
#: Values that are parted at once.
STRETCH = 1 << 16
MAGIC = b"RWWM1\n"


def parted(values: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """The values without the bit (`zeros` of them), then those with it, in stretches that stay in the processor's cache."""
    out = np.empty_like(values)
    at = [0, zeros]
    for lo in range(0, len(values), STRETCH):
        some, one = values[lo : lo + STRETCH], bit[lo : lo + STRETCH]
        for k, place in enumerate((np.flatnonzero(~one), np.flatnonzero(one))):
            some.take(place, out=out[at[k] : at[k] + len(place)], mode="clip")  # other modes buffer the output
            at[k] += len(place)
    return out


def build(tokens: np.ndarray) -> bytes:
    """The wavelet matrix of non-negative token ids as a blob."""
    n = len(tokens)
    planes = max(1, int(tokens.max()).bit_length()) if n else 1
    per_plane = -(-n // BLOCK_BITS)
    zeros, body, where, ones = [], [], [], []
    at = 0
    rest = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    for level in range(planes):
        bit = (rest & rest.dtype.type(1 << (planes - 1 - level))) != 0
        packed = np.packbits(bit)
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        ones.append(np.cumsum(counts) - counts)
        for k in range(per_plane):
            raw = packed[k * BLOCK_BITS // 8 : (k + 1) * BLOCK_BITS // 8].tobytes()
            small = zlib.compress(raw, 1)
            where.append(at << 1 | (len(small) < len(raw)))
            body.append(small if len(small) < len(raw) else raw)
            at += len(body[-1])
        zeros.append(int(n - counts.sum()))
        if level + 1 < planes:
            rest = parted(rest, bit, zeros[-1])
    where.append(at << 1)
    head = json.dumps({"n": n, "planes": planes, "zeros": zeros}).encode()
    directory = np.array(where, "<u8").tobytes() + (np.concatenate(ones).astype("<u4").tobytes() if n else b"")
    return MAGIC + struct.pack("<I", len(head)) + head + directory + b"".join(body)


class WaveletMatrix:
    """Reads a blob of build(): its directory at once, its blocks as they are touched."""

    def __init__(self, blob: bytes) -> None:
        self._read_directory(lambda at, n: blob[at : at + n])

    def _read_directory(self, read: Callable[[int, int], bytes]) -> None:
        """read(at, n) gives n bytes of the matrix from the place on."""
        start = read(0, len(MAGIC) + 4)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (size,) = struct.unpack_from("<I", start, len(MAGIC))
        at = len(MAGIC) + 4
        head = json.loads(read(at, size))
        self.n, self.planes, self.zeros = head["n"], head["planes"], head["zeros"]
        self._per = -(-self.n // BLOCK_BITS)
        at += size
        blocks = self._per * self.planes
        self._where = np.frombuffer(read(at, 8 * (blocks + 1)), "<u8")
        at += 8 * (blocks + 1)
        self._ones = np.frombuffer(read(at, 4 * blocks), "<u4")
        self._body, self._read = at + 4 * blocks, read
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return self.n

    def _block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits in words of 64, and the ones before each word."""
        if k not in self._open:
            if len(self._open) >= 4 * self.planes:
                self._open.pop(next(iter(self._open)))
            lo, hi = int(self._where[k]), int(self._where[k + 1])
            raw = self._read(self._body + (lo >> 1), (hi >> 1) - (lo >> 1))
            raw = zlib.decompress(raw) if lo & 1 else raw
            words = np.frombuffer(raw + bytes(-len(raw) % 8), ">u8").astype(np.uint64)
            self._open[k] = words, tk.offsets_of(np.bitwise_count(words).astype(np.int64))
        return self._open[k]

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self._block(k)[0].astype(">u8").view(np.uint8))

    def _ones_before(self, level: int, i: int) -> int:
        if i >= self.n:
            return self.n - self.zeros[level]
        k = level * self._per + i // BLOCK_BITS
        word, bit = divmod(i % BLOCK_BITS, 64)
        words, ones = self._block(k)
        return int(self._ones[k]) + int(ones[word]) + (int(words[word]) >> (64 - bit)).bit_count()

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.planes):
            word, bit = divmod(i % BLOCK_BITS, 64)
            one = int(self._block(level * self._per + i // BLOCK_BITS)[0][word]) >> (63 - bit) & 1
            out = out << 1 | one
            before = self._ones_before(level, i)
            i = self.zeros[level] + before if one else i - before
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before position i lie below the last plane."""
        lo, hi = 0, min(max(i, 0), self.n)
        if token < 0 or token >> self.planes:
            return 0, 0
        for level in range(self.planes):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            if token >> (self.planes - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs before position i."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bits(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """The positions of a plane's (k + 1)th ones or zeros (k rising): a search of the directory, then of the blocks they are in."""
        first = level * self._per
        ones = self._ones[first : first + self._per].astype(np.int64)
        before = ones if one else np.arange(self._per, dtype=np.int64) * BLOCK_BITS - ones
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        edge = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(k)]):
            b = int(block[lo])
            bits = self._bits(first + b)[: min(BLOCK_BITS, self.n - b * BLOCK_BITS)]
            out[lo:hi] = b * BLOCK_BITS + np.flatnonzero(bits == one)[k[lo:hi] - before[b]]
        return out

    def selects(self, token: int, k: np.ndarray) -> np.ndarray:
        """The positions of the token's (k + 1)th occurrences, k rising."""
        lo, hi = self._range(token, self.n)
        if not len(k):
            return np.zeros(0, np.int64)
        if k[0] < 0 or k[-1] >= hi - lo:
            raise IndexError(int(k[0]), int(k[-1]))
        at = lo + k
        for level in range(self.planes - 1, -1, -1):
            one = bool(token >> (self.planes - 1 - level) & 1)
            at = self._select_bits(level, one, at - self.zeros[level] if one else at)
        return at

    def select(self, token: int, k: int) -> int:
        """The position of the token's (k + 1)th occurrence."""
        return int(self.selects(token, np.array([k]))[0])

    def positions(self, token: int) -> list[int]:
        return self.selects(token, np.arange(self.count(token))).tolist()


class WaveletFile(WaveletMatrix):
    """A matrix in a file of write_files(): only its directory and the touched blocks are read. Close it, or use it in a with statement."""

    def __init__(self, path: str) -> None:
        fs, name = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self._file = fs.open_input_file(name)

        def read(at: int, n: int) -> bytes:
            self._file.seek(at)
            return self._file.read(n)

        self._read_directory(read)

    def __enter__(self) -> WaveletFile:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()


def shards(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, doc_ids, doc_begins, n_tokens, blob): doc_begins has one bound more than documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, made = bpe.merges(vocabulary), TaskContext.get(), 0
        memo = bpe.Words(m)
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal made, held
            flat, own, begins = np.concatenate(tokens), pa.concat_arrays(ids), tk.offsets_of(np.concatenate(sizes))
            of = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            name = f"{task.partitionId() if task else 0:08d}-{made:05d}"
            row = pa.RecordBatch.from_arrays([pa.array([name]), of(own), of(pa.array(begins)), pa.array([len(flat)], pa.int64()), pa.array([build(flat)], pa.binary())], names=["shard", "doc_ids", "doc_begins", "n_tokens", "blob"])
            made, held = made + 1, 0
            for x in (ids, tokens, sizes):
                x.clear()
            return row

        for batch in batches:
            own, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in tk.blocks(texts, 4 * tk.BLOCK_CHARS):
                t, at = bpe.encode(m, texts[lo:hi], memo)
                if held and held + len(t) > shard_tokens:
                    yield out()
                ids.append(own.slice(lo, hi - lo))
                tokens.append(t.astype(np.uint32))
                sizes.append(np.diff(at))
                held += len(t)
        if ids:
            yield out()

    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return batched(body).mapInArrow(run, f"shard string, doc_ids array<{body.schema['doc_id'].dataType.simpleString()}>, doc_begins array<long>, n_tokens long, blob binary")


def write_files(matrices: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's blob as folder/shard.wm, a folder (path or URI) that all executors share; gives (shard, doc_ids, doc_begins, n_tokens, path).

    A task writes to a name of its own and renames, so a repeated attempt leaves whole files. The rows are stored before
    they are given, and reading them again writes nothing.
    """
    shape = matrices.select("shard", "doc_ids", "doc_begins", "n_tokens", F.lit("").alias("path")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                own = f"{base}/.{shard}-{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write(blob)
                fs.move(own, f"{base}/{shard}.wm")
                paths.append(f"{folder.rstrip('/')}/{shard}.wm")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_ids", "doc_begins", "n_tokens")), pa.array(paths, pa.string())], names=shape.names)

    return stored(matrices.mapInArrow(run, shape))


def occurrences(matrices: DataFrame, tokens: list[int]) -> DataFrame:
    """(token_id, doc_id, position): every occurrence of the tokens; position counts within the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, begins = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy()
                w = WaveletMatrix(batch.column(2)[k].as_py())
                for token in tokens:
                    at = w.selects(token, np.arange(w.count(token)))
                    doc = np.searchsorted(begins, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), ids.take(pa.array(doc)), pa.array(at - begins[doc])], names=["token_id", "doc_id", "position"])

    kind = matrices.schema["doc_ids"].dataType.elementType.simpleString()
    return matrices.select("doc_ids", "doc_begins", "blob").mapInArrow(run, f"token_id long, doc_id {kind}, position long")


def token_totals(matrices: DataFrame, tokens: list[int]) -> DataFrame:
    """(token_id, n): how often each token occurs, by rank alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for blob in pdf["blob"]:
                w = WaveletMatrix(blob)
                yield pd.DataFrame({"token_id": tokens, "n": [w.count(t) for t in tokens]}).astype("int64")

    return matrices.select("blob").mapInPandas(run, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
