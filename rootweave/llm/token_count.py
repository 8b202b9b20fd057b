"""Token counts by a map-side two-tier lookup.

First tier: a hash table of the most frequent pre-tokens' lengths in tokens, of a fixed number of
entries (twenty bytes each), built from all documents and broadcast. Second tier: pre-tokens that it
lacks are looked up in the worker's cache and, failing that, encoded with tiktoken. Pre-tokens never
shuffle: to build the table each task counts its own and hands on one packed row with its most
frequent, and these rows are merged in a tree of packed rows of the same bounded size. The table
only makes counting faster; counts are exact whatever it holds.

Pre-tokens are found and hashed by array operations on whole blocks (textkit); only misses become
Python strings, and they are told apart by their characters. The broadcast table holds no text: an entry
answers for a pre-token whose 64-bit hash and 64-bit check sum of characters both agree with it.

Cases. A null text has a null count, an empty one 0. Special-token strings are ordinary text. Texts
are counted whole. Null ids and repeated rows are counted like others. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm import textkit as tk
from rootweave.llm.common import batched, cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FREQUENT = 65_536
CACHE = 500_000
FAN_IN = 16
#: Longer pre-tokens are not cached, which bounds the cache's memory.
LONG_WORD = 256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PACKED = np.dtype([("hash", "<u8"), ("check", "<u8"), ("count", "<i8"), ("size", "<i4")])


@cache
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("rootweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def checks(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of each span, made otherwise than the first: the sum of its mixed code points."""
    upto = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(tk.mix(cp.astype(np.uint64), 9), out=upto[1:])
    return upto[end] - upto[begin]


class Table:
    """A compact open-addressing hash table: hash and check to length, probed for whole arrays at once."""

    def __init__(self, hashes: np.ndarray, check: np.ndarray, sizes: np.ndarray) -> None:
        self.bits = max(1, (4 * len(hashes)).bit_length())
        self._hash, self._check, self._size = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        left = np.arange(len(hashes))
        while len(left):  # each round puts one entry in each free place that some of the rest hash to
            place = self._place(hashes[left], self.probes)
            free = np.flatnonzero(self._size[place] < 0)
            _, one = np.unique(place[free], return_index=True)
            put = free[one]
            self._hash[place[put]], self._check[place[put]], self._size[place[put]] = hashes[left[put]], check[left[put]], sizes[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def _place(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return ((hashes >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def sizes(self, hashes: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The length of each, -1 for those the table lacks."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for probe in range(self.probes):
            place = self._place(hashes[left], probe)
            found = (self._size[place] >= 0) & (self._hash[place] == hashes[left]) & (self._check[place] == check[left])
            out[left[found]] = self._size[place[found]]
            left = left[~found & (self._size[place] >= 0)]
            if not len(left):
                break
        return out


class Counter:
    """Lengths of pre-tokens: the table of frequent ones, then a bounded cache by text, then the encoder."""

    def __init__(self, vocabulary: str, table: Table | None = None, most: int = CACHE) -> None:
        self._encode, self._table, self._most = encoding(vocabulary).encode_ordinary, table, most
        self._cache: dict[str, int] = {}

    def sizes(self, cp: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: str, hashes: np.ndarray | None = None) -> np.ndarray:
        """The number of tokens of each pre-token whole[begin:end]."""
        hashes = tk.span_hashes(cp, begin, end) if hashes is None else hashes
        out = self._table.sizes(hashes, checks(cp, begin, end)) if self._table else np.full(len(begin), -1, np.int64)
        where = np.flatnonzero(out < 0)
        if len(where):
            first, which = tk.distinct_spans(cp, begin[where], end[where], hashes[where])
            if len(self._cache) + len(first) > self._most:
                self._cache.clear()
            found = np.empty(len(first), np.int64)
            cached, encode = self._cache, self._encode
            for k, (b, e) in enumerate(zip(begin[where[first]].tolist(), end[where[first]].tolist())):
                word = whole[b:e]
                n = cached.get(word)
                if n is None:
                    n = len(encode(word))
                    if e - b <= LONG_WORD:
                        cached[word] = n
                found[k] = n
            out[where] = found[which]
        return out


def merged(parts: list[np.ndarray], keep: int) -> np.ndarray:
    """Packed summaries added up, cut to the entries of the highest count (least hash first among equals)."""
    all_ = np.concatenate(parts)
    all_ = all_[np.lexsort((all_["check"], all_["hash"]))]
    first = np.flatnonzero(np.append(True, (all_["hash"][1:] != all_["hash"][:-1]) | (all_["check"][1:] != all_["check"][:-1]))) if len(all_) else np.zeros(0, np.int64)
    out = all_[first].copy()
    out["count"] = np.add.reduceat(all_["count"], first) if len(first) else 0
    return out[np.lexsort((out["check"], out["hash"], -out["count"]))[:keep]]


def frequent_table(docs: DataFrame, vocabulary: str = VOCABULARY, entries: int = FREQUENT, text_col: str = "text") -> np.ndarray:
    """Hashes, check sums and token lengths of about the `entries` most frequent pre-tokens of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = np.zeros(0, _PACKED), Counter(vocabulary)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in tk.blocks(texts):
                cp, bounds, whole = tk.code_points(texts[lo:hi])
                begin, end = tk.pretokens(cp, bounds)
                # Counts only choose entries, so spans needn't be told apart here: an entry answers for its own check sum alone.
                hashes, first, counts = np.unique(tk.span_hashes(cp, begin, end), return_index=True, return_counts=True)
                top = np.lexsort((hashes, -counts))[:entries]
                top = top[counts[top] > 1]
                at = first[top]
                part = np.empty(len(top), _PACKED)
                part["hash"], part["count"], part["check"] = hashes[top], counts[top], checks(cp, begin[at], end[at])
                part["size"] = known.sizes(cp, begin[at], end[at], whole, hashes[top])
                seen = merged([seen, part], 4 * entries)
        seen = seen[:entries]
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array([int(seen["hash"][0] >> np.uint64(1))], pa.int64()), pa.array([seen.tobytes()], pa.binary())], names=["at", "packed"])

    def join(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "packed": [merged([np.frombuffer(p, _PACKED) for p in pdf["packed"]], entries).tobytes()]})

    level = cut(batched(docs).select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(count, "at long, packed binary"))
    while (n := level.count()) > 1:
        level = cut(level.groupBy(F.pmod(F.xxhash64("packed"), F.lit(-(-n // FAN_IN))).alias("g")).applyInPandas(join, "at long, packed binary"))
    row = level.first()
    return np.zeros(0, _PACKED) if row is None else np.frombuffer(row["packed"], _PACKED)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, entries: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document. With no entries, only the worker caches count, in one pass."""
    best = frequent_table(docs, vocabulary, entries, text_col) if entries else np.zeros(0, _PACKED)
    shared = docs.sparkSession.sparkContext.broadcast((best["hash"].copy(), best["check"].copy(), best["size"].copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, Table(*shared.value) if len(shared.value[0]) else None)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.zeros(len(texts), np.int64)
            for lo, hi in tk.blocks(texts):
                cp, bounds, whole = tk.code_points(texts[lo:hi])
                begin, end = tk.pretokens(cp, bounds)
                total = tk.offsets_of(counter.sizes(cp, begin, end, whole))
                out[lo:hi] = np.diff(total[np.searchsorted(begin, bounds)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=np.array([t is None for t in texts], bool))], names=["doc_id", "n_tokens"])

    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return batched(body).mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, n_tokens long")
