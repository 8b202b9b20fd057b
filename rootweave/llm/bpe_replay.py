"""Byte-level BPE by corpus-level merge replay, and decoding.

A task reads its documents in blocks, cuts them into pre-tokens, and replays the vocabulary's merges
once over the distinct pre-tokens that the task hasn't met before: an inverted index holds, for each token
pair that has a merge, the word positions where it stands; merges are applied in rank order to all their
positions at once, and only the touched neighbours' pairs enter the index anew. Documents then gather the
tokens of their pre-tokens. The corpus of one replay is thus a task's part: to replay each pre-token of the whole
corpus once, every occurrence would have to be shuffled to its tokens. Nothing shuffles here, and memory is
bounded by a block and `MEMO` remembered pre-tokens. Pre-tokens are told apart by their characters, not by hash alone.

Vocabulary: a `tokenizers` JSON file of a byte-level BPE (path is a parameter; nothing is trained).

Cases. A null text gives null tokens, count and round trip; an empty text gives no tokens and a true
round trip. Any Unicode text is encoded whole, however long. Repeated rows are encoded alike. A null
id is passed through. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm import textkit as tk
from rootweave.llm.common import batched

#: Pre-tokens that a task remembers with their tokens; beyond that it begins anew.
MEMO = 400_000
#: The place of the public vocabularies; another path can be given to each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Merge ranks by pair of ids, the ids of single bytes, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = self.left << 20 | self.right
        self._order = np.argsort(key, kind="stable")
        self._keys = key[self._order]
        self.none = len(key)
        self._of_bytes: np.ndarray | None = None
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        spelled = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        most = max(spelled) + 1
        parts = [spelled.get(i, b"") for i in range(most)]
        self.offset = tk.offsets_of(np.array([len(p) for p in parts]))
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or `none`."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self._keys, key), self.none - 1)
        return np.where(self._keys[at] == key, self._order[at], self.none)

    def byte_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As rank(), of pairs of bytes: from a table of all of them."""
        if self._of_bytes is None:
            self._of_bytes = self.rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))
        return self._of_bytes[a.astype(np.int64) << 8 | b]


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def replay(m: Merges, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the words data[bounds[i]:bounds[i + 1]] (bytes, none empty), and each word's bounds in them."""
    n = len(data)
    sym = m.byte_id[data]
    after = np.arange(1, n + 1)
    after[bounds[1:] - 1] = -1
    before = np.arange(-1, n - 1)
    before[bounds[:-1]] = -1
    at = np.flatnonzero(after >= 0)
    rank = m.byte_rank(data[at], data[at + 1])
    at, rank = at[rank < m.none], rank[rank < m.none]
    merged = np.zeros(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        stop = np.append(first[1:], len(rank))
        for r, f, s in zip(rank[first].tolist(), first.tolist(), stop.tolist()):
            if r in index:
                index[r].append(at[f:s])
            else:
                index[r] = [at[f:s]]
                heapq.heappush(heap, r)

    if len(at):
        enter(at, rank)
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        at = places[0] if len(places) == 1 else np.concatenate(places)
        a, b = m.left[r], m.right[r]
        following = after[at]
        live = (sym[at] == a) & (following >= 0)
        live &= sym[following] == b
        at, following = at[live], following[live]
        if not len(at):
            continue
        if a == b:  # in a run of one token, every other pair from its begin
            order = np.argsort(at)
            at, following = at[order], following[order]
            head = np.append(True, at[1:] != following[:-1])
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at, following = at[since % 2 == 0], following[since % 2 == 0]
        beyond = after[following]
        sym[at] = m.into[r]
        sym[following] = -1
        after[at] = beyond
        open_ = beyond >= 0
        before[beyond[open_]] = at[open_]
        prior = before[at]
        own, prior = at[open_], prior[prior >= 0]
        merged[own] = True  # a merge right before another one touches the same pair
        touched = np.concatenate([prior[~merged[prior]], own])
        merged[own] = False
        if len(touched):
            rank = m.rank(sym[touched], sym[after[touched]])
            some = rank < m.none
            if some.any():
                enter(touched[some], rank[some])
    alive = sym >= 0
    return sym[alive], np.append(0, np.cumsum(alive))[bounds]


class Words:
    """The tokens of pre-tokens: those met before are looked up, the others replayed together."""

    def __init__(self, m: Merges, most: int = MEMO) -> None:
        self._m, self._most = m, most
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[str, int] = {}
        self._ids, self._size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def tokens(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, their bounds by slot, and the slot of each of the distinct pre-tokens."""
        if len(self._slot) > self._most:
            self._forget()
        slot = self._slot
        have = len(slot)
        at = np.array([slot.setdefault(s, len(slot)) for s in spelled], np.int64)
        new = [s.encode("utf-8", "surrogatepass") for s, k in zip(spelled, at.tolist()) if k >= have]
        if new:
            ids, bounds = replay(self._m, np.frombuffer(b"".join(new), np.uint8), tk.offsets_of(np.array([len(s) for s in new])))
            self._ids, self._size = np.append(self._ids, ids.astype(np.int32)), np.append(self._size, np.diff(bounds))
        return self._ids, tk.offsets_of(self._size), at


def encode(m: Merges, texts: list[str | None], memo: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts one after another, and each text's bounds in them. A task's blocks share its memo."""
    cp, bounds, whole = tk.code_points(texts)
    begin, end = tk.pretokens(cp, bounds)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first, word = tk.distinct_spans(cp, begin, end, tk.span_hashes(cp, begin, end))
    spelled = [whole[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist())]
    ids, at, slot = (memo or Words(m)).tokens(spelled)
    word = slot[word]
    size = np.append(0, np.cumsum(np.diff(at)[word]))
    return tk.gather(ids, at, word), size[np.searchsorted(begin, bounds)]


def decode(m: Merges, ids: np.ndarray) -> bytes:
    return tk.gather(m.bytes, m.offset, ids).tobytes()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): the tokens, and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary)
        memo = Words(m)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in tk.blocks(texts, 4 * tk.BLOCK_CHARS):
                part = texts[lo:hi]
                tokens, at = encode(m, part, memo)
                there = np.array([t is not None for t in part], bool)
                whole = decode(m, tokens)
                size = tk.offsets_of((m.offset[tokens + 1] - m.offset[tokens]) if len(tokens) else np.zeros(0, np.int64))[at]
                same = [whole[a:b] == (t or "").encode("utf-8", "surrogatepass") for a, b, t in zip(size[:-1].tolist(), size[1:].tolist(), part)]
                null = pa.array(~there)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens, pa.int32()), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), lists, pa.array(np.diff(at), pa.int64(), mask=~there), pa.array(np.array(same, bool), mask=~there)],
                    names=["doc_id", "token_ids", "n_tokens", "round_trip"],
                )

    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return batched(body).mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, token_ids array<int>, n_tokens long, round_trip boolean")


def decode_documents(tokens: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) of token lists. Null lists give null, empty ones an empty text; ids outside the vocabulary and bytes that aren't UTF-8 raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(vocabulary)
        for batch in batches:
            texts = [None if t is None else decode(m, np.array(t, np.int64)).decode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    body = tokens.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("token_ids"))
    return batched(body).mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, text string")
