"""Near-duplicate documents by SimHash, with pivot distance tables deciding which pairs are verified.

A document's 128-bit fingerprint sums one vote per distinct word (runs of letters and digits,
lower-cased). Equal fingerprints are one node from the start, so thousands of copies cost one row.
Candidates meet in hash tables whose keys are some fingerprint bits each. The bits are cut in parts, and a part's tables
(cover()) are such that whatever few of its bits differ, a table's key has none of them: every pair within the distance
meets, at distance 20 in 381 tables of 16 to 29 bits. Related tables share bits of their keys, and a reduce task
holds a group of tables and one range of the bits they share, of about `shard_rows` fingerprints at any input size. The
fingerprints travel as packed arrays, once for each group: 24 groups where a task holds them all, more of fewer tables as
the ranges become more. A task sorts its fingerprints by each key, verifies the pairs of a bucket by Hamming distance, and passes on
only those that connect what its tables have not connected yet. Buckets of more than ALL_PAIRS fingerprints, which near copies
make, are not paired but linked: each fingerprint that is reached takes its near ones out of
those that are left, so a group of m near copies costs about m tests and gives m - 1 links, which connect
what all its near pairs would connect. There a pivot table (Hamming distances to `pivots` reference fingerprints, by one matrix
product) discards candidates by their largest coordinate difference, pivots taken in a few slices; by the triangle inequality
it never loses a pair within the distance. In small buckets the verification itself is cheaper than the pivots.
Work beside the sorting is the pairs that share a key by chance, about 0.0013 of all pairs: its share grows with the input.
A caller for whom that is too much gives `recall`: tables of as many key bits as the number of fingerprints has (less two), as
many as give a pair at the distance that chance to meet, which loses the rest.
Groups are the connected components of the verified pairs.

Cases. Null texts and texts without a letter or digit have no fingerprint and are never grouped.
Rows without an id are left out of groups() and kept by dedup(). Ids may be of any type that has an order. Rows that
share an id count as one document: they go or stay together. The least id of a group is kept. Texts are read whole.
An empty table gives no rows. Other columns, whatever their names, are ignored by groups() and
passed through by dedup().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm import textkit as tk
from rootweave.llm.common import HOT_ROWS, batched, components, cut, join_counted, shards, stored, without

BITS = 128
DISTANCE = 20
#: The chance that two fingerprints at the distance meet in some table of layout().
RECALL = 0.95
#: Bits of a position's vector in cover(): a part has at most 2 ** VECTOR_BITS - 1 tables.
VECTOR_BITS = 7
#: Draws of a part's vectors, of which the one with the fewest chance meetings is taken.
DRAWS = 400
#: Tables of a task, at most.
GROUP_TABLES = 16
LEAST_BITS, MOST_BITS = 12, 40
PIVOTS = 256
SHARD_ROWS = 400_000
PAIR_BLOCK = 1 << 18
#: Buckets of more fingerprints are linked instead of paired.
ALL_PAIRS = 64
#: Bytes of packed keys that leave a map task in one Arrow batch.
PACK_BYTES = 8 << 20

_LANES = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _LANES[_b] = [(_b >> (7 - k)) & 1 for k in range(8)]
_LANES = np.ascontiguousarray(_LANES).view(np.uint64).ravel()


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n, 2) as int64, and which texts have one.

    Votes are counted eight bit positions at a time, in the byte lanes of a 64-bit word, over runs
    of at most 255 words, and then summed by document.
    """
    out, has = np.zeros((len(texts), 2), np.int64), np.zeros(len(texts), bool)
    for lo, hi in tk.blocks(texts):
        h, doc, _, _ = tk.words(texts[lo:hi])
        if not len(h):
            continue
        # A word is 44 bits of its hash, whatever block it is in; a block has fewer than 2^20 documents.
        key = np.unique((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        doc = (key >> np.uint64(44)).astype(np.int64)
        low = key & np.uint64((1 << 44) - 1)
        votes = np.empty((len(key), 16), np.uint8)
        for k in range(2):
            votes[:, 8 * k : 8 * k + 8] = tk.mix(low, k + 1).astype(">u8").view(np.uint8).reshape(-1, 8)
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        count = np.diff(np.append(first, len(doc)))
        part = np.concatenate([np.arange(f, f + c, 255) for f, c in zip(first, count)]) if (count > 255).any() else first
        total = np.empty((len(part), BITS), np.uint8)
        for k in range(16):
            total[:, 8 * k : 8 * k + 8] = np.add.reduceat(_LANES[votes[:, k]], part).view(np.uint8).reshape(-1, 8)
        owner = np.searchsorted(part, first)
        total = np.add.reduceat(total.astype(np.int32), owner, axis=0)
        bits = np.packbits(2 * total > count[:, None], axis=1)
        out[lo + doc[first]] = bits.view(">i8").astype(np.int64).reshape(-1, 2)
        has[lo + doc[first]] = True
    return out, has


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2) of every document that has an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, has = fingerprints(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), pa.array(fp[has, 0]), pa.array(fp[has, 1])], names=["doc_id", "h1", "h2"])

    body = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return batched(body).mapInArrow(run, f"doc_id {body.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long")


def unpacked(fp: np.ndarray) -> np.ndarray:
    """Fingerprints (n, 2) as (n, 128) bits."""
    return np.unpackbits(np.ascontiguousarray(fp).astype(">i8").view(np.uint8).reshape(len(fp), 16), axis=1)


def layout(n: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """How many tables, and how many bits their keys have, for n fingerprints."""
    bits = min(max(math.ceil(math.log2(max(n, 2))) - 2, LEAST_BITS), MOST_BITS)
    meet = math.prod((BITS - distance - k) / (BITS - k) for k in range(bits))
    return math.ceil(math.log(1 - recall) / math.log(1 - meet)), bits


def key_positions(tables: int, key_bits: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    return np.stack([rng.choice(BITS, key_bits, replace=False) for _ in range(tables)])


@cache
def cover(distance: int = DISTANCE) -> np.ndarray:
    """Masks (tables, 2) as uint64: of whatever `distance` bits of a fingerprint, some mask has none.

    The bits are cut in parts with radii such that one part at least differs in no more bits than its radius r. Each of
    its positions has a vector of r + 1 bits, and each vector but zero is a table, whose mask has the positions of odd
    product with it. The vectors of r positions don't span the space, so some table is orthogonal to all of them
    (Pagh, CoveringLSH, 2016). A mask has about half of its part's bits. Masks are sorted by vector, then part.
    """
    parts = max(2, -(-(distance + 1) // VECTOR_BITS))
    found = []
    for part, (radius, place) in enumerate(zip(np.array_split(np.arange(distance + 1), parts), np.array_split(np.arange(BITS), parts))):
        every, rng = np.arange(1, 1 << len(radius)), np.random.default_rng(20 + part)
        if not len(every):
            continue
        draws = (np.concatenate([rng.permutation(every) for _ in range(-(-len(place) // len(every)))])[: len(place)] for _ in range(DRAWS))
        odd = min((np.bitwise_count(every[:, None] & v) & 1 for v in draws), key=lambda odd: np.exp2(-odd.sum(axis=1, dtype=float)).sum())
        bits = np.zeros((len(every), BITS), np.uint8)
        bits[:, place] = odd
        found += [(v, part, m) for v, m in zip(every.tolist(), np.packbits(bits, axis=1).view(">u8").astype(np.uint64))]
    return np.stack([m for _, _, m in sorted(found, key=lambda f: f[:2])])


def table_groups(masks: np.ndarray, ranges: int) -> list[np.ndarray]:
    """Tables by the bits of their masks: groups of GROUP_TABLES at most, whose shared bits tell twice as many ranges apart (if one table's do)."""
    need = math.ceil(math.log2(ranges)) + 1 if ranges > 1 else 0
    out, left = [], [np.arange(len(masks))]
    while left:
        some = left.pop()
        if len(some) == 1 or len(some) <= GROUP_TABLES and np.bitwise_count(np.bitwise_and.reduce(masks[some])).sum() >= need:
            out.append(some)
            continue
        bits = unpacked(masks[some].view(np.int64))
        has = bits[:, np.abs(2 * bits.sum(axis=0, dtype=np.int64) - len(some)).argmin()] == 1
        left += [some[has], some[~has]]
    return out


def masked(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A hash of each fingerprint's masked bits (words (n, 2) as uint64), whose high bits are the best."""
    return (words[:, 0] & mask[0]) * np.uint64(0x9E3779B97F4A7C15) + (words[:, 1] & mask[1]) * np.uint64(0xD6E8FEB86659FD93)


def keys_of(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The key of each fingerprint in one table."""
    out = np.zeros(len(bits), np.int64)
    for k, at in enumerate(positions.tolist()):
        out |= bits[:, at].astype(np.int64) << k
    return out


def pivot_table(bits: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances (n, pivots) to the reference fingerprints, which are drawn once from a fixed seed."""
    ref = np.random.default_rng(7).integers(0, 2, (BITS, pivots)).astype(np.float32) * 2 - 1
    out = np.empty((len(bits), pivots), np.uint8)
    for lo in range(0, len(bits), 8192):
        out[lo : lo + 8192] = (BITS - (bits[lo : lo + 8192].astype(np.float32) * 2 - 1) @ ref) / 2
    return out


def bucket_pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) within runs of a sorted array, in blocks of about PAIR_BLOCK."""
    within = tk.offsets_of(size - 1)
    place = np.arange(within[-1]) - np.repeat(within[:-1], size - 1)
    first, partners = np.repeat(start, size - 1) + place, np.repeat(size - 1, size - 1) - place
    done, upto = 0, np.cumsum(partners)
    while done < len(first):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIR_BLOCK)))
        f, p = first[done:stop], partners[done:stop]
        i = np.repeat(f, p)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)
        done = stop


def verified(fp: np.ndarray, far: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within the distance: those that the pivots can't discard are verified."""
    for lo in range(0, far.shape[1], 32):
        a, b = far[i, lo : lo + 32], far[j, lo : lo + 32]
        near = (np.maximum(a, b) - np.minimum(a, b)).max(axis=1) <= distance
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64)).sum(axis=1) <= distance
    return i[near], j[near]


def bucket_links(fp: np.ndarray, far: np.ndarray, start: int, size: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (i, j) of one run that connect whatever its near pairs connect: one less than each component has members.

    A fingerprint whose near ones are found is a pivot for them: of those left, one can only be near to a member if
    its distance to the pivot differs from the member's by at most the distance, which a sorted list of distances tells
    for a whole range at once. At most about 64 such lists are held.
    """
    words = fp.view(np.uint64)
    left = np.ones(size, bool)

    def apart(x: int, some: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words[start + some] ^ words[start + x]).sum(axis=1).astype(np.int64)

    for root in range(size):
        if not left[root]:
            continue
        left[root] = False
        reached: list[tuple[int, tuple | None]] = [(root, None)]
        while reached:
            x, view = reached.pop()
            if view is None:
                some = np.flatnonzero(left)
            else:
                pivot, order, far_off = view
                own = int(apart(pivot, np.array([x]))[0])
                lo, hi = np.searchsorted(far_off, [own - distance, own + distance + 1])
                some = order[lo:hi]
                some = some[left[some]]
            if not len(some):
                continue
            i, j = verified(fp, far, np.full(len(some), start + x), start + some, distance)
            if not len(j):
                continue
            yield np.minimum(i, j), np.maximum(i, j)
            left[j - start] = False
            if view is None or 64 * len(j) > size:
                rest = np.flatnonzero(left)
                off = apart(x, rest)
                by = np.argsort(off, kind="stable")
                view = (x, rest[by], off[by])
            reached.extend((int(k), view) for k in j - start)


def range_pairs(fp: np.ndarray, ids: np.ndarray, table: int, positions: np.ndarray, distance: int, pivots: int, all_pairs: int = ALL_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of ids among fingerprints of one key range of one table: all of a small bucket, links of a large one."""
    bits = unpacked(fp)
    key = keys_of(bits, positions[table])
    order = np.argsort(key, kind="stable")
    fp, ids, bits, key = fp[order], ids[order], bits[order], key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    start, size = start[size > 1], size[size > 1]
    far = pivot_table(bits, pivots)
    large = size > all_pairs
    paired = (verified(fp, far, i, j, distance) for i, j in bucket_pairs(start[~large], size[~large]))
    linked = (pair for at, n in zip(start[large].tolist(), size[large].tolist()) for pair in bucket_links(fp, far, at, n, distance))
    for i, j in chain(paired, linked):
        for t in range(table):  # met in an earlier table already, which connects them
            if not len(i):
                break
            fresh = (bits[i][:, positions[t]] != bits[j][:, positions[t]]).any(axis=1)
            i, j = i[fresh], j[fresh]
        if len(i):
            yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def top(root: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The roots of some members of a forest of parents."""
    at = root[some]
    while (root[at] != at).any():
        at = root[at]
    return at


def connect(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins i and j in a forest of parents; which of the pairs were needed for it."""
    needed, live = [], np.arange(len(i))
    while len(live):
        a, b = top(root, i[live]), top(root, j[live])
        root[i[live]], root[j[live]] = a, b
        live, a, b = live[a != b], a[a != b], b[a != b]
        own, first = np.unique(np.maximum(a, b), return_index=True)
        root[own] = np.minimum(a, b)[first]
        needed.append(live[first])
    return np.concatenate(needed) if needed else live


def covered_links(fp: np.ndarray, ids: np.ndarray, tables: np.ndarray, masks: np.ndarray, distance: int, pivots: int, all_pairs: int = ALL_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of ids that connect what the near pairs of some tables connect, but for those that other, earlier tables connect."""
    n, words = len(fp), np.ascontiguousarray(fp).view(np.uint64)
    one, two = np.ascontiguousarray(words.T)
    root, low, place = np.arange(n), np.uint64(max(n - 1, 1).bit_length()), np.arange(n, dtype=np.uint64)

    def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        close = np.bitwise_count(one[i] ^ one[j]) + np.bitwise_count(two[i] ^ two[j]) <= distance
        return i[close], j[close]

    def bucket(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a large bucket, near pairs that connect what is not yet connected."""
        group = top(root, some)
        names, size = np.unique(group, return_counts=True)
        others = some[group != names[size.argmax()]]
        if len(others) <= all_pairs:  # the rest is connected
            yield from (near(np.full(len(some), x), some) for x in others.tolist())
        else:
            yield from ((some[i], some[j]) for i, j in bucket_links(fp[some], pivot_table(unpacked(fp[some]), pivots), 0, len(some), distance))

    found = []
    for t in sorted(tables.tolist()):
        key = masked(words, masks[t]) >> low << low | place
        key.sort()
        at = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        key >>= low
        same = np.flatnonzero(key[1:] == key[:-1])
        first = np.flatnonzero(np.append(True, same[1:] != same[:-1] + 1)) if len(same) else same
        start, size = same[first], np.diff(np.append(first, len(same))) + 1
        large = size > all_pairs
        paired = (near(at[i], at[j]) for i, j in bucket_pairs(start[~large], size[~large]))
        linked = (pair for lo, m in zip(start[large].tolist(), size[large].tolist()) for pair in bucket(at[lo : lo + m]))
        for i, j in chain(paired, linked):
            needed = connect(root, i, j)
            found.append((i[needed], j[needed], np.full(len(needed), t)))
    i, j, t = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    for before in sorted(set(range(int(t.max()) if len(t) else 0)) - set(tables.tolist())):
        met = (t > before) & ((one[i] ^ one[j]) & masks[before, 0] | (two[i] ^ two[j]) & masks[before, 1] == 0)
        i, j, t = i[~met], j[~met], t[~met]
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def near_pairs(nodes: DataFrame, n: int, distance: int = DISTANCE, recall: float | None = None, pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) with a < b within the distance: of nodes (node, h1, h2), n of distinct fingerprints, pairs that connect what all near pairs would.

    With `recall` it is approximate: a pair at the distance is found with that chance.
    """
    ranges = shards(n, shard_rows)
    if recall is None:
        positions, masks = None, cover(distance)
        groups_of = table_groups(masks, ranges)
    else:
        positions = key_positions(*layout(n, distance, recall))
        masks = np.packbits((positions[:, :, None] == np.arange(BITS)).any(axis=1), axis=1).view(">u8").astype(np.uint64)
        groups_of = [np.array([t]) for t in range(len(masks))]
    shared = np.stack([np.bitwise_and.reduce(masks[g]) for g in groups_of])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            data = np.concatenate(held)
            words = np.ascontiguousarray(data[:, 1:]).view(np.uint64)
            each = max(1, PACK_BYTES // data.nbytes)
            for lo in range(0, len(shared), each):
                yield packed(data, words, range(lo, min(lo + each, len(shared))))

        def packed(data: np.ndarray, words: np.ndarray, some: range) -> pa.RecordBatch:
            t, r, blob = [], [], []
            for k in some:
                where = (tk.mix(masked(words, shared[k])) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                at = np.searchsorted(where[order], np.arange(ranges + 1))
                for s in range(ranges):
                    if at[s] < at[s + 1]:
                        t.append(k)
                        r.append(s)
                        blob.append(data[order[at[s] : at[s + 1]]].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(r, pa.int32()), pa.array(blob, pa.binary())], names=["t", "r", "blob"])

        for b in batches:
            held.append(np.stack([b.column(k).to_numpy() for k in range(3)], axis=1))
            rows += len(held[-1])
            if rows >= 50_000:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(pdf["blob"]), np.int64).reshape(-1, 3)
        if positions is None:
            a, b = covered_links(data[:, 1:], data[:, 0], groups_of[int(key[0])], masks, distance, pivots)
            return pd.DataFrame({"a": a, "b": b})
        found = list(range_pairs(data[:, 1:], data[:, 0], int(key[0]), positions, distance, pivots))
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])}) if found else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return nodes.select("node", "h1", "h2").mapInArrow(pack, "t int, r int, blob binary").groupBy("t", "r").applyInPandas(meet, "a long, b long")


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, **how: int) -> DataFrame:
    """(doc_id, group_id) of every document in a group of two or more ids.

    Nodes are distinct fingerprints with their least and greatest id, so thousands of copies are one node. The documents
    meet their node's group once, and a node of very many documents is broadcast (join_counted).
    """
    prints = stored(fingerprint_table(docs, id_col, text_col).distinct())
    nodes = prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    pairs = near_pairs(nodes, nodes.count(), **how)
    # An id with several fingerprints ties their nodes together.
    several = prints.groupBy("doc_id").agg(F.count("*").alias("times"), F.min(F.struct("h1", "h2")).alias("one")).where("times > 1")
    tied = join_counted(prints, several, ["doc_id"], "times", hot_rows).where("h1 <> one.h1 OR h2 <> one.h2")
    at = nodes.select("h1", "h2", "node", "n")
    ends = tied.join(at.select("h1", "h2", F.col("node").alias("b")), ["h1", "h2"]).select("b", F.col("one.h1").alias("h1"), F.col("one.h2").alias("h2"))
    same = ends.join(at.select("h1", "h2", F.col("node").alias("a")), ["h1", "h2"]).select("a", "b").distinct()
    root = components(pairs.unionByName(same))
    placed = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups_ = placed.groupBy("root").agg(F.min("least").alias("group_id"), F.max("most").alias("__most"), F.count("*").alias("k")).where("group_id <> __most")
    named = join_counted(placed, groups_, ["root"], "k", hot_rows).select("h1", "h2", "n", "group_id")
    found = join_counted(prints, named, ["h1", "h2"], "n", hot_rows).select("doc_id", "group_id")
    return found.distinct()  # an id of several fingerprints


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """Every document that has a near copy: (doc_id, group_id, is_kept); group_id is the least id of its group."""
    return members(docs, id_col, text_col, **how).withColumn("is_kept", F.col("doc_id") == F.col("group_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs without the documents that a kept near copy stands for; its columns are unchanged."""
    gone = cut(members(docs, id_col, text_col, **how).where("doc_id <> group_id").select("doc_id"))
    return without(docs, F.col(f"`{id_col}`"), gone)
