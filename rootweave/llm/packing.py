"""Best-fit packing of token sequences into training bins, refined by swap-based local search.

Documents are dealt by hash into groups of about `group_docs`, a size that doesn't grow with the
input, and each group is packed on its own: only (id, length) pairs shuffle, and a group wastes a
few bins at most. A document longer than a bin fills bins of its own; its rest is packed like a
short document. Best fit in decreasing order gives the start. Local search then takes the underfull
bins from the lightest: it moves one item, exchanges one for one or two for one with another
underfull bin, always so that the sum of squared fills grows, until no such step is left in the group (the sum
is an integer and bounded, so this ends); bins that lose all items vanish.

Cases. Null, empty and zero-length texts take no place and give no rows. Repeated rows and null ids
are packed like others. Ids may be of any type that has an order. Ties go to the smaller id (null last), then the bin
opened first. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm.common import shards, stored
from rootweave.llm.token_count import VOCABULARY, count_tokens

CAPACITY = 2048
GROUP_DOCS = 20_000


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (lengths of 1 to capacity), by best fit in decreasing order."""
    out = np.empty(len(lengths), np.int64)
    free: list[tuple[int, int]] = []
    bins = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b, bins = capacity, bins, bins + 1
        out[k] = b
        if room > n:
            insort(free, (room - n, b))
    return out


def local_search(lengths: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """where, improved until no move or exchange of a bin's one or two items for one helps. No bin overflows."""
    fill = np.bincount(where, weights=lengths).astype(np.int64)
    items = np.flatnonzero(fill[where] < capacity)
    if not len(items):
        return where
    where = where.copy()
    size, home = lengths[items], where[items]
    held: dict[int, set[int]] = {}
    for k, b in enumerate(home.tolist()):
        held.setdefault(b, set()).add(k)

    def put(k: int, b: int) -> None:
        held[home[k]].discard(k)
        held.setdefault(b, set()).add(k)
        fill[home[k]] -= size[k]
        fill[b] += size[k]
        home[k] = b

    bins = np.array(sorted(held), np.int64)
    better = True
    while better:
        better = False
        for a in bins[np.argsort(fill[bins], kind="stable")].tolist():
            changed = True
            while changed and 0 < fill[a] < capacity:
                changed = False
                own = sorted(held[a], key=lambda k: (-size[k], k))
                for k in own:  # move one: the fullest bin that takes it and ends above this one
                    room = capacity - fill[bins]
                    fit = np.flatnonzero((room >= size[k]) & (bins != a) & (fill[bins] + size[k] > fill[a]) & (fill[bins] > 0))
                    if len(fit):
                        put(k, int(bins[fit[np.argmin(room[fit])]]))
                        changed = better = True
                        break
                if changed:
                    continue
                room = capacity - fill[home]
                gives = [((k,), int(size[k])) for k in own] + [((own[x], own[y]), int(size[own[x]] + size[own[y]])) for x in range(len(own)) for y in range(x + 1, len(own))]
                for given, total in gives:  # exchange one or two for one of another bin, which gains the most
                    gain = total - size
                    fit = np.flatnonzero((gain > 0) & (gain <= room) & (home != a) & (fill[home] + gain > fill[a]))
                    if len(fit):
                        taken = int(fit[np.argmax(gain[fit])])
                        other = int(home[taken])
                        put(taken, a)
                        for k in given:
                            put(k, other)
                        changed = better = True
                        break
    where[items] = home
    return where


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Dense bin numbers of items of 1 to capacity."""
    return np.unique(local_search(lengths, best_fit(lengths, capacity), capacity), return_inverse=True)[1]


def pack(lengths: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(bin, doc_id, token_begin, token_end): which tokens of which document each bin holds."""
    body = lengths.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{length_col}`").cast("long").alias("n")).where("n > 0")
    # Rows that agree in id and length are told apart by a number, so that many of them spread over the groups as well.
    body = stored(body.withColumn("tag", F.monotonically_increasing_id()))
    groups = shards(body.count(), group_docs)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        n = rows.column("n").to_numpy()
        full, rest = n // capacity, n % capacity
        doc = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        short = np.flatnonzero(rest)
        bins = np.concatenate([np.arange(len(doc)), len(doc) + pack_lengths(rest[short], capacity)]) if len(short) else np.arange(len(doc))
        begin = np.concatenate([nth * capacity, full[short] * capacity])
        end = np.concatenate([(nth + 1) * capacity, n[short]])
        ids = rows.column("doc_id").take(pa.array(np.concatenate([doc, short])))
        return pa.table({"bin": bins + (key[0].as_py() << 32), "doc_id": ids, "token_begin": begin, "token_end": end})

    keyed = body.withColumn("g", F.pmod(F.xxhash64("doc_id", "n", "tag"), F.lit(groups)))
    return keyed.groupBy("g").applyInArrow(run, f"bin long, doc_id {body.schema['doc_id'].dataType.simpleString()}, token_begin long, token_end long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, **how: object) -> DataFrame:
    """pack() of the documents' token counts."""
    return pack(count_tokens(docs, vocabulary, entries=0), capacity, **how)
