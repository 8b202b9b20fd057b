"""Passages that repeat across documents, by a suffix array refined with bucket pointers.

A suffix starts at each word (runs of letters and digits, lower-cased) that at least `min_words`
words follow in its document. Its initial bucket is one q-gram of its first min_words words: the least by
hash (a minimizer), so that suffixes which agree that far share a bucket and a run of neighbouring
suffixes costs one record. Buckets that only one document has are final and drop out: this first pass
counts buckets with their least and greatest document, combined in each map task, so the most frequent bucket
is one row a task. The repeated ones return as a filter of bounded size (one bucket too many costs work and changes
nothing). The second pass sends the words around each record of such a bucket to a task that holds some whole buckets,
of about the same number of records at any input size; texts never shuffle.
There the suffix array is built by bucket-pointer refinement (Schuermann and Stoye, 2007): buckets of
short q-grams are split by sorting on the bucket pointers of later offsets, slice by slice, and each
slice's new pointers are used at once by the slices and rounds that follow. Neighbours in the suffix array
that agree in min_words words form a group; a group with several documents is a repeat.
A bucket of more records than a task should hold is split by document. Each part builds its own suffix array and
hands on its groups with their least and greatest document; these are merged by group and return to the parts,
which then know the repeats.

Cases. Null texts, rows without an id and texts of fewer words have no spans. Ids must be of an integral type, and
min_words 32 at least; others raise an error. Repeats within one
document alone are not reported. Rows that share an id count as one document. The occurrences in the
least doc_id are the first ones, however many it has. Texts are read whole. An empty table gives no rows. Other
columns, whatever their names, are ignored by spans() and passed through by remove().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm import textkit as tk
from rootweave.llm.common import HOT_ROWS, batched, filter_words, integral_id, join_counted, key_filter, may_hold, shards, stored

MIN_WORDS = 50
GRAM = 16
#: Records of a reduce task: buckets when they are counted, stretches of words when they are refined.
COUNT_EACH, REFINE_EACH = 1_000_000, 10_000
#: A bucket of more than this many tasks' records is split, if it also has more than a HOT_SHARE-th of all: so split buckets are HOT_SHARE at most.
HOT_TASKS, HOT_SHARE = 5, 1_000_000
_PLACE = 28
_COUNT = np.dtype([("bucket", "<u8"), ("least", "<i8"), ("most", "<i8"), ("n", "<i8")])
_STRETCH = np.dtype([("bucket", "<u8"), ("doc", "<i8"), ("begin", "<i8"), ("suffixes", "<i4"), ("words", "<i4")])


def records(texts: list[str | None], min_words: int = MIN_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: its first text, word hashes, each text's bounds in them, and the records: bucket, text, first suffix, number of suffixes."""
    width = min_words - GRAM + 1
    for lo, hi in tk.blocks(texts):
        word, doc, _, _ = tk.words(texts[lo:hi])
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        n = len(word)
        none = np.zeros(0, np.int64)
        if n < min_words:
            yield lo, word, at, np.zeros(0, np.uint64), none, none, none
            continue
        place = np.arange(n - GRAM + 1)
        gram = tk.span_hashes(word, place, place + GRAM)
        low = (gram & np.uint64((1 << 64) - (1 << _PLACE))) | place.astype(np.uint64)
        have = 1
        while 2 * have <= width:
            low = np.minimum(low[: len(low) - have], low[have:])
            have *= 2
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        suffix = np.arange(len(low))
        suffix = suffix[doc[suffix] == doc[suffix + min_words - 1]]
        best = gram[(low[suffix] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)]
        # Neighbours of one bucket are one record, wherever their q-gram stands: a word said a thousand times is one stretch.
        head = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (doc[suffix[1:]] != doc[suffix[:-1]]))) if len(best) else none
        yield lo, word, at, best[head], doc[suffix[head]], suffix[head], np.diff(np.append(head, len(best)))


def combined(counts: np.ndarray) -> np.ndarray:
    """Counts with one entry a bucket."""
    counts = counts[np.argsort(counts["bucket"], kind="stable")]
    head = np.flatnonzero(np.append(True, counts["bucket"][1:] != counts["bucket"][:-1])) if len(counts) else np.zeros(0, np.int64)
    out = counts[head].copy()
    if len(out):
        out["least"], out["most"], out["n"] = np.minimum.reduceat(counts["least"], head), np.maximum.reduceat(counts["most"], head), np.add.reduceat(counts["n"], head)
    return out


def dealt(where: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows of that part) of the parts that have any."""
    order = np.argsort(where, kind="stable")
    at = np.searchsorted(where[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(at)).tolist():
        yield p, order[at[p] : at[p + 1]]


def refined(text: np.ndarray, depth: int, slices: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions of text in the order of their suffixes' first `depth` signs at least, and the bucket pointer of each position.

    text ends with a sign that occurs nowhere else, so no offset of use runs over its end.
    """
    n = len(text)
    pointer = np.unique(text, return_inverse=True)[1].astype(np.int64)

    def later(at: np.ndarray, by: int) -> np.ndarray:
        return pointer[np.minimum(at + by, n - 1)]

    every = np.arange(n)
    known = 1
    while known < min(4, depth):  # the initial q-gram buckets
        pointer = np.unique(pointer << 32 | later(every, known), return_inverse=True)[1].astype(np.int64)
        known *= 2
    order = np.argsort(pointer, kind="stable")
    sorted_ = pointer[order]
    head = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    size = np.diff(np.append(head, n))
    pointer[order] = np.repeat(head, size)  # a bucket's pointer is its begin in the suffix array
    while known < depth:
        many = size > 1
        head, size = head[many], size[many]
        if not len(head):
            break
        edges = np.searchsorted(np.cumsum(size), np.linspace(0, size.sum(), slices + 1)[1:], "left") + 1
        made_head, made_size, lo = [], [], 0
        for hi in np.minimum(edges, len(head)).tolist():
            if hi <= lo:
                continue
            first, count = head[lo:hi], size[lo:hi]
            lo = hi
            spread = tk.offsets_of(count)
            slot = np.repeat(first - spread[:-1], count) + np.arange(spread[-1])
            at = order[slot]
            own, key = np.repeat(first, count), later(at, known)
            sort = np.lexsort((key, own))
            at, own, key = at[sort], own[sort], key[sort]
            order[slot] = at
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
            part = np.diff(np.append(new, len(at)))
            pointer[at] = np.repeat(slot[new], part)
            made_head.append(slot[new])
            made_size.append(part)
        head, size = np.concatenate(made_head), np.concatenate(made_size)
        known *= 2
    return order, pointer


class Suffixes:
    """The suffix array of some stretches, and the groups of suffixes that agree in min_words words."""

    def __init__(self, stretches: np.ndarray, words: np.ndarray, min_words: int) -> None:
        size = stretches["words"].astype(np.int64)
        self.stretches, self.min_words = stretches, min_words
        self.first = tk.offsets_of(size + 1)[:-1]
        n = int((size + 1).sum())
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        self.inside = (np.arange(n) - self.first[self.owner]).astype(np.int32)
        end = self.inside == size[self.owner]
        names = np.unique(words, return_inverse=True)[1]
        text, self.words = np.empty(n, np.int64), np.zeros(n, np.uint64)
        text[~end], self.words[~end] = names, words
        text[end] = len(words) + self.owner[end]  # its own sign after each stretch
        order, _ = refined(text, min_words)
        self.order = order[self.inside[order] < stretches["suffixes"][self.owner[order]]]
        window = tk.span_hashes(self.words, self.order, self.order + min_words)
        head = np.append(True, window[1:] != window[:-1]) if len(window) else np.zeros(0, bool)
        self.start, self.group = np.flatnonzero(head), np.cumsum(head) - 1
        self.doc = stretches["doc"][self.owner[self.order]]
        self.window, self.bucket = window[self.start], stretches["bucket"][self.owner[self.order[self.start]]]
        self.least = np.minimum.reduceat(self.doc, self.start) if len(self.start) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.doc, self.start) if len(self.start) else np.zeros(0, np.int64)

    def pieces(self, least: np.ndarray, shared: np.ndarray) -> pd.DataFrame:
        """(doc_id, b, e, is_first): runs of suffixes whose group several documents have; least is each group's least document."""
        state = np.zeros(len(self.owner), np.int8)
        state[self.order] = np.where(shared[self.group], np.where(self.doc == least[self.group], 1, 2), 0)
        begins = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (self.owner[1:] != self.owner[:-1]))) if len(state) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(state))
        some = state[begins] > 0
        begins, ends = begins[some], ends[some]
        k = self.owner[begins]
        at = self.stretches["begin"][k] - self.first[k]
        return pd.DataFrame({"doc_id": self.stretches["doc"][k], "b": at + begins, "e": at + ends - 1 + self.min_words, "is_first": state[begins] == 1})


def spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, word_begin, word_end, is_first): the stretches of words that other documents also have, merged where they touch."""
    if min_words < 2 * GRAM:
        raise ValueError(f"min_words must be {2 * GRAM} at least")
    body = docs.select(integral_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shards(size // 100, COUNT_EACH)  # about a record each 100 bytes of prose

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            data = combined(np.concatenate(held))
            rows = [(p, data[rows].tobytes()) for p, rows in dealt((data["bucket"] % np.uint64(parts)).astype(np.int64), parts)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["p", "blob"])

        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, _, bucket, doc, _, _ in records(b.column(1).to_pylist(), min_words):
                if len(bucket):
                    one = np.empty(len(bucket), _COUNT)
                    one["bucket"], one["least"], one["most"], one["n"] = bucket, ids[lo + doc], ids[lo + doc], 1
                    held.append(one)
            if sum(map(len, held)) > 1_000_000:
                yield out()
        if held:
            yield out()

    def shared(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = combined(np.concatenate([np.frombuffer(b, _COUNT) for b in pdf["blob"]]))
        data = data[data["least"] != data["most"]]
        # A bucket is the least of many hashes, so its high bits are few: the filter takes it mixed.
        return pd.DataFrame({"bucket": data["bucket"].view(np.int64), "mixed": tk.mix(data["bucket"], 7).view(np.int64), "n": data["n"]})

    several = stored(batched(body).mapInArrow(first, "p int, blob binary").groupBy("p").applyInPandas(shared, "bucket long, mixed long, n long"))
    count, total = several.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = filter_words(several.select("mixed"), count)
    parts2 = shards(total, REFINE_EACH)
    much = max(HOT_TASKS * REFINE_EACH, total // HOT_SHARE)
    hot = several.where(F.col("n") > much).toPandas()  # HOT_SHARE rows at most
    hot_bucket = hot["bucket"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hot_bucket)
    hot_bucket, splits = hot_bucket[by], -(-hot["n"].to_numpy(np.int64)[by] // REFINE_EACH)
    known = docs.sparkSession.sparkContext.broadcast((words, hot_bucket, splits, parts2 + tk.offsets_of(splits)))

    def second(only_hot: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, hot_bucket, splits, base = known.value
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def out() -> pa.RecordBatch:
                info, flat = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                offset = tk.offsets_of(info["words"].astype(np.int64))
                if only_hot:
                    k = np.searchsorted(hot_bucket, info["bucket"])
                    where = base[k] + (tk.mix(info["doc"].view(np.uint64), 5) % splits[k].astype(np.uint64)).astype(np.int64)
                else:
                    where = (tk.mix(info["bucket"], 3) % np.uint64(parts2)).astype(np.int64)
                held.clear()
                names, where = np.unique(where, return_inverse=True)
                rows = [(int(names[p]), info[rows].tobytes(), tk.gather(flat, offset, rows).tobytes()) for p, rows in dealt(where, len(names))]
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["p", "info", "flat"])

            for b in batches:
                ids = b.column(0).to_numpy()
                for lo, word, at, bucket, doc, suffix, count in records(b.column(1).to_pylist(), min_words):
                    if not len(bucket):
                        continue
                    has = may_hold(words, tk.mix(bucket, 7))
                    if len(hot_bucket):
                        has &= (hot_bucket[np.minimum(np.searchsorted(hot_bucket, bucket), len(hot_bucket) - 1)] == bucket) == only_hot
                    if not has.any():
                        continue
                    doc, suffix, count = doc[has], suffix[has], count[has]
                    info = np.empty(len(doc), _STRETCH)
                    info["bucket"], info["doc"], info["begin"], info["suffixes"], info["words"] = bucket[has], ids[lo + doc], suffix - at[doc], count, count + min_words - 1
                    need = info["words"].astype(np.int64)
                    offset = tk.offsets_of(need)
                    held.append((info, word[np.repeat(suffix - offset[:-1], need) + np.arange(offset[-1])]))
                if sum(len(h[1]) for h in held) > 1_000_000:
                    yield out()
            if held:
                yield out()

        return batched(body).mapInArrow(run, "p long, info binary, flat binary")

    def opened(pdf: pd.DataFrame) -> Suffixes:
        return Suffixes(np.frombuffer(b"".join(pdf["info"]), _STRETCH), np.frombuffer(b"".join(pdf["flat"]), np.uint64), min_words)

    def refine(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = opened(pdf)
        return s.pieces(s.least, s.least != s.most)

    def groups(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = opened(pdf)
        return pd.DataFrame({"p": np.full(len(s.window), key[0]), "bucket": s.bucket.view(np.int64), "w": s.window.view(np.int64), "least": s.least, "most": s.most})

    def settle(_: tuple, pdf: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
        s = opened(pdf)
        least = merged.set_index(["bucket", "w"])["least"].reindex(pd.MultiIndex.from_arrays([s.bucket.view(np.int64), s.window.view(np.int64)]))
        return s.pieces(least.fillna(0).to_numpy(np.int64), least.notna().to_numpy())

    shape = "doc_id long, b long, e long, is_first boolean"
    pieces = second(False).groupBy("p").applyInPandas(refine, shape)
    if len(hot_bucket):
        split = stored(second(True))
        own = stored(split.groupBy("p").applyInPandas(groups, "p long, bucket long, w long, least long, most long"))
        both = own.groupBy("bucket", "w").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n")).where("least <> most").drop("most")
        merged = join_counted(own.select("p", "bucket", "w"), both, ["bucket", "w"], "n", hot_rows).select("p", "bucket", "w", "least")
        pieces = pieces.unionByName(split.groupBy("p").cogroup(merged.groupBy("p")).applyInPandas(settle, shape))
    pieces = pieces.groupBy("doc_id", "is_first", "b").agg(F.max("e").alias("e"))
    own_ = Window.partitionBy("doc_id", "is_first").orderBy("b")
    upto = F.max("e").over(own_.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("new", F.when(F.col("b") <= upto, 0).otherwise(1)).withColumn("island", F.sum("new").over(own_.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "is_first", "island").agg(F.min("b").alias("word_begin"), F.max("e").alias("word_end")).select("doc_id", "word_begin", "word_end", "is_first")


def cut_words(text: str, drop: list[tuple[int, int]]) -> str:
    """text without the words of the ranges, nor what stands between them."""
    _, _, begin, end = tk.words([text])
    if len(text.lower()) != len(text):  # lower-casing moved the places: find them character by character
        _, _, begin, end = tk.words(["".join(c if len(c.lower()) != 1 else c.lower() for c in text)])
    out, at = [], 0
    for a, b in sorted(drop):
        if a < len(begin) and b > a:
            out.append(text[at : int(begin[a])])
            at = max(at, int(end[min(b, len(end)) - 1]))
    return "".join([*out, text[at:]])


def remove(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose texts lose every repeated stretch that an earlier document has; other columns are unchanged."""
    drop = spans(docs, min_words, id_col, text_col).where("NOT is_first").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.array("word_begin", "word_end")).alias("__drop"))  # one document's spans
    drop = stored(drop)
    maybe = key_filter(drop.select("__id"), drop.count())

    @F.pandas_udf("string")
    def without(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([t if r is None or t is None else cut_words(t, [(int(a), int(b)) for a, b in r]) for t, r in zip(texts, ranges)], dtype=object)

    names = docs.columns
    own = integral_id(docs, id_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), own.alias("__own"), F.col(f"`{text_col}`").alias("__text"), F.coalesce(maybe(own), F.lit(False)).alias("__maybe"))
    same = row.where("NOT __maybe").select("__row", F.col("__text").alias("__new"))
    cut_ = row.where("__maybe").join(drop, F.col("__own") == F.col("__id"), "left").select("__row", without("__text", "__drop").alias("__new"))
    return same.unionByName(cut_).select(*[(F.col("__new") if c == text_col else F.col("__row").getField(c)).alias(c) for c in names])
