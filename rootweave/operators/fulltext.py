"""An inverted index as stored tables, boolean and phrase matching, and BM25 ranking.

Layout: postings(term, doc, len, tf, positions), range-partitioned and sorted by term and document, so that a query reads
only the row groups of its terms and a frequent term is in many files; and corpus(n_docs, avg_len) of one row. An index is
written as a new version beside the old ones, and a pointer names the current one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions import text as T
from rootweave.storage import cut, open_version, stored, write_version

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def tokenised(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), T.tokens(text).alias("tokens"))


def _runs(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one term in one document of a batch (doc, tokens), by one sort of codes: the batch's terms; each run's document row,
    term's code and begin; and of all tokens in that order the positions. Last the documents' lengths."""
    lists = batch.column("tokens")
    codes = pc.dictionary_encode(lists.flatten())
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    key = row * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    held = key[order]
    begin = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
    positions = (order - np.repeat(np.cumsum(size) - size, size)[order]).astype(np.int32)
    return codes.dictionary, row[order[begin]], codes.indices.to_numpy(zero_copy_only=False)[order[begin]], begin, positions, size


def _posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, row, code, begin, positions, size = _runs(batch)
        ends = np.r_[begin, len(positions)]
        at = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(positions))
        columns = [terms.take(pa.array(code)), batch.column("doc").take(pa.array(row)), pa.array(size[row]), pa.array(np.diff(ends)), at]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "doc", "len", "tf", "positions"])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, _, code, begin, positions, _ = _runs(batch)
        n = len(terms)
        df, cf = np.bincount(code, minlength=n), np.bincount(code, np.diff(np.r_[begin, len(positions)]), minlength=n)
        yield pa.RecordBatch.from_arrays([terms, pa.array(df.astype(np.int64)), pa.array(cf.astype(np.int64))], names=["term", "df", "cf"])


def _in_batches(tokenised_docs: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
    tokenised_docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return tokenised_docs.select("doc", "tokens").mapInArrow(work, schema)


def postings(tokenised_docs: DataFrame) -> DataFrame:
    """(term, doc, len, tf, positions) with positions from 0, in order. A document is one row, so nothing shuffles."""
    return _in_batches(tokenised_docs, _posted, f"term string, doc {dict(tokenised_docs.dtypes)['doc']}, len long, tf long, positions array<int>")


def laid_out(tokenised_docs: DataFrame) -> DataFrame:
    """postings() in the layout of an index. They are stored first, as the ranges' bounds are found by reading them once more."""
    return stored(postings(tokenised_docs)).repartitionByRange("term", "doc").sortWithinPartitions("term", "doc")


class Index(NamedTuple):
    postings: DataFrame
    corpus: DataFrame


def write_index(tokenised_docs: DataFrame, folder: str) -> int:
    """Writes the index of documents as the folder's next version, which becomes the current one; gives its number."""
    return write_version(folder, {"postings": laid_out(tokenised_docs), "corpus": corpus_stats(doc_stats(tokenised_docs))})


def open_index(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    return Index(**open_version(spark, folder, ("postings", "corpus"), version))


def indexed_counts(index: Index, phrases: list[str]) -> DataFrame:
    """(doc, len, f_0 ...): as phrase_counts() of the documents with some word of the phrases, from their postings alone."""
    words = list(dict.fromkeys(w for p in phrases for w in p.split(" ")))
    hits = index.postings.where(F.col("term").isin(*words))
    by_doc = hits.groupBy("doc").agg(F.first("len").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # the query's words

    def found(phrase: str) -> Column:
        first, *rest = phrase.split(" ")
        here = lambda p: F.reduce(F.array(*[F.coalesce(F.array_contains(F.col("at")[w], p + k), F.lit(False)) for k, w in enumerate(rest, 1)]), F.lit(True), lambda a, b: a & b)
        at = F.col("at")[first]
        return F.coalesce(F.size(F.filter(at, here) if rest else at), F.lit(0)).cast("long")

    counted = by_doc.select("doc", "len", *[F.when(F.col("at")[p.split(" ")[0]].isNull(), F.lit(0).cast("long")).otherwise(found(p)).alias(f"f_{k}") for k, p in enumerate(phrases)])
    return counted


def doc_stats(tokenised_docs: DataFrame) -> DataFrame:
    return tokenised_docs.select("doc", F.size("tokens").cast("long").alias("len"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def idf(n_docs: Column, n_hits: Column) -> Column:
    return F.greatest(F.lit(IDF_FLOOR), F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5)))


def bm25_part(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def phrase_frequency(tokens: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase stand next to each other in an array that is bound already."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))

    def here(t: Column, i: Column) -> Column:
        out = t == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & F.coalesce(F.get(tokens, i + k) == w, F.lit(False))
        return out

    return F.size(F.filter(tokens, here))


def phrase_counts(tokenised_docs: DataFrame, phrases: list[str]) -> DataFrame:
    """(doc, len, f_0 ...): each phrase's frequency in each document.

    The token array is bound once as a lambda variable: otherwise each use would split the text again.
    """
    one = F.transform(F.array("tokens"), lambda t: F.struct(F.size(t).cast("long").alias("len"), *[phrase_frequency(t, p.split(" ")).cast("long").alias(f"f_{k}") for k, p in enumerate(phrases)]))
    return tokenised_docs.select("doc", F.explode(one).alias("c")).select("doc", "c.*")


def has_all(groups: list[list[str]]) -> Column:
    at, keep = 0, F.lit(bool(groups))
    for g in groups:
        keep = keep & (F.greatest(F.lit(0).cast("long"), *[F.col(f"f_{at + k}") for k in range(len(g))]) > 0)
        at += len(g)
    return keep


def match(tokenised_docs: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(doc, len, f_0 ...): documents that have some phrase of every group, with each phrase's frequency.

    One scan: phrases are counted in place in each document's token array, so nothing shuffles.
    """
    return phrase_counts(tokenised_docs, [p for g in groups for p in g]).where(has_all(groups))


def scored(counts: DataFrame, corpus: DataFrame, groups: list[list[str]], all_groups: bool = True) -> DataFrame:
    """(doc, score) from phrase counts: the documents that have all groups (or any), each phrase adding its part."""
    phrases = [p for g in groups for p in g]
    seen = counts.agg(*[F.count_if(F.col(f"f_{k}") > 0).alias(f"n_{k}") for k in range(len(phrases))])
    some = has_all(groups if all_groups else [phrases])
    hits = counts.where(some).crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(corpus))  # one row each
    score = F.lit(0.0)
    for k in range(len(phrases)):
        score = score + F.when(F.col(f"f_{k}") > 0, idf(F.col("n_docs"), F.col(f"n_{k}")) * bm25_part(F.col(f"f_{k}"), F.col("len"), F.col("avg_len"))).otherwise(0.0)
    return hits.select("doc", score.alias("score"))


def bm25(tokenised_docs: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(doc, score) of the documents that match all groups, by a scan: texts are tokenised once, and only counts are kept."""
    counts = cut(phrase_counts(tokenised_docs, [p for g in groups for p in g]))
    return scored(counts, corpus_stats(counts), groups)


def bm25_indexed(index: Index, groups: list[list[str]], all_groups: bool = True) -> DataFrame:
    """(doc, score) from a stored index: only the postings of the groups' words are read."""
    return scored(indexed_counts(index, [p for g in groups for p in g]), index.corpus, groups, all_groups)


def top(scored: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The best rows by score, with a total order from the tie columns."""
    return scored.orderBy(F.desc("score"), *ties).limit(limit)


def refresh(postings_: DataFrame, changed_docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Postings after some documents changed or went: theirs are replaced, the others stay.

    changed_docs is tokenised; removed has doc. Only the changed documents are tokenised again.
    """
    gone = removed.select("doc").unionByName(changed_docs.select("doc")).distinct()
    return postings_.join(gone, "doc", "left_anti").unionByName(postings(changed_docs))


def document_frequency(tokenised_docs: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences. Batches of documents count their own terms; one row a term and task shuffles."""
    return _in_batches(tokenised_docs, _counted, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
