"""What the operators of this subpackage share: tables, key filters, joins that stand hot keys, components."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rootweave.storage import cut, stored

#: What an Arrow batch of rows may hold on its way to a Python worker, which bounds the worker's memory.
BATCH_BYTES = 8 << 20
#: A key filter has at most these bytes at any number of keys.
FILTER_BYTES = 32 << 20
#: Keys of more rows are hot. There are at most rows / HOT_ROWS of them, so a table of the hot keys is broadcast.
HOT_ROWS = 1_000_000


def batched(df: DataFrame) -> DataFrame:
    """df, for an operator in Python: its session's Arrow batches hold BATCH_BYTES at most from here on."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def integral_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long. Operators that pack ids into arrays take ids of an integral type alone and say so."""
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be of an integral type, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def shards(rows: int, each: int) -> int:
    """How many hash shards hold about `each` rows, so that a shard's size doesn't grow with the input."""
    return max(1, math.ceil(rows / each))


_MASK = "shiftleft(1L, int(k & 63)) | shiftleft(1L, int(shiftright(k, 6) & 63)) | shiftleft(1L, int(shiftright(k, 12) & 63)) | shiftleft(1L, int(shiftright(k, 18) & 63))"


def filter_words(hashes: DataFrame, n: int) -> np.ndarray:
    """A blocked Bloom filter of n 64-bit hashes (one long column): about two bytes a key, FILTER_BYTES at most.

    It is aggregated by word, so tasks combine their part of it, and its words, whose number is bounded, come to the driver.
    """
    bits = min(max(4, math.ceil(math.log2(max(1, 2 * n / 8)))), int(math.log2(FILTER_BYTES / 8)))
    named = hashes.select(F.col(f"`{hashes.columns[0]}`").alias("k"))
    found = named.groupBy(F.expr(f"shiftrightunsigned(k, {64 - bits})").alias("w")).agg(F.bit_or(F.expr(_MASK)).alias("m")).toArrow()
    words = np.zeros(1 << bits, np.uint64)
    words[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) a filter has let in: all that are in it, and few others."""
    want = np.zeros(len(hashes), np.uint64)
    for at in (0, 6, 12, 18):
        want |= np.uint64(1) << ((hashes >> np.uint64(at)) & np.uint64(63))
    return words[(hashes >> np.uint64(65 - len(words).bit_length())).astype(np.int64)] & want == want


def key_filter(keys: DataFrame, n: int) -> Callable[[Column], Column]:
    """Of n keys (one column): an expression that is true of every one of them and of few other keys.

    With more keys than FILTER_BYTES are made for it passes more rows that needn't pass: callers decide again by exact
    keys, so results don't depend on it.
    """
    shared = keys.sparkSession.sparkContext.broadcast(filter_words(keys.select(F.xxhash64(F.col(f"`{keys.columns[0]}`"))), n))

    @F.pandas_udf("boolean")
    def may_be(hashes: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, hashes.to_numpy().view(np.uint64)))

    return lambda key: may_be(F.xxhash64(key))


def join_counted(rows: DataFrame, groups: DataFrame, key: list[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined (inner) with groups, which has one row a key and in `count` how many rows have that key.

    Rows of hot keys don't shuffle: those keys, rows / hot_rows of them at most, are broadcast. The others meet by key,
    hot_rows of them in a task at most for each key.
    """
    groups = cut(groups)
    hot = groups.where(F.col(count) > hot_rows)
    if hot.isEmpty():
        return rows.join(groups, key)
    kept = rows.join(F.broadcast(hot), key)  # at most rows / hot_rows keys
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.where(F.col(count) <= hot_rows), key)  # the same keys
    return kept.unionByName(rest)


def without(docs: DataFrame, id_: Column, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id is in gone (one column without repeats).

    Only rows that a filter of the ids lets through shuffle; all others pass at once.
    """
    gone = gone.select(F.col(f"`{gone.columns[0]}`").alias("__gone"))
    maybe = key_filter(gone, gone.count())
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), id_.alias("__id"), F.coalesce(maybe(id_), F.lit(False)).alias("__maybe"))
    stay = rows.where("NOT __maybe").select("__row")
    left = rows.where("__maybe").join(gone, F.col("__id") == F.col("__gone"), "left_anti").select("__row")
    return stay.unionByName(left).select(*[F.col("__row").getField(c).alias(c) for c in names])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, root), root being the least node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one aggregation and
    one join over the remaining edges, and their number grows with the logarithm of a component's size.
    Aggregations combine map-side; a node of very many edges is a skewed join, which adaptive execution splits.
    Self loops and repeated edges change nothing; nulls are dropped; no edges give no rows.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        e = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
