"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Three passes, each over what the one before left undecided. The first counts lengths (combined map-side to
one row a length), the second 8-byte prefix hashes of texts whose length repeats, and only texts whose
length and prefix both repeat are read whole for SHA-256. What repeats travels to the next pass as a key filter of
bounded size: a key too many only costs a hash, as the last pass decides by full hashes. groups() never shuffles a
text: ids and hashes alone travel, each hash's copies are counted map-side first, and hashes of more than HOT_ROWS
copies are broadcast instead of shuffled. dedup() moves the rows of repeated texts once; each task drops all but
one copy of a text before.

Cases. A null text equals nothing and its row is never grouped. Empty texts equal each other.
Repeated rows are copies like any others: of rows that agree in id and text one is kept. A null id
takes part and is kept only if its group has no other id. The kept row is the one of the least id;
among rows of that id the one whose other columns have the least hash (columns of maps aside). Ids may be of any
type that has an order. An empty table gives no rows. Other columns, whatever their names, are ignored by groups()
and passed through by dedup().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from rootweave.llm.common import HOT_ROWS, cut, join_counted, key_filter, stored

PREFIX_CHARS = 64


def _key(text: Column, prefix_chars: int) -> Column:
    return F.xxhash64(F.octet_length(text), F.substring(text, 1, prefix_chars))


def maybe_repeated(docs: DataFrame, text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> Callable[[Column], Column]:
    """An expression over texts: true of every text whose length and prefix another text has, null of a null text, false of most others."""
    text = F.col(f"`{text_col}`")
    one = docs.where(text.isNotNull()).select(F.octet_length(text).cast("long").alias("k"))
    lengths = cut(one.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    has_length = key_filter(lengths, lengths.count())
    two = docs.where(text.isNotNull()).where(has_length(F.octet_length(text).cast("long"))).select(_key(text, prefix_chars).alias("k"))
    keys = cut(two.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))
    has_key = key_filter(keys, keys.count())
    return lambda t: F.when(t.isNotNull(), has_key(_key(t, prefix_chars)))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row that has an exact copy: (doc_id, group_id, is_kept); group_id is the least id of its group."""
    docs = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    maybe = maybe_repeated(docs, "__text", prefix_chars)
    hashed = docs.where(maybe(F.col("__text"))).select("__id", F.unhex(F.sha2("__text", 256)).alias("__hash"), F.monotonically_increasing_id().alias("__tag"))
    hashed = stored(hashed)  # each row's tag is fixed from here on
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__tag").alias("tag"))).alias("__first")
    same = hashed.groupBy("__hash").agg(F.count("*").alias("__n"), first).where("__n > 1")
    joined = join_counted(hashed, same, ["__hash"], "__n", hot_rows)
    return joined.select(F.col("__id").alias("doc_id"), F.col("__first.id").alias("group_id"), (F.col("__tag") == F.col("__first.tag")).alias("is_kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs with one row of each group of equal texts; its columns are unchanged."""
    names = docs.columns
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    maybe = maybe_repeated(body.select("__text"), "__text", prefix_chars)
    marked = body.withColumn("__maybe", F.coalesce(maybe(F.col("__text")), F.lit(False)))
    others = F.xxhash64(*[F.col("__row").getField(f.name) for f in docs.schema if not isinstance(f.dataType, MapType)])
    first = Window.partitionBy(F.sha2("__text", 256)).orderBy(F.asc_nulls_last("__id"), others)
    kept = marked.where("__maybe").withColumn("__rank", F.row_number().over(first)).where("__rank = 1").select("__row")
    return marked.where("NOT __maybe").select("__row").unionByName(kept).select(*[F.col("__row").getField(c).alias(c) for c in names])
