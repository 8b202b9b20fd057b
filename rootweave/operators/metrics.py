"""Retrieval quality and economy: recall, reciprocal rank, nDCG, token savings and line-range unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query, recall, rr, ndcg) at k. ranked has query, item and rank from 1; relevant has query and item.

    Recall here is a hit: whether some relevant item is among the first k. Queries without results score 0.
    """
    truth = relevant.select("query", "item").distinct()
    first = ranked.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    hit = truth.join(first, ["query", "item"], "left")
    at = F.when(F.col("rank") <= k, F.col("rank"))
    gain = F.sum(F.when(at.isNotNull(), 1 / F.log2(at + 1.0)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.count("*"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return hit.groupBy("query").agg(F.coalesce(F.max((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"), (gain / ideal).alias("ndcg"))


def means(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.count("*").alias("queries"))


def token_economy(costs: DataFrame) -> DataFrame:
    """One row (indexed_avg, baseline_avg, saved_avg, ratio) of costs per query (indexed, baseline)."""
    a, b = F.avg("indexed"), F.avg("baseline")
    return costs.agg(a.alias("indexed_avg"), b.alias("baseline_avg"), (b - a).alias("saved_avg"), (b / F.greatest(a, F.lit(1.0))).alias("ratio"))


def merge_ranges(ranges: DataFrame, *key: str) -> DataFrame:
    """Overlapping or adjacent line ranges (begin, end inclusive) of a key, merged."""
    own = Window.partitionBy(*key).orderBy("begin", "end")
    upto = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(F.col("begin") <= upto + 1, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def innermost(ranges: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Points (key, point_id, at) with the narrowest range (range_id, begin, end) around them; ties go to the earlier begin, then id.

    Ranges meet points in buckets of the power of two above their length: a range is in two at most, and a point in one of each
    length that its key has, so that pairs are compared in number like those found and never a key's whole product.
    """
    span = (F.col("end") - F.col("begin") + 1).cast("double")
    sized = ranges.where(F.col("end") >= F.col("begin")).withColumn("__size", F.pow(F.lit(2.0), F.ceil(F.log2(span))))
    bucket = lambda x: F.floor(F.col(x) / F.col("__size")).cast("long")
    placed = sized.withColumn("__bucket", F.explode(F.sequence(bucket("begin"), bucket("end"))))
    asked = points.join(sized.select(key, "__size").distinct(), key).withColumn("__bucket", bucket("at"))
    around = asked.join(placed, [key, "__size", "__bucket"]).where(F.col("at").between(F.col("begin"), F.col("end")))
    return around.groupBy(key, "point_id").agg(F.min_by("range_id", F.struct(F.col("end") - F.col("begin"), "begin", "range_id")).alias("range_id"))
