"""Reciprocal rank fusion, reranking, diversification, confidence and budgets.

Candidates have path, line_start, line_end, source, score, kind, symbol, content, token_est, in_degree,
out_degree, ref_count, is_generated and exact_symbol.
Operators that number rows do so for a page's candidates (a bounded number) in one window; for whole tables (whole=True)
by operators.order, which needs no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.functions import paths as P
from rootweave.functions import text as T
from rootweave.operators.order import numbered

RRF_K = 60
BUCKET_LINES = 40
PER_FILE = 3
USEFUL_TOKENS = 40
CANDIDATE = (
    "path string, line_start int, line_end int, source string, score double, kind string, symbol string, content string, "
    "token_est int, in_degree long, out_degree long, ref_count long, is_generated boolean, exact_symbol boolean"
)
_TIES = ("path", "line_start", "line_end")


def bucket(line: Column) -> Column:
    return F.floor((F.greatest(line, F.lit(1)) - 1) / BUCKET_LINES)


def weight_of(weights: dict[str, float], source: Column) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(source == name, float(w)).otherwise(out)
    return out


def ranks(candidates: DataFrame, whole: bool = False) -> DataFrame:
    """Candidates with their 0-based rank within their source."""
    order = F.desc("score"), *map(F.asc, _TIES), F.asc_nulls_first("symbol")
    if not whole:
        return candidates.withColumn("rank0", F.row_number().over(Window.partitionBy("source").orderBy(*order)) - 1)
    placed = numbered(candidates, "source", *order, name="place")
    first = placed.groupBy("source").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "source").withColumn("rank0", (F.col("place") - F.col("first")).cast("int")).drop("place", "first")  # one row a source


def place(df: DataFrame, *order: Column | str, whole: bool) -> DataFrame:
    """df with pos, its place (from 0) in the order."""
    if whole:
        return numbered(df, *order, name="pos").withColumn("pos", F.col("pos").cast("int"))
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(candidates: DataFrame, weights: dict[str, float], whole: bool = False) -> DataFrame:
    """One row for each (path, 40-line bucket): the sum of weight * k / (k + rank) over sources, each at its best rank.

    The representative is the richest source's candidate (symbol, then text or vector, then path); agreeing_sources
    counts the sources that listed the path at all. Sources without a weight take no part.
    """
    used = ranks(candidates, whole).withColumns({"w": weight_of(weights, F.col("source")), "bucket": bucket(F.col("line_start"))}).where("w > 0")
    agree = used.groupBy("path").agg(F.countDistinct("source").alias("agreeing_sources"))
    rich = F.when(F.col("source") == "symbol", 0).when(F.col("source").isin("fts", "vector"), 1).otherwise(2)
    turn = F.when(F.col("source") == "symbol", 0).when(F.col("source") == "path", 1).when(F.col("source") == "fts", 2).otherwise(3)
    own = [c for c in candidates.columns if c not in ("score", "path")]
    best = used.groupBy("source", "path", "bucket").agg(F.min("rank0").alias("rank0"), F.max("w").alias("w"), F.min_by(F.struct(*[c for c in own if c != "source"]), "rank0").alias("c")).select("source", "path", "bucket", "rank0", "w", "c.*")
    merged = best.groupBy("path", "bucket").agg(
        F.sum(F.col("w") * RRF_K / (RRF_K + F.col("rank0"))).alias("score"),
        F.min_by(F.struct(*own), F.struct(rich, turn, "rank0")).alias("r"),
    )
    return merged.join(agree, "path").select("path", *[F.col(f"r.{c}").alias(c) for c in own], "score", "agreeing_sources")


def bonus(query_terms: list[str], architecture: bool = False) -> tuple[Column, Column]:
    """The rerank bonus of a fused candidate and the reason for it."""
    terms = F.array(*[F.lit(t) for t in query_terms]) if query_terms else F.array().cast("array<string>")
    low = F.lower("path")
    in_path = F.exists(terms, lambda t: low.contains(t))
    degree, refs = F.coalesce("in_degree", F.lit(0)), F.coalesce("ref_count", F.lit(0))
    both = degree + F.coalesce("out_degree", F.lit(0))
    demoted = F.coalesce("is_generated", F.lit(False)) | (P.is_test(F.col("path")) & F.lit(not {"test", "tests"} & set(query_terms)))
    plus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    total = (
        plus((F.col("source") == "symbol") & F.col("kind").isin("class", "function", "interface", "method", "type"), 0.05)
        + plus(F.col("exact_symbol"), 0.20)
        + plus(F.array_contains(terms, F.lower("symbol")), 0.05)
        + plus(in_path, 0.05)
        + F.when(degree > 0, F.least(F.lit(0.08), F.log1p(degree) * 0.03)).when(refs > 0, F.least(F.lit(0.04), F.log1p(refs) * 0.015)).otherwise(0.0)
        - plus(demoted, 0.15)
    )
    if architecture:
        total = total + plus(both > 0, F.least(F.lit(0.08), F.log1p(both) * 0.015))
    folder = F.when(F.col("path").contains("/"), P.directory(F.col("path"))).otherwise(".")
    why = F.concat_ws(
        " · ",
        F.when(F.col("exact_symbol"), "exact symbol match"),
        F.when(in_path, F.concat(F.lit("in "), folder, F.lit("/"))),
        F.when(degree > 0, F.concat(degree.cast("string"), F.lit(" callers"))).when(refs > 0, F.concat(F.lit("~"), refs.cast("string"), F.lit(" refs by name"))),
        F.when(demoted, "generated/test demoted"),
    )
    return total, F.when(why == "", F.col("source")).otherwise(why)


def rerank(fused: DataFrame, query_terms: list[str], architecture: bool = False, whole: bool = False) -> DataFrame:
    """Fused candidates with their bonus added, the reason, and pos (0-based, by score)."""
    total, why = bonus(query_terms, architecture)
    scored = fused.withColumns({"score": F.col("score") + total, "reason": why})
    return place(scored, F.desc("score"), *_TIES, whole=whole)


def diversify(reranked: DataFrame, per_file: int = PER_FILE, whole: bool = False) -> DataFrame:
    """At most per_file rows of a file stay in front; its others follow after all files, in their order."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    marked = reranked.withColumn("late", nth > per_file).withColumnRenamed("pos", "was")
    return place(marked, "late", "was", whole=whole).drop("late", "was")


def confidence(ranked: DataFrame) -> DataFrame:
    """One row: high, medium or low, from the gap between the first two, agreement and exactness."""
    own = F.struct("score", F.coalesce("agreeing_sources", F.lit(1)).alias("agree"), F.coalesce("exact_symbol", F.lit(False)).alias("exact"))
    two = ranked.select("pos", own.alias("r")).orderBy("pos").limit(2).agg(F.min_by("r", "pos").alias("a"), F.max_by("r", "pos").alias("b"))
    one = ranked.agg(F.count("*").alias("n")).crossJoin(F.broadcast(two)).select("n", F.col("a.score").alias("s1"), F.col("b.score").alias("s2"), "a.agree", "a.exact")  # one row each
    gap = (F.col("s1") - F.col("s2")) / F.col("s1")
    agree = F.col("agree")
    level = (
        F.when((F.col("n") == 0) | (F.col("s1") <= 0), "low")
        .when(F.col("exact"), "high")
        .when(F.col("n") == 1, "medium")
        .when(((agree >= 3) & (gap > 0.15)) | ((agree >= 2) & (gap > 0.25)) | ((agree == 1) & (gap > 0.5)), "high")
        .when((agree >= 2) | (gap > 0.1) | (F.col("n") >= 5), "medium")
        .otherwise("low")
    )
    return one.select(level.alias("confidence"))


def confidence_of(first: float = 0.0, second: float | None = None, *, n: int, agree: int | None, exact: bool | None) -> str:
    """confidence() of a page's rows from the scores of the first two, their number, and the first one's agreement and exactness."""
    if not n or first <= 0:
        return "low"
    if exact:
        return "high"
    if n == 1:
        return "medium"
    gap, agree = (first - (second or 0)) / first, agree or 1
    if agree >= 3 and gap > 0.15 or agree >= 2 and gap > 0.25 or agree == 1 and gap > 0.5:
        return "high"
    return "medium" if agree >= 2 or gap > 0.1 or n >= 5 else "low"


def fits(costs: list[float | None], budget: float, spent: float = 0) -> tuple[list[bool], float]:
    """Of costs in order, whether each still fits (one that doesn't is skipped and the next is tried), and what is spent then."""
    out = []
    for c in costs:
        ok = c is not None and spent + c <= budget
        spent += c if ok else 0
        out.append(ok)
    return out, spent


def greedy_budget(costs: Column, budget: int) -> Column:
    """fits() of an array of costs, for the rows of a page."""

    @F.pandas_udf("array<boolean>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else fits([None if c is None or c != c else int(c) for c in a], budget)[0])

    return run(costs)


def within_budget(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """rows with fits, each group spending its own budget in its order.

    A group's rows stream through one task in sorted order and only what is spent is held, so a group of any size needs no memory.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spent = object(), 0
        for b in batches:
            out = []
            for g, c in zip(b.column(group).to_pylist(), b.column(cost).to_pylist()):
                if g != now:
                    now, spent = g, 0
                ok = c is not None and spent + c <= budget
                spent += c if ok else 0
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*names, "fits"])

    shape = rows.withColumn("fits", F.lit(True)).schema
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, shape)


def page(ranked: DataFrame, limit: int, offset: int = 0, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with has_more and next_offset). compat never reports more, as a list cut to the page can't."""
    rows = ranked.where((F.col("pos") >= offset) & (F.col("pos") < offset + limit))
    more = F.lit(False) if compat else F.coalesce(F.max(F.col("pos") >= offset + limit), F.lit(False))
    info = ranked.agg(more.alias("has_more")).select(F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "has_more", F.when(F.col("has_more"), offset + limit).alias("next_offset"))
    return rows, info
