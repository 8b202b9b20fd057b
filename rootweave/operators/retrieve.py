"""Symbol, path and vector retrievers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.functions import text as T


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def symbols_by_name(symbols: DataFrame, name: str, exact: bool = True, kind: str | None = None) -> DataFrame:
    """Definitions of a name, or of names that begin with it (ASCII case aside)."""
    found = symbols.where(F.col("name") == name if exact else F.lower("name").startswith(name.lower()))
    found = found.where(F.col("kind") == kind) if kind else found
    return found.orderBy("name", "path", "line_start")


def search_names(symbols: DataFrame, query: str, limit: int, kind: str | None = None, like_compat: bool = False) -> DataFrame:
    """Names that equal, begin with or contain the query (case aside), best first.

    like_compat takes _ and % of the query as wildcards.
    """
    name, q = F.lower("name"), query.lower()
    found = symbols.where(name.like(f"%{q}%") if like_compat else name.contains(q))
    found = found.where(F.col("kind") == kind) if kind else found
    marked = found.withColumns({"is_exact": name == q, "is_prefix": name.startswith(q)})
    return marked.orderBy(F.desc("is_exact"), F.desc("is_prefix"), F.desc("in_degree"), "path", "line_start", "name").limit(limit)


def name_score(name: Column, terms: list[str]) -> dict[str, Column]:
    """How well a name answers query terms: terms covered, share of its parts asked for, exactness, and the sum."""
    want = literals(terms)
    parts, low = T.subtoken_set(name), F.lower(name)
    covered = F.size(F.filter(want, lambda t: F.array_contains(parts, t) | low.contains(t)))
    tight = F.when(F.size(parts) > 0, F.size(F.array_intersect(parts, want)) / F.size(parts)).otherwise(0.0)
    exact = (low == "".join(terms)) | (low == "_".join(terms)) if len(terms) > 1 else low == (terms[0] if terms else "")
    return {"covered": covered, "tightness": tight, "is_exact": exact, "score": covered + tight + F.when(exact, 2.0).otherwise(0.0)}


def symbol_candidates(symbols: DataFrame, terms: list[str], limit: int, kind: str | None = None, per_term: int | None = None) -> DataFrame:
    """Symbols that contain some query term, ranked by cover, exactness, tightness and degree.

    One pass for all terms. per_term keeps each term's best rows before ranking.
    """
    low = F.lower("name")
    hit = F.exists(literals(terms), lambda t: low.contains(t))
    found = symbols.where(hit)
    found = found.where(F.col("kind") == kind) if kind else found
    if per_term:
        each = found.withColumn("__term", F.explode(F.filter(literals(terms), lambda t: low.contains(t))))
        order = Window.partitionBy("__term").orderBy(F.desc(low == F.col("__term")), F.desc(low.startswith(F.col("__term"))), F.desc("in_degree"), "path", "line_start", "name")
        found = each.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_term).drop("__term", "__n").dropDuplicates(["path", "line_start", "name"])
    scored = found.withColumns(name_score(F.col("name"), terms))
    return scored.orderBy(F.desc("covered"), F.desc("is_exact"), F.desc("tightness"), F.desc("in_degree"), F.length("name"), "path", "line_start", "name").limit(limit)


def path_candidates(files: DataFrame, tokens: list[str], limit: int, like_compat: bool = False) -> DataFrame:
    """Paths that contain some token: hits, then the shorter; the score decays with the rank."""
    low = F.lower("path")
    hits = sum((F.when(low.like(f"%{t.lower()}%") if like_compat else low.contains(t.lower()), 1).otherwise(0) for t in tokens), F.lit(0))
    best = files.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.length("path"), "path").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("hits"), F.length("path"), "path"))
    return best.withColumn("score", F.col("hits") / rank)


def files_by_suffix(files: DataFrame, suffix: str) -> DataFrame:
    """Files whose path is the suffix or ends with it at a part, the shortest first."""
    return files.where((F.col("path") == suffix) | F.col("path").endswith("/" + suffix)).orderBy(F.length("path"), "path")


def name_reference_counts(edges: DataFrame) -> DataFrame:
    return edges.where("dst_name IS NOT NULL").groupBy(F.col("dst_name").alias("name")).agg(F.count("*").alias("refs"))


def with_reference_counts(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with ref_count, counted by name where a symbol has no resolved callers."""
    refs = name_reference_counts(edges)
    return candidates.join(refs, "name", "left").withColumn("ref_count", F.when(F.col("in_degree") > 0, 0).otherwise(F.coalesce("refs", F.lit(0)))).drop("refs")


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest vectors to one query by L2 distance; the query is a literal, the top k is merged map-side."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", l2_distance(F.col(vector), q)).orderBy("distance", key).limit(k)


def vector_candidates(vectors: DataFrame, chunks: DataFrame, files: DataFrame, query: list[float] | None, limit: int) -> DataFrame | None:
    """Chunks near the query with score -distance; none without a query vector (a disabled backend or a blank query)."""
    if query is None:
        return None
    near = nearest(vectors, query, limit).select("chunk_id", (-F.col("distance")).alias("score"))
    return chunks.join(F.broadcast(near), "chunk_id").join(files.select("file_id", "path"), "file_id")  # limit rows
