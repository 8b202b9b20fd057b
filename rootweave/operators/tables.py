"""Table maintenance without in-place updates: upserts, cascades, fingerprints, freshness and embedding bookkeeping.

Every operator returns the next version of a table; a writer puts it in a new versioned folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """base with rows of the same key replaced by those of new."""
    return base.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def delete(base: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    return base.join(gone.select(*key).distinct(), list(key), "left_anti")


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, chunks and edges_raw without some files and all that belongs to them."""
    gone = tables["files"].join(paths.select("path").distinct(), "path", "left_semi").select("file_id")
    return {name: delete(t, gone, "file_id") if "file_id" in t.columns else t for name, t in tables.items()}


def replace_files(tables: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables where the files in fresh["files"] and all that belongs to them are taken from fresh."""
    changed = fresh["files"].select("file_id").distinct()
    return {name: delete(t, changed, "file_id").unionByName(fresh[name]) for name, t in tables.items()}


def fingerprint_diff(stored: DataFrame, current: DataFrame, check_all: bool = False) -> DataFrame:
    """(path, change) between stored and current fingerprints (path, mtime_ns, size_bytes, sha256), unchanged files left out.

    Equal time and size mean unchanged unless check_all; then equal hashes mean the file was only touched.
    """
    s = stored.select("path", *[F.col(c).alias(f"s_{c}") for c in ("mtime_ns", "size_bytes", "sha256")], F.lit(True).alias("in_s"))
    c = current.select("path", *[F.col(x).alias(f"c_{x}") for x in ("mtime_ns", "size_bytes", "sha256")], F.lit(True).alias("in_c"))
    both = s.join(c, "path", "full_outer")
    same_stat = F.lit(not check_all) & (F.col("s_mtime_ns").eqNullSafe(F.col("c_mtime_ns"))) & (F.col("s_size_bytes").eqNullSafe(F.col("c_size_bytes")))
    change = F.when(F.col("in_s").isNull(), "added").when(F.col("in_c").isNull(), "removed").when(same_stat, "unchanged").when(F.col("s_sha256").eqNullSafe(F.col("c_sha256")), "touched").otherwise("modified")
    return both.select("path", change.alias("change")).where("change <> 'unchanged'")


def freshness(diff: DataFrame) -> DataFrame:
    """One row (stale, files_changed_since_build): touched files don't count."""
    n = F.count_if(F.col("change") != "touched")
    return diff.agg(n.alias("files_changed_since_build")).select((F.col("files_changed_since_build") > 0).alias("stale"), "files_changed_since_build")


def update_counts(diff: DataFrame, current: DataFrame) -> DataFrame:
    """One row (indexed, skipped, deleted) of an incremental update."""
    d = diff.agg(F.count_if(F.col("change").isin("added", "modified")).alias("indexed"), F.count_if(F.col("change") == "removed").alias("deleted"))
    return current.agg(F.count("*").alias("n")).crossJoin(d).select("indexed", (F.col("n") - F.col("indexed")).alias("skipped"), "deleted")


def changed_paths(diffed: DataFrame, untracked: DataFrame) -> DataFrame:
    return diffed.select("path").union(untracked.select("path")).distinct()


def in_scope(files: DataFrame, scope: DataFrame) -> DataFrame:
    return files.join(scope.select("path").distinct(), "path", "left_semi")


def pending_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector, with the hash of their content."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").withColumn("content_sha", F.sha2("content", 256))


def cache_misses(pending: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct contents that the cache of this model lacks: only these are embedded."""
    known = cache.where(F.col("model") == model).select("content_sha")
    return pending.select("content_sha", "content").dropDuplicates(["content_sha"]).join(known, "content_sha", "left_anti")


def prune_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def embed(chunks: DataFrame, vectors: DataFrame, cache: DataFrame, backend: Column, model: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, cache) after an embedding pass; backend is an array<float> expression over content."""
    kept = prune_vectors(vectors, chunks)
    pending = pending_embeddings(chunks, kept)
    made = cache_misses(pending, cache, model).select(F.lit(model).alias("model"), "content_sha", backend.alias("embedding"))
    grown = cache.unionByName(made).dropDuplicates(["model", "content_sha"])
    filled = pending.select("chunk_id", "content_sha").join(grown.where(F.col("model") == model), "content_sha").select("chunk_id", "embedding")
    return kept.unionByName(filled), grown


def clear(table: DataFrame) -> DataFrame:
    """A table of the same columns without rows."""
    return table.limit(0)


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors (chunk_id, embedding) where those of new replace a chunk's."""
    return upsert(vectors, new.select(*vectors.columns), "chunk_id")


def append_chunks(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """chunks and further ones (of documents); nothing is deleted."""
    return chunks.unionByName(more)


def vector_meta(spark: SparkSession, model: str, dim: int, built_at: str) -> DataFrame:
    """The one row that says what the vectors are; it replaces the row before."""
    return spark.createDataFrame([(model, dim, built_at)], "model string, dim int, built_at string")


def language_coverage(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(lang, files, symbols) of parsed files, most files first; languages without symbols count 0."""
    joined = files.where("parser = 'treesitter'").join(symbols.select("file_id", "symbol_id"), "file_id", "left")
    return joined.groupBy("lang").agg(F.countDistinct("file_id").alias("files"), F.count("symbol_id").alias("symbols")).orderBy(F.desc("files"), "lang")


def findings(freshness_row: DataFrame, coverage: DataFrame, tiers: Column, least_files: int = 3) -> DataFrame:
    """Health checks as rows (id, ok, severity, detail): freshness, languages without any symbol, partial graphs."""
    fresh = freshness_row.select(F.lit("index_fresh").alias("id"), (~F.col("stale")).alias("ok"), F.lit("medium").alias("severity"), F.when(F.col("stale"), F.concat(F.col("files_changed_since_build").cast("string"), F.lit(" file(s) changed"))).otherwise("index is fresh").alias("detail"))
    dead = coverage.agg(F.array_sort(F.collect_set(F.when((F.col("files") >= least_files) & (F.col("symbols") == 0), F.col("lang")))).alias("x"), F.array_sort(F.collect_set(F.when(tiers == "partial", F.col("lang")))).alias("p"))
    extraction = dead.select(F.lit("symbol_extraction").alias("id"), (F.size("x") == 0).alias("ok"), F.lit("medium").alias("severity"), F.when(F.size("x") == 0, "all parsed languages give symbols").otherwise(F.concat(F.lit("no symbols for: "), F.array_join("x", ", "))).alias("detail"))
    graph = dead.select(F.lit("graph_coverage").alias("id"), F.lit(True).alias("ok"), F.lit("info").alias("severity"), F.when(F.size("p") == 0, "all languages have full graphs").otherwise(F.concat(F.lit("partial graphs for: "), F.array_join("p", ", "))).alias("detail"))
    return fresh.unionByName(extraction).unionByName(graph)


def modules(files: DataFrame, symbols: DataFrame, folder: Column) -> DataFrame:
    """(path, file_count, symbol_count) of each directory."""
    counts = symbols.groupBy("file_id").agg(F.count("*").alias("s"))
    return files.join(counts, "file_id", "left").groupBy(folder.alias("path")).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbol_count"))
