"""Building and updating a stored index of a file tree.

An index is a folder of versions (rootweave.storage): files, symbols (with degrees), chunks, edges_raw, edges, the full-text
postings of the chunks, and vectors where embeddings are on. meta.json beside them says when and from what it was made.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave import storage
from rootweave.config import Config, now
from rootweave.operators import communities, embedding, fulltext, graph, parse
from rootweave.operators import tables as M
from rootweave.sources import git, tree

SCHEMA_VERSION = 1
TABLES = ("files", "symbols", "chunks", "edges_raw", "edges", "postings", "corpus")
VECTORS = ("vectors", "vector_cache", "vector_meta")


def get_meta(folder: str, key: str | None = None) -> object:
    """A value of the index's meta data, or all of them; None (or an empty dict) where there are none."""
    values = json.loads(storage.read_text(folder, "meta.json") or "{}")
    return values if key is None else values.get(key)


def set_meta(folder: str, **values: object) -> None:
    storage.write_text(folder, "meta.json", json.dumps(get_meta(folder) | values, ensure_ascii=False, default=str))


def peek_schema_version(folder: str) -> int:
    """The schema version of an index, 0 where it can't be read."""
    try:
        return int(get_meta(folder, "schema_version") or 0)
    except (OSError, ValueError, TypeError):
        return 0


def guard(folder: str) -> int:
    """peek_schema_version(), or an error if a later library wrote the index. An older index can be read; a build makes it anew."""
    version = peek_schema_version(folder)
    if version > SCHEMA_VERSION:
        raise RuntimeError(f"the index has schema {version}, newer than {SCHEMA_VERSION}: build it again with this library or use a later one")
    return version


def opened(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The current version's tables."""
    guard(folder)
    names = TABLES + (VECTORS if get_meta(folder, "has_vectors") else ())
    return storage.open_version(spark, folder, names)


def scan(spark: SparkSession, config: Config, with_content: bool = True, only: DataFrame | None = None) -> DataFrame:
    patterns = tree.ignore_patterns(config.root, config.extra_ignore, tuple(config.ignore_files))
    found = tree.scan(spark, config.root, patterns, config.max_file_bytes, with_content, only)
    return found if config.languages == "auto" else found.where(F.col("lang").isin(*config.languages))


def _derived(tables: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """The tables that follow from files, symbols, chunks and edges_raw: resolution and degrees, and the full text."""
    bare = tables["symbols"].drop("in_degree", "out_degree")
    edges = storage.stored(graph.resolve(tables["edges_raw"], bare, tables["files"]))
    symbols = bare.join(graph.degrees(bare, edges), "symbol_id")
    tokens = fulltext.tokenised(tables["chunks"], "chunk_id", F.concat_ws(" ", "content", "symbol_names"))
    return {**tables, "symbols": symbols, "edges": edges, "postings": fulltext.laid_out(tokens), "corpus": fulltext.corpus_stats(fulltext.doc_stats(tokens))}


def _vectors(spark: SparkSession, chunks: DataFrame, old: dict[str, DataFrame], backend: embedding.Backend) -> tuple[dict[str, DataFrame], int]:
    """The tables of vectors, and how many texts had to be embedded: only those without a vector of this model anywhere."""
    vectors = old.get("vectors", spark.createDataFrame([], "chunk_id long, embedding array<float>"))
    cache = old.get("vector_cache", spark.createDataFrame([], "model string, content_sha string, embedding array<float>"))
    if "vector_meta" in old and old["vector_meta"].first()["model"] != backend.name:
        vectors = M.clear(vectors)
    vectors, grown = M.embed(chunks, vectors, cache, embedding.embedded(backend, F.col("content")), backend.name)
    grown = storage.stored(grown)
    made = grown.count() - cache.count()
    vectors = storage.stored(vectors)
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return {"vectors": vectors, "vector_cache": grown, "vector_meta": M.vector_meta(spark, backend.name, dim, now())}, made


def _finish(spark: SparkSession, folder: str, config: Config, tables: dict[str, DataFrame], old: dict[str, DataFrame], backend: embedding.Backend | None, when: dict[str, object]) -> dict[str, int]:
    """Writes a version and its meta data; gives edges_resolved and vectors."""
    full, made = _derived(tables, config), 0
    backend = backend or embedding.backend_of(config)
    if backend.enabled:
        more, made = _vectors(spark, tables["chunks"], old, backend)
        full |= more
    storage.write_version(folder, full)
    set_meta(folder, schema_version=SCHEMA_VERSION, config_hash=config.digest(), head_commit=git.head(config.root), has_vectors=backend.enabled, **when)
    now_ = opened(spark, folder)
    try:
        set_meta(folder, analysis=analysis(now_))
    except Exception as e:  # noqa: BLE001  an index without analysis is still an index
        set_meta(folder, analysis=None, analysis_error=str(e)[:500])
    return {"edges_resolved": now_["edges"].where("resolved").count(), "vectors": made}


def analysis(tables: dict[str, DataFrame]) -> dict:
    """The architecture summary of an index's graph."""
    nodes = graph.nodes(tables["files"], tables["symbols"])
    key = lambda p: nodes.select(F.col("kind").alias(f"{p}_kind"), F.col("id").alias(f"{p}_id"), F.col("key").alias({"src": "a", "dst": "b"}[p]))
    ends = tables["edges"].where("resolved").join(key("src"), ["src_kind", "src_id"]).join(key("dst"), ["dst_kind", "dst_id"])
    return communities.summary(ends.select("a", "b"), nodes)


def _parsed(files: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    parsed = storage.stored(parse.parse(files))
    return parsed, {"files": files.drop("content"), **parse.tables(parsed)}


def build(spark: SparkSession, folder: str, config: Config, backend: embedding.Backend | None = None) -> dict[str, int]:
    """Indexes the whole root as the next version; gives the totals of parse.build_stats(), deleted, edges_resolved and vectors."""
    files = storage.stored(scan(spark, config))
    old = opened(spark, folder) if storage.current_version(folder) and guard(folder) == SCHEMA_VERSION else {}
    parsed, tables = _parsed(files)
    stats = parse.build_stats(files, parsed).first().asDict()
    gone = old["files"].join(files.select("path"), "path", "left_anti").count() if old else 0
    return stats | {"deleted": gone} | _finish(spark, folder, config, tables, old, backend, {"built_at": now()})


def changes(spark: SparkSession, folder: str, config: Config, check_all: bool = False, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(differences (path, change), the files found, those of them that were read with their content).

    Only files whose time or size differs are read, all of them with check_all. A scope (path) leaves the other paths as they are.
    """
    known = opened(spark, folder)["files"]
    found = scan(spark, config, with_content=False)  # of the driver's listing
    seen, held = (found, known) if scope is None else (M.in_scope(found, scope), M.in_scope(known, scope))
    same = ["path", "mtime_ns", "size_bytes"]
    suspect = seen.select(*same) if check_all else seen.select(*same).join(held.select(*same), same, "left_anti")
    opened_ = scan(spark, config, only=suspect.select("path"))
    opened_ = opened_.limit(0) if suspect.isEmpty() else storage.stored(opened_)
    print_ = ["path", "mtime_ns", "size_bytes", "sha256"]
    untouched = held.select(*print_).join(suspect, "path", "left_anti").join(seen.select("path"), "path", "left_semi")
    return M.fingerprint_diff(held.select(*print_), opened_.select(*print_).unionByName(untouched), check_all), found, opened_


def update(spark: SparkSession, folder: str, config: Config, since: str | None = None, check_all: bool = False, backend: embedding.Backend | None = None) -> dict[str, int]:
    """Brings the index up to date: only added and modified files are parsed; gives indexed, skipped, deleted, edges_resolved and vectors.

    since limits it to the paths that git says changed from that revision on.
    """
    old = opened(spark, folder)
    scope = spark.createDataFrame([(p,) for p in sorted(git.changed_since(config.root, git.check_ref(since)))], "path string") if since else None
    diff, found, read = changes(spark, folder, config, check_all, scope)
    diff = storage.stored(diff)
    stats = M.update_counts(diff, found).first().asDict()
    when = {"updated_at": now(), "built_at": get_meta(folder, "built_at") or now()}
    touched = diff.where("change = 'touched'").select("path")
    times = found.join(touched, "path", "left_semi").select("path", F.col("mtime_ns").alias("t"), F.col("size_bytes").alias("s"))
    files = old["files"].join(times, "path", "left").withColumns({"mtime_ns": F.coalesce("t", "mtime_ns"), "size_bytes": F.coalesce("s", "size_bytes")}).select(*old["files"].columns)
    base = {n: old[n] for n in ("symbols", "chunks", "edges_raw")} | {"files": files}
    if not stats["indexed"] and not stats["deleted"]:
        if not touched.isEmpty():
            storage.write_version(folder, {**old, "files": files})
        set_meta(folder, config_hash=config.digest(), head_commit=git.head(config.root), **when)
        return stats | {"edges_resolved": 0, "vectors": 0}
    fresh = read.join(diff.where("change IN ('added', 'modified')"), "path", "left_semi")
    _, new = _parsed(fresh)
    base["symbols"] = base["symbols"].drop("in_degree", "out_degree")
    kept = M.delete_files(base, diff.where("change = 'removed'").select("path"))
    return stats | _finish(spark, folder, config, M.replace_files(kept, new), old, backend, when)


def freshness(spark: SparkSession, folder: str, config: Config) -> dict:
    """The index block of a payload: exists, stale, files_changed_since_build, built_at and head_commit.

    A tree that git calls clean at the indexed commit is fresh without a look at its files.
    """
    if not storage.current_version(folder):
        return {"exists": False, "stale": False, "files_changed_since_build": 0, "built_at": None, "head_commit": None}
    meta = get_meta(folder)
    n = 0
    if not git.is_clean_at(config.root, meta.get("head_commit")):
        n = M.freshness(changes(spark, folder, config)[0]).first()["files_changed_since_build"]
    return {"exists": True, "stale": n > 0, "files_changed_since_build": n, "built_at": meta.get("built_at"), "head_commit": meta.get("head_commit")}


