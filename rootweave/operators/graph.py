"""Relationship-graph operators: resolution, degrees, walks, shortest paths and node cards.

Nodes are keyed (kind, id) with kind file or symbol. Raw edges have edge_type, src_kind, src_id, file_id,
dst_name and line; resolution is a pure function of raw edges, symbols and files, so nothing goes stale
when files are indexed again. Walks join one frontier a level and cut their lineage in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.functions import paths as P
from rootweave.storage import cut

#: A frontier of a walk is broadcast up to this size.
FRONTIER_BYTES = 16 << 20
RESOLVABLE = ("call", "reference", "extends", "implements")
#: Suffixes of files that a module name may stand for, by language, then for any.
OWN_SUFFIXES = {
    "python": ["{b}.py", "{b}/__init__.py"],
    "typescript": ["{b}.ts", "{b}.tsx", "{b}/index.ts", "{b}/index.tsx"],
    "javascript": ["{b}.js", "{b}/index.js"],
    "java": ["{b}.java"],
    "kotlin": ["{b}.kt"],
    "go": ["{last}.go"],
    "rust": ["{r}.rs", "{r}/mod.rs", "src/{r}.rs", "src/{r}/mod.rs"],
    "csharp": ["{b}.cs"],
    "ruby": ["{b}.rb"],
    "php": ["{b}.php"],
}
ANY_SUFFIXES = [
    *("{b}" + s for s in ".py /__init__.py .ts .tsx .js /index.ts /index.tsx /index.js .java .kt .scala .go".split()),
    *("{r}" + s for s in (".rs", "/mod.rs")),
    *("src/{r}" + s for s in (".rs", "/mod.rs")),
    *("{b}" + s for s in (".cs", ".rb", ".php")),
]


def unique_names(symbols: DataFrame) -> DataFrame:
    """Names that exactly one symbol has, with its id."""
    return symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").select("name", "symbol_id")


def unique_suffixes(files: DataFrame) -> DataFrame:
    """Path suffixes (from a part on, lower-cased) that exactly one file has, with its id."""
    each = files.select("file_id", F.explode(P.depth_suffixes(F.col("path"))).alias("suffix"))
    return each.groupBy("suffix").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id")).where("n = 1").select("suffix", "file_id")


def last_in_file(symbols: DataFrame) -> DataFrame:
    """(file_id, dst_name, own_id): of the symbols of one name in a file the last definition."""
    last = Window.partitionBy("file_id", "name").orderBy(F.desc("line_start"), F.desc("symbol_id"))
    return symbols.withColumn("n", F.row_number().over(last)).where("n = 1").select(F.col("file_id"), F.col("name").alias("dst_name"), F.col("symbol_id").alias("own_id"))


def module_suffixes(module: Column, lang: Column) -> Column:
    """The path suffixes that a module name may stand for, most likely first."""
    trimmed = F.lower(F.btrim(module))
    dotted = F.btrim(F.regexp_replace(trimmed, r"\.", "/"), F.lit("/"))
    scoped = F.btrim(F.regexp_replace(trimmed, "::", "/"), F.lit("/"))
    last = F.element_at(F.split(dotted, "/"), -1)

    def filled(shape: str) -> Column:
        head, _, rest = shape.partition("{")
        key, _, tail = rest.partition("}")
        return F.concat(F.lit(head), {"b": dotted, "r": scoped, "last": last}[key], F.lit(tail))

    own = F.array().cast("array<string>")
    for name, shapes in OWN_SUFFIXES.items():
        own = F.when(lang == name, F.array(*[filled(s) for s in shapes])).otherwise(own)
    return F.array_distinct(F.concat(own, F.array(*[filled(s) for s in ANY_SUFFIXES])))


def resolve(edges_raw: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """All edges with dst_kind, dst_id, resolved and confidence.

    A name of the edge's own file or a name unique among all symbols gives an extracted edge, an import whose
    module names exactly one file an inferred one; what is left is ambiguous. Each (type, file, name) that edges ask for is
    resolved once, and the edges meet the answers by one shuffle and a hash table: they are read twice and never sorted.
    """
    asked = edges_raw.select("edge_type", "file_id", "dst_name").distinct()
    own = asked.join(last_in_file(symbols), ["file_id", "dst_name"], "left")
    named = own.join(unique_names(symbols).select(F.col("name").alias("dst_name"), F.col("symbol_id").alias("unique_id")), "dst_name", "left")
    langs = files.select("file_id", "lang")
    imports = asked.where("edge_type = 'import' AND dst_name IS NOT NULL").join(langs, "file_id").select("dst_name", "lang").distinct()
    tried = imports.select("dst_name", "lang", F.posexplode(module_suffixes(F.col("dst_name"), F.col("lang"))).alias("turn", "suffix"))
    modules = tried.join(unique_suffixes(files).withColumnRenamed("file_id", "module_id"), "suffix").groupBy("dst_name", "lang").agg(F.min_by("module_id", "turn").alias("module_id"))
    found = named.join(langs, "file_id", "left").join(modules, ["dst_name", "lang"], "left")
    symbol = F.coalesce("own_id", F.when(F.col("edge_type").isin(*RESOLVABLE), F.col("unique_id")))
    module = F.when(symbol.isNull() & (F.col("edge_type") == "import"), F.col("module_id"))
    target = found.select("edge_type", "file_id", "dst_name", symbol.alias("symbol"), module.alias("module")).where("symbol IS NOT NULL OR module IS NOT NULL")
    symbol, module = F.col("symbol"), F.col("module")
    e, t = edges_raw.alias("e"), target.hint("shuffle_hash").alias("t")
    same = (F.col("e.edge_type") == F.col("t.edge_type")) & (F.col("e.dst_name") == F.col("t.dst_name")) & F.col("e.file_id").eqNullSafe(F.col("t.file_id"))
    return e.join(t, same, "left").select(
        "e.edge_type", "src_kind", "src_id",
        F.when(symbol.isNotNull(), "symbol").when(module.isNotNull(), "file").alias("dst_kind"),
        F.coalesce(symbol, module).alias("dst_id"), "e.dst_name", "e.file_id", "line",
        (symbol.isNotNull() | module.isNotNull()).alias("resolved"),
        F.when(symbol.isNotNull(), "extracted").when(module.isNotNull(), "inferred").otherwise("ambiguous").alias("confidence"),
    )


def node_key() -> Column:
    """A node's key from its kind, path, name and line_start, which survives indexing again."""
    return F.when(F.col("kind") == "file", F.concat(F.lit("file::"), "path")).otherwise(F.concat_ws("::", F.lit("symbol"), "path", "name", F.col("line_start").cast("string")))


def nodes(files: DataFrame, symbols: DataFrame, key: Callable[[], Column] = node_key) -> DataFrame:
    """All graph nodes: kind, id, path, name, line_start, symbol_kind and the key that `key` makes of these."""
    f = files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "path", P.file_name(F.col("path")).alias("name"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("string").alias("symbol_kind"))
    s = symbols.select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), "path", "name", F.col("line_start").cast("int"), F.col("kind").alias("symbol_kind"))
    return f.unionByName(s).withColumn("key", key())


def degrees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, in_degree and out_degree over resolved edges, 0 where there are none: edges count both ends in one pass."""
    end = lambda way: F.when(F.col(f"{way}_kind") == "symbol", F.col(f"{way}_id"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = F.array(F.struct(end("dst").alias("symbol_id"), one.alias("i"), zero.alias("o")), F.struct(end("src").alias("symbol_id"), zero.alias("i"), one.alias("o")))
    ends = edges.where("resolved").select(F.inline(both)).where("symbol_id IS NOT NULL")
    count = ends.groupBy("symbol_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return symbols.select("symbol_id").join(count, "symbol_id", "left").select("symbol_id", F.coalesce("i", zero).alias("in_degree"), F.coalesce("o", zero).alias("out_degree"))


def seeds(target: str, files: DataFrame, symbols: DataFrame, with_symbols: bool = True) -> DataFrame:
    """The nodes that a target names: a file by its path, else symbols by name, else the one file with that suffix.

    with_symbols adds a file's symbols to it.
    """
    exact = files.where(F.col("path") == target).select("file_id", F.lit(0).alias("turn"))
    by_suffix = files.where(F.col("path").endswith("/" + target)).agg(F.count("*").alias("n"), F.min("file_id").alias("file_id")).where("n = 1").select("file_id", F.lit(2).alias("turn"))
    chosen = exact.unionByName(by_suffix)
    as_files = chosen.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "turn")
    named = symbols.where(F.col("name") == target).select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), F.lit(1).alias("turn"))
    found = as_files.unionByName(named)
    if with_symbols:
        found = found.unionByName(symbols.join(chosen, "file_id").select(F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id"), "turn"))
    best = found.agg(F.min("turn").alias("turn"))
    return found.join(F.broadcast(best), "turn", "left_semi").select("kind", "id").distinct()  # one row


def arcs(edges: DataFrame, direction: str) -> DataFrame:
    """Resolved edges as steps (kind, id) -> (next_kind, next_id): up goes to what depends, down to what is used; edges are read once."""
    step = lambda a, b, way: F.struct(F.col(f"{a}_kind").alias("kind"), F.col(f"{a}_id").alias("id"), F.col(f"{b}_kind").alias("next_kind"), F.col(f"{b}_id").alias("next_id"), F.lit(way).alias("way"))
    up, down = step("dst", "src", "in"), step("src", "dst", "out")
    one = {"up": [up], "down": [down], "both": [up, down]}[direction]
    return edges.where("resolved").select("edge_type", "confidence", F.inline(F.array(*one)))


def walk(edges: DataFrame, start: DataFrame, depth: int, direction: str = "up", origin: list[str] | None = None) -> DataFrame:
    """Nodes within depth steps of the start nodes: origin columns, kind, id, distance, via_edge, via_confidence.

    Start nodes are excluded. One walk serves any number of origins at once; of several ways to first reach a
    node the least (edge type, confidence, previous node) is reported. A frontier is counted: a small one is broadcast, so
    that edges stay where they are; a large one meets them by a shuffle.
    """
    if direction not in ("up", "down", "both"):
        raise ValueError(f"direction must be up, down or both, not {direction}")
    if depth < 1:
        raise ValueError("depth must be 1 at least")
    origin = origin or []
    step = arcs(edges, direction)
    key = [*origin, "kind", "id"]
    first = cut(start.select(*key).distinct().withColumns({"distance": F.lit(0), "via_edge": F.lit(None).cast("string"), "via_confidence": F.lit(None).cast("string")}))
    frontier, seen, levels = first, first.select(*key), []
    for level in range(1, depth + 1):
        n = frontier.count()
        if not n:
            break
        reached = step.join(small(frontier.select(*key), n), ["kind", "id"]).groupBy(*origin, F.col("next_kind").alias("kind2"), F.col("next_id").alias("id2"), "edge_type", "confidence", "kind").agg(F.min("id").alias("id"))  # few of a node, found by hash tables
        new = reached.groupBy(*origin, "kind2", "id2").agg(F.min(F.struct("edge_type", "confidence", "kind", "id")).alias("via")).select(*origin, F.col("kind2").alias("kind"), F.col("id2").alias("id"), F.lit(level).alias("distance"), F.col("via.edge_type").alias("via_edge"), F.col("via.confidence").alias("via_confidence"))
        frontier = cut(new.join(seen, key, "left_anti"))
        seen = seen.unionByName(frontier.select(*key))
        levels.append(frontier)
    out = first.limit(0)
    for more in levels:
        out = out.unionByName(more)
    return out


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """df, marked for broadcast if its counted rows are under FRONTIER_BYTES."""
    return F.broadcast(df) if rows * row_bytes <= FRONTIER_BYTES else df


def impact_response(target: str, edges: DataFrame, files: DataFrame, symbols: DataFrame, depth: int = 2, direction: str = "up") -> dict[str, DataFrame]:
    """nodes and files of impact(), and the coverage (one row) of the target's and the affected files."""
    found, affected = impact(target, edges, files, symbols, depth, direction)
    own = seeds(target, files, symbols).join(nodes(files, symbols), ["kind", "id"]).select("path")
    return {"nodes": found, "files": affected, "coverage": coverage(own.unionByName(affected.select("path")), files)}


def impact(target: str, edges: DataFrame, files: DataFrame, symbols: DataFrame, depth: int = 2, direction: str = "up") -> tuple[DataFrame, DataFrame]:
    """(nodes, files) affected by a change of the target: nodes in order of distance, files by their least distance."""
    found = walk(edges, seeds(target, files, symbols), depth, direction).join(nodes(files, symbols), ["kind", "id"])
    ordered = found.select("kind", "path", "name", "line_start", "distance", "via_edge", "via_confidence").orderBy("distance", "path", "line_start", "name")
    return ordered, found.groupBy("path").agg(F.min("distance").alias("distance")).orderBy("distance", "path")


class DiffImpact(NamedTuple):
    """affected (path, distance, changed_by, via_edge, via_confidence), unresolved (path) and one row of totals:
    changed_files_total, changed_files, truncated, and the partial, languages and reason of coverage."""

    affected: DataFrame
    unresolved: DataFrame
    summary: DataFrame


def diff_impact(changed: DataFrame, edges: DataFrame, files: DataFrame, symbols: DataFrame, max_files: int | None = 200, direction: str = "up", depth: int = 2) -> DiffImpact:
    """What a set of changed paths (path) affects, as one walk with an origin.

    A changed path's own file and symbols are no result of its walk, but other changed paths may affect it. Of more than
    max_files paths the first are walked and the summary says truncated; None walks all.
    """
    if max_files is not None and max_files < 1:
        raise ValueError("max_files must be 1 at least")
    every = changed.select("path").distinct()
    paths = every if max_files is None else every.orderBy("path").limit(max_files)
    known = paths.join(files.select("file_id", "path"), "path")
    start = known.select(F.col("path").alias("origin"), F.lit("file").alias("kind"), F.col("file_id").alias("id")).unionByName(known.join(symbols.select("symbol_id", "file_id"), "file_id").select(F.col("path").alias("origin"), F.lit("symbol").alias("kind"), F.col("symbol_id").alias("id")))
    hit = walk(edges, start, depth, direction, ["origin"]).join(nodes(files, symbols).select("kind", "id", "path"), ["kind", "id"])
    each = hit.groupBy("path", "origin", "via_edge", "via_confidence").agg(F.min("distance").alias("distance"))  # few of a path, found by hash tables
    grouped = each.groupBy("path").agg(F.min("distance").alias("distance"), F.array_sort(F.collect_set("origin")).alias("changed_by"), F.min(F.struct("distance", "origin", "via_edge", "via_confidence")).alias("via"))
    affected = grouped.select("path", "distance", "changed_by", "via.via_edge", "via.via_confidence").orderBy("distance", "path")
    counted = every.agg(F.count("*").alias("changed_files_total"))
    walked = F.col("changed_files_total") if max_files is None else F.least(F.col("changed_files_total"), F.lit(max_files))
    summary = counted.withColumn("changed_files", walked).withColumn("truncated", F.col("changed_files") < F.col("changed_files_total"))
    covered = coverage(known.select("path").unionByName(hit.select("path")), files)
    return DiffImpact(affected, paths.join(files, "path", "left_anti").orderBy("path"), summary.crossJoin(F.broadcast(covered)))  # one row each


def shortest_path(edges: DataFrame, src: DataFrame, dst: DataFrame, max_hops: int | None = None) -> DataFrame:
    """One row (src_kind, src_id, hops, steps) of a shortest undirected path from a src to a dst node, or none.

    Levels grow from all src nodes together and stop at the first that meets a dst. A node keeps its
    predecessor alone (of several the least by edge type, confidence, way and node), and the path is read
    backwards from the least dst, one key a level. Without max_hops it ends when no node is new.
    """
    spark, step = edges.sparkSession, arcs(edges, "both")
    back = "prev_kind string, prev_id long, edge_type string, confidence string, way string"
    frontier = cut(src.select("kind", "id").distinct().withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in back.split(", ")}))
    seen, levels, goal = frontier.select("kind", "id"), [frontier], dst.select("kind", "id").distinct()
    shape = "src_kind string, src_id long, hops int, steps array<struct<next_kind:string,next_id:long,edge_type:string,confidence:string,way:string>>"
    while True:
        met = frontier.join(goal, ["kind", "id"]).orderBy("kind", "id").first()
        n = 0 if met else frontier.count()
        if met or not n or len(levels) - 1 == max_hops:
            break
        further = step.join(small(frontier.select("kind", "id"), n), ["kind", "id"])
        least = further.groupBy(F.col("next_kind").alias("k"), F.col("next_id").alias("i"), "edge_type", "confidence", "way", "kind").agg(F.min("id").alias("id"))  # few of a node, found by hash tables
        best = least.groupBy("k", "i").agg(F.min(F.struct("edge_type", "confidence", "way", "kind", "id")).alias("m"))
        new = best.select(F.col("k").alias("kind"), F.col("i").alias("id"), F.col("m.kind").alias("prev_kind"), F.col("m.id").alias("prev_id"), "m.edge_type", "m.confidence", "m.way")
        frontier = cut(new.join(seen, ["kind", "id"], "left_anti"))
        seen = seen.unionByName(frontier.select("kind", "id"))
        levels.append(frontier)
    if not met:
        return spark.createDataFrame([], shape)
    at, steps = met, []
    for level in reversed(levels[:-1]):
        steps.append((at["kind"], at["id"], at["edge_type"], at["confidence"], at["way"]))
        at = level.where((F.col("kind") == at["prev_kind"]) & (F.col("id") == at["prev_id"])).first()
    return spark.createDataFrame([(at["kind"], at["id"], len(steps), steps[::-1])], shape)


def references(name: str, edges: DataFrame, files: DataFrame, symbols: DataFrame, kind: str = "all") -> DataFrame:
    """Call sites of a name, resolved or not, and (for kind all) its definitions: path, line, kind, confidence."""
    calls = edges.where((F.col("edge_type") == "call") & (F.col("dst_name") == name)).join(files.select("file_id", "path"), "file_id").select("path", F.col("line").cast("int").alias("line"), F.lit("call").alias("kind"), "confidence")
    if kind != "all":
        return calls.orderBy("path", "line", "kind")
    own = symbols.where(F.col("name") == name).select("path", F.col("line_start").cast("int").alias("line"), F.lit("definition").alias("kind"), F.lit("extracted").alias("confidence"))
    return calls.unionByName(own).orderBy("path", "line", "kind")


def node_card(name: str, edges: DataFrame, files: DataFrame, symbols: DataFrame, gods: DataFrame | None = None) -> dict[str, DataFrame]:
    """A symbol's definitions, its most connected one (primary), the callers of its name and the primary's callees."""
    defs = symbols.where(F.col("name") == name).join(degrees(symbols, edges), "symbol_id")
    primary = defs.orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "path", "line_start").limit(1).withColumn("module", P.directory(F.col("path")))
    if gods is not None:
        place = gods.withColumn("god_rank", F.row_number().over(Window.orderBy(F.desc("degree"), "key"))).groupBy(F.col("name").alias("g_name"), F.col("path").alias("g_path")).agg(F.min("god_rank").alias("god_rank"))
        primary = primary.join(F.broadcast(place), (F.col("name") == F.col("g_name")) & (F.col("path") == F.col("g_path")), "left").drop("g_name", "g_path")  # 20 rows
    out = edges.where("resolved AND src_kind = 'symbol'").join(primary.select(F.col("symbol_id").alias("src_id")), "src_id", "left_semi")
    callees = out.select(F.col("dst_kind").alias("kind"), F.col("dst_id").alias("id"), "edge_type", "confidence").join(nodes(files, symbols), ["kind", "id"]).select("kind", "path", "name", "line_start", "edge_type", "confidence").orderBy("path", "line_start", "name", "edge_type")
    return {"definitions": defs.orderBy("path", "line_start"), "primary": primary, "callers": references(name, edges, files, symbols, "call").select("path", "line", "confidence"), "callees": callees}


def coverage(paths: DataFrame, files: DataFrame) -> DataFrame:
    """One row (partial, languages, reason): which languages among the paths have only part of their graph."""
    langs = paths.select("path").distinct().join(files.select("path", "lang"), "path").where(F.col("lang").isin(*P.CODE) & (P.graph_tier(F.col("lang")) == "partial"))
    found = langs.agg(F.array_sort(F.collect_set("lang")).alias("languages"))  # a fixed set of languages
    why = F.concat(F.lit("Import and inheritance edges aren't extracted for "), F.array_join("languages", ", "), F.lit(": results may lack some."))
    return found.select((F.size("languages") > 0).alias("partial"), "languages", F.when(F.size("languages") > 0, why).alias("reason"))


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "edge_type string, src_kind string, src_id long, dst_kind string, dst_id long, dst_name string, file_id long, line int, resolved boolean, confidence string")
