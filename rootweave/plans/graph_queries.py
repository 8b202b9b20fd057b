"""Queries of the graph, maintenance, set and export operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions import paths as P
from rootweave.operators import communities as C
from rootweave.operators import graph as G
from rootweave.operators import render, retrieve
from rootweave.operators import tables as M
from rootweave.plans.views import edges_raw, files, symbols, table, with_views
from rootweave.storage import once, stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def stored_edges(spark: SparkSession, d: str) -> DataFrame:
    """The resolved edges as an index holds them: built once for a session and tables, then read."""
    return once(spark, f"edges of {d}", lambda: stored(_edges(spark, d)))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges resolved anew from the raw ones, which an index holds too."""
    return G.resolve(once(spark, f"raw edges of {d}", lambda: stored(edges_raw(spark, d))), symbols(spark, d), files(spark, d))


@query(with_views(" SELECT edge_type, confidence, dst_kind, count(*) AS edges, count(DISTINCT dst_id) AS targets, sum(src_id)::BIGINT AS src_sum, sum(dst_id)::BIGINT AS dst_sum FROM edges GROUP BY ALL", "edges"))
def edge_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("edge_type", "confidence", "dst_kind").agg(F.count("*").alias("edges"), F.countDistinct("dst_id").alias("targets"), F.sum("src_id").alias("src_sum"), F.sum("dst_id").alias("dst_sum"))


@query(with_views(" SELECT name, min(symbol_id) AS symbol_id FROM symbols GROUP BY name HAVING count(*) = 1", "symbols"))
def unique_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    return G.unique_names(symbols(spark, d))


@query(with_views(" SELECT symbol_id, (SELECT count(*) FROM edges WHERE dst_kind = 'symbol' AND dst_id = symbol_id AND resolved) AS in_degree, (SELECT count(*) FROM edges WHERE src_kind = 'symbol' AND src_id = symbol_id AND resolved) AS out_degree FROM symbols", "edges"))
def degree_in_out(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(symbols(spark, d), _edges(spark, d))


@query(with_views(" SELECT dst_name AS name, count(*) AS refs FROM edges_raw WHERE dst_name IS NOT NULL GROUP BY dst_name", "edges_raw"))
def name_ref_counts(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.name_reference_counts(edges_raw(spark, d))


_TARGET = "Supplier#000000003"


def _walk_sql(direction: str, depth: int, seed: str) -> str:
    up = "SELECT dst_kind AS k, dst_id AS i, src_kind AS k2, src_id AS i2, edge_type, confidence FROM edges WHERE resolved"
    down = "SELECT src_kind AS k, src_id AS i, dst_kind AS k2, dst_id AS i2, edge_type, confidence FROM edges WHERE resolved"
    arcs = {"up": up, "down": down, "both": f"{up} UNION ALL {down}"}[direction]
    return with_views(
        f""", arcs AS (SELECT DISTINCT * FROM ({arcs})), w(k, i, distance) AS ({seed} UNION SELECT a.k2, a.i2, w.distance + 1 FROM w JOIN arcs a ON a.k = w.k AND a.i = w.i WHERE w.distance < {depth}),
            m AS (SELECT k, i, min(distance) AS distance FROM w GROUP BY k, i),
            v AS (SELECT m.k, m.i, m.distance, min({{'e': a.edge_type, 'c': a.confidence}}) AS via FROM m JOIN arcs a ON a.k2 = m.k AND a.i2 = m.i JOIN m p ON p.k = a.k AND p.i = a.i AND p.distance = m.distance - 1 GROUP BY ALL)
        SELECT k AS kind, i AS id, distance::INT AS distance, via.e AS via_edge, via.c AS via_confidence FROM v""",
        "edges",
    )


_SEED = f"SELECT 'symbol' AS k, symbol_id AS i, 0 AS distance FROM symbols WHERE name = '{_TARGET}'"


def _impact(spark: SparkSession, d: str, depth: int, direction: str) -> DataFrame:
    e = stored_edges(spark, d)
    return G.walk(e, G.seeds(_TARGET, files(spark, d), symbols(spark, d)), depth, direction)


@query(_walk_sql("up", 2, _SEED))
def impact_up(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, 2, "up")


@query(_walk_sql("down", 2, _SEED))
def impact_down(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, 2, "down")


@query(_walk_sql("both", 3, _SEED))
def impact_both(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, 3, "both")


@query(_walk_sql("down", 2, _SEED).replace("SELECT k AS kind", "SELECT f.path, min(distance)::INT AS distance FROM v JOIN (SELECT 'symbol' AS kk, symbol_id AS ii, path FROM symbols UNION ALL SELECT 'file', file_id, path FROM files) f ON f.kk = v.k AND f.ii = v.i GROUP BY f.path --"))
def impact_files(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(_TARGET, stored_edges(spark, d), files(spark, d), symbols(spark, d), 2, "down")[1]


@query(with_views(
    """, ch AS (SELECT path AS origin, file_id FROM files WHERE contains(path, 'asia')),
        arcs AS (SELECT DISTINCT dst_kind AS k, dst_id AS i, src_kind AS k2, src_id AS i2 FROM edges WHERE resolved),
        w(origin, k, i, distance) AS (SELECT * FROM (SELECT origin, 'file' AS k, file_id AS i, 0 AS distance FROM ch UNION ALL SELECT origin, 'symbol', symbol_id, 0 FROM ch JOIN symbols s ON s.file_id = ch.file_id)
            UNION SELECT w.origin, a.k2, a.i2, w.distance + 1 FROM w JOIN arcs a ON a.k = w.k AND a.i = w.i WHERE w.distance < 2),
        m AS (SELECT origin, k, i, min(distance) AS distance FROM w GROUP BY ALL HAVING min(distance) > 0),
        n AS (SELECT 'symbol' AS k, symbol_id AS i, path FROM symbols UNION ALL SELECT 'file', file_id, path FROM files)
    SELECT path, min(distance)::INT AS distance, array_to_string(list_sort(list(DISTINCT origin)), ',') AS changed_by FROM m JOIN n ON n.k = m.k AND n.i = m.i GROUP BY path""",
    "edges",
))
def diff_impact_merge(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    hit = G.diff_impact(f.where(F.col("path").contains("asia")).select("path"), stored_edges(spark, d), f, symbols(spark, d))
    return hit.affected.select("path", "distance", F.array_join("changed_by", ",").alias("changed_by"))


@query(with_views(
    """, arcs AS (SELECT DISTINCT * FROM (SELECT src_kind AS k, src_id AS i, dst_kind AS k2, dst_id AS i2 FROM edges WHERE resolved UNION ALL SELECT dst_kind, dst_id, src_kind, src_id FROM edges WHERE resolved)),
        w(k, i, hops) AS (SELECT 'symbol', symbol_id, 0 FROM symbols WHERE name = 'Customer#000000000' UNION SELECT a.k2, a.i2, w.hops + 1 FROM w JOIN arcs a ON a.k = w.k AND a.i = w.i WHERE w.hops < 6)
    SELECT min(hops)::INT AS hops FROM w JOIN symbols s ON w.k = 'symbol' AND w.i = s.symbol_id WHERE s.name = 'Customer#000000001'""",
    "edges",
))
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    f, s = files(spark, d), symbols(spark, d)
    return G.shortest_path(stored_edges(spark, d), G.seeds("Customer#000000000", f, s, False), G.seeds("Customer#000000001", f, s, False)).select("hops")


@query(with_views(f" SELECT path, line, kind, confidence FROM (SELECT f.path, line, 'call' AS kind, confidence FROM edges e JOIN files f ON f.file_id = e.file_id WHERE edge_type = 'call' AND dst_name = '{_TARGET}' UNION ALL SELECT path, line_start, 'definition', 'extracted' FROM symbols WHERE name = '{_TARGET}')", "edges"))
def references(spark: SparkSession, d: str) -> DataFrame:
    return G.references(_TARGET, _edges(spark, d), files(spark, d), symbols(spark, d))


@query(with_views(f" SELECT s.kind AS symbol_kind, s.path, (SELECT count(*) FROM edges WHERE resolved AND dst_kind = 'symbol' AND dst_id = s.symbol_id) AS in_degree, (SELECT count(*) FROM edges WHERE resolved AND src_kind = 'symbol' AND src_id = s.symbol_id) AS out_degree, regexp_extract(s.path, '^(.*)/[^/]*$', 1) AS module FROM symbols s WHERE name = '{_TARGET}'", "edges"))
def node_card(spark: SparkSession, d: str) -> DataFrame:
    return G.node_card(_TARGET, _edges(spark, d), files(spark, d), symbols(spark, d))["primary"].select(F.col("kind").alias("symbol_kind"), "path", "in_degree", "out_degree", "module")


# Customers and suppliers that trade, as a weighted undirected graph; the given partition is the nation.
_PAIRS = """SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS w FROM (SELECT c_name AS a, s_name AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2"""
_BOTH = f"p AS ({_PAIRS}), x AS (SELECT a, b, w FROM p UNION ALL SELECT b, a, w FROM p), g AS (SELECT a AS node, sum(w)::BIGINT AS degree FROM x GROUP BY a)"
_PART = "m AS (SELECT c_name AS node, c_nationkey AS community FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier)"


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """One row a line; names are met by hash tables, so the lines are never sorted."""
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    bought = o.join(c.hint("shuffle_hash"), o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_name").alias("a"))
    sold = line.join(s.hint("shuffle_hash"), line.l_suppkey == s.s_suppkey).select("l_orderkey", F.col("s_name").alias("b"))
    return sold.join(bought.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select("a", "b")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.select(F.col("c_name").alias("node"), F.col("c_nationkey").alias("community")).unionByName(s.select(F.col("s_name").alias("node"), F.col("s_nationkey").alias("community")))


@query(_PAIRS)
def adjacency_weight(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_weights(_trade(spark, d))


@query(f"WITH {_BOTH} SELECT node, degree FROM g ORDER BY degree DESC, node LIMIT 20")
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.god_nodes(C.pair_weights(_trade(spark, d)))


@query(f"WITH {_BOTH}, {_PART}, e AS (SELECT least(ma.community, mb.community) AS ca, greatest(ma.community, mb.community) AS cb, a, b FROM p JOIN m ma ON ma.node = a JOIN m mb ON mb.node = b WHERE ma.community <> mb.community), k AS (SELECT ca, cb, count(*) AS n, min({{'a': a, 'b': b}}) AS e FROM e GROUP BY ca, cb) SELECT ca AS from_community, cb AS to_community, n AS edge_count, e.a AS a, e.b AS b FROM k WHERE n <= 60 ORDER BY n, ca, cb LIMIT 12")
def bridge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.bridges(C.pair_weights(_trade(spark, d)), _nations(spark, d), most=60)


@query(f"WITH {_BOTH}, {_PART}, t AS (SELECT sum(degree)::DOUBLE AS m2 FROM g) SELECT round(sum(CASE WHEN ma.community = mb.community THEN w - ga.degree * gb.degree / m2 ELSE 0 END) / any_value(m2), 4) AS modularity FROM x JOIN m ma ON ma.node = a JOIN m mb ON mb.node = b JOIN g ga ON ga.node = a JOIN g gb ON gb.node = b, t")
def adjacent_modularity(spark: SparkSession, d: str) -> DataFrame:
    return C.adjacent_modularity(C.pair_weights(_trade(spark, d)), _nations(spark, d))


@query(f"WITH {_BOTH}, {_PART}, r AS (SELECT community, node, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS n FROM m JOIN g USING (node)) SELECT community, n::INT AS n, node, degree FROM r WHERE n <= 5")
def community_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.top_nodes(_nations(spark, d), C.weighted_degree(C.pair_weights(_trade(spark, d))))


@query(f"WITH {_PART}, s AS (SELECT community AS label, count(*) AS n, min(node) AS least FROM m GROUP BY community), r AS (SELECT label, row_number() OVER (ORDER BY n DESC, least) - 1 AS community FROM s) SELECT node, r.community FROM m JOIN r ON r.label = m.community")
def community_renumber(spark: SparkSession, d: str) -> DataFrame:
    out = C.renumber(_nations(spark, d).withColumnRenamed("community", "label"))
    return out.select("node", F.col("community").cast("long").alias("community"))


@query("""WITH f AS (SELECT doc_id, lang AS community, CASE WHEN doc_id % 3 = 0 THEN 'tests/' || source ELSE source || '/' || lang END AS dir, doc_id % 3 = 0 AS is_test FROM documents), v AS (SELECT community, dir, count(*) AS n, sum((NOT is_test)::INT) AS p FROM f GROUP BY community, dir),
          w AS (SELECT *, CASE WHEN max(p) OVER (PARTITION BY community) > 0 THEN p ELSE n END AS votes FROM v) SELECT community, arg_min(dir, {'v': -votes, 'l': len(dir), 'd': dir}) AS label FROM w GROUP BY community""")
def community_labels(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tests/"), "source")).otherwise(F.concat_ws("/", "source", "lang")), F.lit("/f.md"))
    keyed = doc.select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("community"), path.alias("path"))
    return C.labels(keyed.select(F.col("key").alias("node"), "community"), keyed.select("key", "path"))


@query()
def communities_louvain(spark: SparkSession, d: str) -> DataFrame:
    return C.communities(C.pair_weights(_trade(spark, d)))


# Documents as files: the stored index lacks some sources and holds older versions of others.
_STORED = "SELECT doc_id AS path, CASE WHEN source IN ('src2', 'src3') THEN 1 ELSE 0 END AS mtime_ns, n_chars AS size_bytes, CASE WHEN source = 'src2' THEN 'old' ELSE sha256(text) END AS sha256, source FROM documents WHERE source <> 'src1'"
_CURRENT = "SELECT doc_id AS path, 0 AS mtime_ns, n_chars AS size_bytes, sha256(text) AS sha256 FROM documents WHERE source <> 'src4'"
_DIFF = f"s AS ({_STORED}), c AS ({_CURRENT}), x AS (SELECT coalesce(s.path, c.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN s.mtime_ns = c.mtime_ns AND s.size_bytes = c.size_bytes THEN 'unchanged' WHEN s.sha256 = c.sha256 THEN 'touched' ELSE 'modified' END AS change FROM s FULL JOIN c ON s.path = c.path)"


def _prints(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.lit(0).cast("long").alias("mtime_ns"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), "source")
    old = now.where("source <> 'src1'").withColumns({"mtime_ns": F.when(F.col("source").isin("src2", "src3"), 1).otherwise(0).cast("long"), "sha256": F.when(F.col("source") == "src2", "old").otherwise(F.col("sha256"))})
    return old, now.where("source <> 'src4'")


@query(f"WITH {_DIFF} SELECT path, change FROM x WHERE change <> 'unchanged'")
def fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    return M.fingerprint_diff(*_prints(spark, d))


@query(f"WITH {_DIFF} SELECT count(*) FILTER (WHERE change IN ('added', 'removed', 'modified')) > 0 AS stale, count(*) FILTER (WHERE change IN ('added', 'removed', 'modified')) AS files_changed_since_build FROM x")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return M.freshness(M.fingerprint_diff(*_prints(spark, d)))


@query(f"WITH {_DIFF}, u AS (SELECT count(*) FILTER (WHERE change IN ('added', 'modified')) AS indexed, count(*) FILTER (WHERE change = 'removed') AS deleted FROM x) SELECT indexed, (SELECT count(*) FROM c) - indexed AS skipped, deleted FROM u")
def update_counts(spark: SparkSession, d: str) -> DataFrame:
    old, now = _prints(spark, d)
    return M.update_counts(M.fingerprint_diff(old, now), now)


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'new' ELSE source END AS source FROM documents WHERE lang <> 'xx'")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "documents").select("doc_id", "source", "lang")
    return M.upsert(base, base.where("lang = 'fr'").withColumn("source", F.lit("new")), "doc_id").select("doc_id", "source")


@query("SELECT count(DISTINCT o_orderkey) AS orders, count(*) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND l_orderkey IS NOT NULL")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("path"))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"))
    left = M.delete_files({"files": f, "chunks": c}, f.where("path = 'F'").select("path"))
    return left["chunks"].join(left["files"], "file_id", "left_semi").agg(F.countDistinct("file_id").alias("orders"), F.count("*").alias("lines"))


@query("SELECT d.doc_id, sha256(text) AS content_sha FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
def pending_embed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return M.pending_embeddings(c, table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))).select(F.col("chunk_id").alias("doc_id"), "content_sha")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def orphan_prune(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return M.prune_vectors(v, table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))).select(F.col("chunk_id").alias("vec_id"), "label")


@query("SELECT sha256(text) AS content_sha FROM documents WHERE lang <> 'en' EXCEPT SELECT sha256(text) FROM documents WHERE source = 'src0'")
def embed_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    c = doc.where("lang <> 'en'").select(F.sha2("text", 256).alias("content_sha"), F.col("text").alias("content"))
    cache = doc.where("source = 'src0'").select(F.lit("m").alias("model"), F.sha2("text", 256).alias("content_sha"))
    return M.cache_misses(c, cache, "m").select("content_sha")


@query("SELECT d.lang, count(DISTINCT d.doc_id) AS files, count(l.doc_id) AS symbols FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang")
def coverage_by_lang(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "lang", F.lit("treesitter").alias("parser"))
    return M.language_coverage(f, table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("symbol_id")))


@query("SELECT source AS path, count(DISTINCT d.doc_id) AS file_count, count(l.doc_id) AS symbol_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def module_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return M.modules(f, table(spark, d, "labels").select(F.col("doc_id").alias("file_id")), P.directory(F.col("path")))


@query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM labels) AS symbols, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(*) FROM embeddings) AS vectors")
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    one = [table(spark, d, t).agg(F.count("*").alias(c)) for t, c in (("documents", "files"), ("labels", "symbols"), ("lineitem", "edges"), ("embeddings", "vectors"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2]).crossJoin(one[3])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id AS path FROM documents UNION SELECT page_id FROM pages")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return M.changed_paths(table(spark, d, "documents").select(F.col("doc_id").alias("path")), table(spark, d, "pages").select(F.col("page_id").alias("path")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("path"))
    return M.in_scope(o, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"))).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return M.delete(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_SHOWN = f"p AS ({_PAIRS})"


@query(f"WITH {_SHOWN}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT a AS node FROM p UNION SELECT b FROM p)) SELECT '  n' || x.i || ' -> n' || y.i || ' [label=\"call\", style=solid];' AS line FROM p JOIN n x ON x.node = a JOIN n y ON y.node = b")
def export_dot_edges(spark: SparkSession, d: str) -> DataFrame:
    p = stored(C.pair_weights(_trade(spark, d)).select(F.col("a").alias("source"), F.col("b").alias("target"))).withColumns({"edge_type": F.lit("call"), "confidence": F.lit("extracted")})
    return render.dot_edges(p, render.dense_ids(p))


@query(f"WITH {_SHOWN} SELECT 'MATCH (a {{key:''' || a || '''}}), (b {{key:''' || b || '''}}) MERGE (a)-[:CALL {{confidence:''extracted''}}]->(b);' AS line FROM p")
def export_cypher_edges(spark: SparkSession, d: str) -> DataFrame:
    p = C.pair_weights(_trade(spark, d)).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("call").alias("edge_type"), F.lit("extracted").alias("confidence"))
    return render.cypher_edges(p)


@query("WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS c FROM nation) SELECT n_name AS id, round(600 + 760 * 0.38 * cos(2 * pi() * i / c), 2) AS x, round(380 + 760 * 0.38 * sin(2 * pi() * i / c), 2) AS y FROM n")
def circular_layout(spark: SparkSession, d: str) -> DataFrame:
    return render.layout(table(spark, d, "nation").select(F.col("n_name").alias("id")))




#: Of each region: a language, its files' suffix, and what joins a module's parts.
_STYLES = [("java", "java", "."), ("typescript", "ts", "/"), ("go", "go", "/"), ("rust", "rs", "::"), ("csharp", "cs", ".")]
_BY_REGION = " ".join(f"WHEN {k} THEN {{'lang': '{lang}', 'x': '{x}', 'j': '{j}'}}" for k, (lang, x, j) in enumerate(_STYLES))


@query(f"""WITH f AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS r, lower(replace(r_name, ' ', '_')) AS dir, lower(n_name) AS base, CASE n_regionkey {_BY_REGION} END AS s FROM nation JOIN region ON r_regionkey = n_regionkey),
                n AS (SELECT *, lead(id) OVER (PARTITION BY r ORDER BY id) AS next FROM f)
           SELECT n.id AS src_id, n.s.lang AS lang, t.dir || t.s.j || t.base AS dst_name, t.id AS dst_id, 'inferred' AS confidence FROM n JOIN f t ON t.id = n.next""")
def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Imports in the style of five languages, each file importing the next of its region."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    style = F.get(F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(x).alias("x"), F.lit(j).alias("j")) for lang, x, j in _STYLES]), F.col("n_regionkey"))
    folder, base = F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lower("n_name")
    f = joined.select(F.col("n_nationkey").cast("long").alias("file_id"), "n_regionkey", folder.alias("dir"), base.alias("base"), style.alias("s"))
    f = f.select("*", "s.lang", F.concat("dir", F.lit("/"), "base", F.lit("."), "s.x").alias("path"), F.concat("dir", "s.j", "base").alias("module"))
    after = f.alias("a").join(f.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.file_id") < F.col("b.file_id"))).groupBy(F.col("a.file_id").alias("src_id")).agg(F.min_by("b.module", "b.file_id").alias("dst_name"))
    raw = after.select(F.lit("import").alias("edge_type"), F.lit("file").alias("src_kind"), "src_id", "dst_name", F.col("src_id").alias("file_id"), F.lit(1).alias("line"))
    none = symbols(spark, d).limit(0)
    return G.resolve(raw, none, f.select("file_id", "path", "lang")).join(f.select(F.col("file_id").alias("src_id"), "lang"), "src_id").select("src_id", "lang", "dst_name", "dst_id", "confidence")
