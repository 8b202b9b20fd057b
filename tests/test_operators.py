import json

import pytest
from pyspark.sql import functions as F

from rootweave.functions import text as T
from rootweave.operators import communities as C
from rootweave.operators import fulltext, fuse, metrics, parse, render, retrieve
from rootweave.operators import graph as G
from rootweave.operators import tables as M
from rootweave.plans import search
from rootweave.sources import tree
from rootweave.streaming import watch

REPO = {
    "src/auth/token.py": '"""Token handling."""\n\n\ndef refresh_access_token(token):\n    """Exchange a refresh token for a new one."""\n    return token + "x"\n\n\ndef login(user, password):\n    """Log a user in and hand out a token."""\n    return refresh_access_token(user)\n',
    "src/models/user.py": '"""Users."""\n\n\nclass User:\n    def __init__(self, given):\n        self.name = given.strip()\n',
    "src/api/service.py": '"""Service."""\n\nfrom auth.token import refresh_access_token\nfrom models.user import User\n\n\nclass AdminUser(User):\n    """An administrator that can renew a token."""\n\n    def renew(self):\n        return refresh_access_token(self.name)\n',
    "web/app.ts": "export function bootstrap() {\n  return 1;\n}\n",
    "docs/notes.md": "# Notes\nAbout the token.\n",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in {**REPO, ".env": "SECRET=1", "node_modules/x.js": "function n() {}", "key.pem": "k", "bin.py": "a\x00b", "src/skip.log.py": "x = 1\n", "build/out.py": "x = 1\n", "README": "no language"}.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (root / ".gitignore").write_text("*.log.py\n")
    files = tree.scan(spark, str(root), tree.ignore_patterns(str(root))).cache()
    parsed = parse.parse(files).cache()
    t = parse.tables(parsed)
    edges = G.cut(G.resolve(t["edges_raw"], t["symbols"], files))
    degree = G.degrees(t["symbols"], edges)
    return {"files": files, "parsed": parsed, "symbols": G.cut(t["symbols"].join(degree, "symbol_id")), "chunks": G.cut(t["chunks"]), "edges_raw": t["edges_raw"], "edges": edges, "root": str(root)}


def test_scan_gates(index):
    assert {r.path for r in index["files"].collect()} == set(REPO)
    row = index["files"].where("path = 'web/app.ts'").first()
    assert row.lang == "typescript" and row.parser == "treesitter" and row.content == REPO["web/app.ts"] and row.size_bytes == len(row.content) and not row.is_generated
    assert tree.scan(index["files"].sparkSession, index["root"], max_bytes=30, with_content=False).columns == ["file_id", "path", "lang", "size_bytes", "mtime_ns", "parser", "is_generated"]
    stats = parse.build_stats(index["files"], index["parsed"]).first()
    assert stats.indexed == 5 and stats.symbols == 7 and stats.failures == 0


def test_resolution(index):
    got = {(r.edge_type, r.dst_name, r.dst_kind, r.confidence) for r in index["edges"].collect()}
    assert ("call", "refresh_access_token", "symbol", "extracted") in got and ("import", "auth.token", "file", "inferred") in got and ("extends", "User", "symbol", "extracted") in got
    # A name that becomes ambiguous, or a file that goes, is resolved anew: nothing is patched in place.
    twice = index["symbols"].unionByName(index["symbols"].where("name = 'refresh_access_token'").withColumns({"symbol_id": F.lit(1).cast("long"), "file_id": F.lit(2).cast("long")}))
    again = G.resolve(index["edges_raw"], twice, index["files"]).where("dst_name = 'refresh_access_token' AND edge_type = 'call'")
    assert {r.confidence for r in again.collect()} == {"extracted", "ambiguous"}
    gone = G.resolve(index["edges_raw"], index["symbols"], index["files"].where("path <> 'src/auth/token.py'")).where("dst_name = 'auth.token'")
    assert [r.confidence for r in gone.collect()] == ["ambiguous"]


def test_impact_and_paths(index):
    e, f, s = index["edges"], index["files"], index["symbols"]
    nodes, files = G.impact("src/models/user.py", e, f, s, 2, "up")
    assert {(r.kind, r.name, r.distance, r.via_edge) for r in nodes.collect()} == {("file", "service.py", 1, "import"), ("symbol", "AdminUser", 1, "extends")}
    assert [(r.path, r.distance) for r in files.collect()] == [("src/api/service.py", 1)]
    path = G.shortest_path(e, G.seeds("renew", f, s, False), G.seeds("refresh_access_token", f, s, False)).first()
    assert path.hops == 1 and path.steps[0].edge_type == "call" and path.steps[0].way == "out"
    assert G.shortest_path(e, G.seeds("bootstrap", f, s, False), G.seeds("renew", f, s, False)).count() == 0
    assert G.seeds("token.py", f, s).count() == 3 and G.seeds("nothing", f, s).count() == 0
    with pytest.raises(ValueError, match="depth"):
        G.walk(e, G.seeds("renew", f, s), 0)
    with pytest.raises(ValueError, match="direction"):
        G.walk(e, G.seeds("renew", f, s), 1, "sideways")
    changed = f.sparkSession.createDataFrame([("src/auth/token.py",), ("src/models/user.py",), ("gone.py",)], "path string")
    hit, unknown, total = G.diff_impact(changed, e, f, s)
    assert [(r.path, r.distance, r.changed_by) for r in hit.collect()] == [("src/api/service.py", 1, ["src/auth/token.py", "src/models/user.py"])] and [r.path for r in unknown.collect()] == ["gone.py"]
    assert total.first()[:3] == (3, 3, False) and total.first().partial is False
    few = G.diff_impact(changed, e, f, s, max_files=1).summary.first()
    assert few[:3] == (3, 1, True) and G.diff_impact(changed, e, f, s, max_files=None).summary.first()[:3] == (3, 3, False)
    both = f.sparkSession.createDataFrame([("src/auth/token.py",), ("src/api/service.py",)], "path string")
    assert [(r.path, r.changed_by) for r in G.diff_impact(both, e, f, s).affected.collect()] == [("src/api/service.py", ["src/auth/token.py"])]  # changed, and affected by the other
    assert G.impact_response("src/models/user.py", e, f, s)["coverage"].first().reason is None


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_edges_meet_their_targets_once(spark, index, tmp_path):
    """Edges are read once a use and met by hash tables: no sort of them, however many ask for one name."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        raw = G.resolve(index["edges_raw"], index["symbols"], index["files"])
        assert "ShuffledHashJoin" in next(x for x in plan(raw).splitlines() if "Join" in x)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    raw.write.parquet(str(tmp_path / "resolved"))
    edges = spark.read.parquet(str(tmp_path / "resolved"))
    assert plan(G.degrees(index["symbols"].select("symbol_id"), edges)).count("FileScan") == plan(G.arcs(edges, "both")).count("FileScan") == 1
    assert sum(r.in_degree for r in G.degrees(index["symbols"].select("symbol_id"), edges).collect()) == edges.where("resolved AND dst_kind = 'symbol'").count()


def test_an_edge_without_name_or_file_is_ambiguous(spark, index):
    odd = index["edges_raw"].limit(1).withColumns({"dst_name": F.lit(None).cast("string"), "edge_type": F.lit("call")})
    both = odd.unionByName(odd.withColumns({"file_id": F.lit(None).cast("long"), "dst_name": F.lit("login")}))
    found = G.resolve(both, index["symbols"], index["files"]).orderBy("dst_name").collect()
    assert [(r.dst_name, r.resolved, r.confidence) for r in found] == [(None, False, "ambiguous"), ("login", True, "extracted")]


def test_cards_and_references(index):
    e, f, s = index["edges"], index["files"], index["symbols"].drop("in_degree", "out_degree")
    refs = [(r.path, r.kind) for r in G.references("refresh_access_token", e, f, s).collect()]
    assert refs == [("src/api/service.py", "call"), ("src/auth/token.py", "definition"), ("src/auth/token.py", "call")]
    card = G.node_card("login", e, f, s)
    assert card["primary"].first().module == "src/auth" and [r.name for r in card["callees"].collect()] == ["refresh_access_token"] and card["callers"].count() == 0
    assert G.coverage(f.select("path"), f).first().partial is False


def test_search_end_to_end(index):
    out = search.search(index, "refresh token", skeleton=True)
    first = out["results"][0]
    assert (out["intent"], first["path"], first["symbols"]) == ("keyword", "src/auth/token.py", ["refresh_access_token"])
    assert [r["rank"] for r in out["results"]] == list(range(1, len(out["results"]) + 1)) and "pagination" not in out and out["index"]["stale"] is False
    (only, *_) = search.search(index, "refresh_access_token", mode="fts")["results"]
    assert only["path"] == first["path"]
    exact = search.search(index, "login", mode="symbol")
    assert exact["confidence"] == "high" and "exact symbol match" in exact["results"][0]["reason"]
    nothing = search.search(index, "zzzqqq")
    assert nothing["confidence"] == "low" and nothing["results"] == [] and nothing["fallback_suggestions"]["ripgrep"] == ['rg -n "zzzqqq"'] and search.search(index, "zzzqqq", fallbacks=False)["fallback_suggestions"] == {}
    first, second = (search.search(index, "refresh renew", mode="symbol", limit=1, offset=k) for k in range(2))
    assert first["pagination"]["has_more"] and second["results"][0]["rank"] == 2
    assert "pagination" not in search.search(index, "token", limit=1, compat_paging=True) and search.search(index, "token", limit=1, offset=1, compat_paging=True)["pagination"]["has_more"] is False
    whole = search.search(index, "refresh renew", mode="symbol", limit=2, budget=60)
    paged = [search.search(index, "refresh renew", mode="symbol", limit=1, offset=k, budget=30)["results"][0] for k in range(2)]
    assert [r["path"] for r in paged] == [r["path"] for r in whole["results"]]
    spent = sum(r["token_est"] for r in whole["results"] if r["snippet"])
    assert spent <= 60 and (paged[1]["snippet"] is not None) == (whole["results"][1]["snippet"] is not None)  # page 2 goes on with what page 1 left
    tight = search.search(index, "token", budget=1)
    assert all(r["snippet"] is None for r in tight["results"]) and len(tight["recommended_reads"]) == len(tight["results"])
    assert "**Query:** refresh token" in render.markdown_search(out) and json.loads(render.to_json(render.envelope("search", out)))["schema_version"] == 1
    assert search.explain(index, "login")["intent"] == "how_it_works"
    with pytest.raises(ValueError, match="mode"):
        search.search(index, "x", mode="best")


def test_vector_retriever(spark, index):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in retrieve.nearest(v, [0.9, 0.1, 0.0], 2).collect()] == [1, 2]
    assert retrieve.vector_candidates(v, index["chunks"], index["files"], None, 5) is None
    backend = F.array(F.when(F.col("content").contains("token"), 1.0).otherwise(0.0), F.lit(0.5)).cast("array<float>")
    empty = spark.createDataFrame([], "chunk_id long, embedding array<float>"), spark.createDataFrame([], "model string, content_sha string, embedding array<float>")
    vectors, cache = M.embed(index["chunks"], *empty, backend, "m")
    assert vectors.count() == index["chunks"].count() and cache.count() == index["chunks"].select("content").distinct().count()
    assert M.cache_misses(M.pending_embeddings(index["chunks"], vectors), cache, "m").count() == 0
    hits = search.search({**index, "vectors": vectors}, "token", mode="vector", vector=[1.0, 0.5])
    assert hits["results"] and hits["results"][0]["reason"] == "vector"


def candidate(spark, rows):
    full = [(p, a, a + 5, src, float(sc), k, sym, "x" * 200, 50, deg, 0, 0, gen, ex) for p, a, src, sc, k, sym, deg, gen, ex in rows]
    return spark.createDataFrame(full, fuse.CANDIDATE)


def test_the_worked_score(spark):
    fts = [("src/auth/token.py", 4, "fts", 9, None, None, 0, False, False), *[(f"p{i}", 1, "fts", 8 - i, None, None, 0, False, False) for i in range(3)], ("src/api/service.py", 7, "fts", 1, None, None, 0, False, False)]
    rows = [*fts, ("src/auth/token.py", 4, "symbol", 1, "function", "refresh_access_token", 2, False, False), ("src/auth/token.py", 1, "path", 1, None, None, 0, False, False)]
    out = fuse.rerank(fuse.fuse(candidate(spark, rows), search.plan("token").weights), ["search", "token"]).orderBy("pos").collect()
    assert round(out[0].score, 3) == 2.233 and out[0].reason == "in src/auth/ · 2 callers" and out[0].agreeing_sources == 3 and out[0].source == "symbol"
    assert {r.path: round(r.score, 4) for r in out}["src/api/service.py"] == 0.9375


def test_fusion_rules(spark):
    rows = [("a", 1, "fts", 5, None, None, 0, False, False), ("a", 20, "fts", 4, None, None, 0, False, False), ("b", 1, "fts", 3, None, None, 0, False, False), ("a", 50, "symbol", 1, "class", "A", 0, False, False)]
    got = {(r.path, fuse_bucket(r.line_start)): r.score for r in fuse.fuse(candidate(spark, rows), dict(symbol=0.0, fts=1.0)).collect()}
    assert got == {("a", 0): 1.0, ("b", 0): 60 / 62}  # duplicates count for ranks, a source without weight for nothing


def fuse_bucket(line):
    return (max(line, 1) - 1) // 40


def test_bonus_and_confidence(spark):
    rows = [("x/gen.ts", 1, "fts", 2, None, None, 0, True, False), ("tests/a.py", 1, "fts", 1, None, None, 0, False, False)]
    fused = fuse.fuse(candidate(spark, rows), {"fts": 1.0})
    assert {r.reason for r in fuse.rerank(fused, ["q"]).collect()} == {"generated/test demoted"}
    assert [round(r.score, 4) for r in fuse.rerank(fused, ["test"]).orderBy("path").collect()][0] == round(60 / 61 + 0.05, 4)
    level = lambda rows: fuse.confidence(spark.createDataFrame(rows, "pos int, score double, agreeing_sources int, exact_symbol boolean")).first()[0]
    assert level([]) == "low" and level([(0, 0.0, 3, True)]) == "low" and level([(0, 1.0, 1, False)]) == "medium" and level([(0, 1.0, 1, True)]) == "high"
    assert level([(0, 1.0, 3, False), (1, 0.8, 1, False)]) == "high" and level([(0, 1.0, 2, False), (1, 0.8, 1, False)]) == "medium" and level([(0, 1.0, 1, False), (1, 0.4, 1, False)]) == "high"
    assert level([(0, 1.0, 1, False), (1, 0.95, 1, False)]) == "low" and level([(i, 1.0 - i / 100, 1, False) for i in range(5)]) == "medium"


def test_diversify_and_budget(spark):
    rows = [("a", i * 50, "fts", 100 - i, None, None, 0, False, False) for i in range(5)] + [("b", 1, "fts", 1, None, None, 0, False, False)]
    out = fuse.diversify(fuse.rerank(fuse.fuse(candidate(spark, rows), {"fts": 1.0}), [])).orderBy("pos").collect()
    assert [r.path for r in out] == ["a", "a", "a", "b", "a", "a"]
    fits = spark.sql("SELECT array(500L, 900L, 100L, CAST(NULL AS BIGINT), 450L) AS c").select(fuse.greedy_budget(F.col("c"), 1100).alias("f")).first().f
    assert fits == [True, False, True, False, True]


def test_bm25_forms_agree(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, "cat cat dog the"), (4, ""), (5, None)], "id long, t string")
    tok = fulltext.tokenised(docs.where("t IS NOT NULL"), "id", F.col("t"))
    a = {r.doc: round(r.score, 9) for r in fulltext.bm25(tok, [["cat"]]).collect()}
    folder = str(tmp_path / "index")
    assert fulltext.write_index(tok, folder) == 1
    at = fulltext.open_index(spark, folder)
    b = {r.doc: round(r.score, 9) for r in fulltext.bm25_indexed(at, [["cat"]]).collect()}
    assert {r.doc: r.f_0 for r in fulltext.indexed_counts(at, ["cat dog"]).where("f_0 > 0").collect()} == {3: 1}
    assert fulltext.write_index(tok.limit(1), folder) == 2 and fulltext.open_index(spark, folder).corpus.first().n_docs == 1 and fulltext.open_index(spark, folder, 1).corpus.first().n_docs == at.corpus.first().n_docs
    assert a == b and set(a) == {1, 3}
    assert {r.doc: r.f_0 for r in fulltext.match(tok, [["cat dog"]]).collect()} == {3: 1} and fulltext.match(tok, []).count() == 0
    changed = fulltext.tokenised(spark.createDataFrame([(2, "cat")], "id long, t string"), "id", F.col("t"))
    fresh = fulltext.refresh(fulltext.postings(tok), changed, spark.createDataFrame([(3,)], "doc long"))
    assert {(r.term, r.doc) for r in fresh.collect()} == {("the", 1), ("cat", 1), ("sat", 1), ("cat", 2)}


def test_symbol_scores(spark):
    s = spark.createDataFrame([("refresh_access_token", "function", 4), ("Token", "type", 0), ("tokenize", "function", 9)], "name string, kind string, in_degree long").select("*", F.lit("p").alias("path"), F.lit(1).alias("line_start"), F.lit("x").alias("signature"))
    assert [r.name for r in retrieve.symbol_candidates(s, ["refresh", "token"], 5).collect()] == ["refresh_access_token", "Token", "tokenize"]
    assert retrieve.symbol_candidates(s, ["token"], 5).first().name == "Token" and retrieve.symbol_candidates(s, ["token"], 5, kind="function", per_term=1).count() == 1
    assert [r.name for r in retrieve.search_names(s, "TOKEN", 5).collect()] == ["Token", "tokenize", "refresh_access_token"]
    assert retrieve.search_names(s, "t_k", 5).count() == 0 and retrieve.search_names(s, "t_k", 5, like_compat=True).count() == 3


def two_triangles(spark):
    e = [("00", "01"), ("01", "02"), ("00", "02"), ("12", "10"), ("11", "12"), ("10", "11"), ("00", "10"), ("00", "00")]
    return spark.createDataFrame(e, "a string, b string")


def test_communities_of_two_triangles(spark):
    pairs = C.pair_weights(two_triangles(spark))
    found = C.communities(pairs)
    assert {(r.node, r.community) for r in found.collect()} == {*((f"0{i}", 0) for i in range(3)), *((f"1{i}", 1) for i in range(3))} and all(r.exact for r in found.collect())
    assert C.adjacent_modularity(pairs, found).first()[0] > 0
    (b,) = C.bridges(pairs, found).collect()
    assert (b.a, b.b, b.edge_count) == ("00", "10", 1) and C.god_nodes(pairs, 2).count() == 2
    coarse = C.communities(pairs, exact_nodes=2)
    assert not any(r.exact for r in coarse.collect()) and coarse.count() == 6


def test_postings_are_those_of_each_document(spark):
    texts = {1: ["b", "a", "b"], 2: [], 3: ["é", "a", "a", "é"], 4: None, 7: ["x"] * 5}
    tok = spark.createDataFrame(list(texts.items()), "doc long, tokens array<string>").repartition(1)
    want = {(t, d, len(w), w.count(t), tuple(i for i, x in enumerate(w) if x == t)) for d, w in texts.items() for t in w or []}
    posts = fulltext.postings(tok)
    assert {(r.term, r.doc, r.len, r.tf, tuple(r.positions)) for r in posts.collect()} == want and posts.count() == len(want)
    assert [t for _, t in posts.dtypes] == ["string", "bigint", "bigint", "bigint", "array<int>"]
    assert {tuple(r) for r in fulltext.document_frequency(tok).collect()} == {("a", 2, 3), ("b", 1, 2), ("é", 1, 2), ("x", 1, 5)}
    named = spark.createDataFrame([("k", ["a", "a"])], "doc string, tokens array<string>")
    assert [tuple(r) for r in fulltext.postings(named).collect()] == [("a", "k", 2, 2, [0, 1])]


def test_an_index_splits_its_texts_once_for_postings(spark, tmp_path):
    """Of a range-partitioned write the postings were made twice: once more to find the ranges."""
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: seen.add(1) or x, "array<string>").asNondeterministic()
    tok = spark.createDataFrame([(k, ["a", "b"]) for k in range(10)], "doc long, tokens array<string>").withColumn("tokens", mark("tokens"))
    fulltext.laid_out(tok).write.parquet(str(tmp_path / "posts"))
    assert seen.value == 10 and spark.read.parquet(str(tmp_path / "posts")).count() == 20


def test_innermost_ranges_meet_points_in_buckets(spark):
    import random

    rng = random.Random(3)
    ranges = [(rng.randrange(2), k, b := rng.randrange(-300, 300), b + rng.choice([0, 1, 7, 8, 90, 500, -3])) for k in range(300)]
    points = [(rng.randrange(2), k, rng.randrange(-310, 900)) for k in range(300)]
    inside = {(k, p): [(e - b, b, i) for j, i, b, e in ranges if j == k and b <= at <= e] for k, p, at in points}
    want = {(k, p, min(found)[2]) for (k, p), found in inside.items() if found}
    found = metrics.innermost(spark.createDataFrame(ranges, "k int, range_id long, begin long, end long"), spark.createDataFrame(points, "k int, point_id long, at long"), "k")
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    assert "__bucket" in next(x for x in plan(found).splitlines() if "Join" in x)


def test_ranges_that_are_equal_merge_once(spark):
    rows = [("k", 1, 5), ("k", 1, 5), ("k", 7, 9), ("k", 7, 9), ("k", 6, 6), ("k", 12, 13), ("k", 12, 13)]
    assert sorted((x.begin, x.end) for x in metrics.merge_ranges(spark.createDataFrame(rows, "k string, begin long, end long"), "k").collect()) == [(1, 9), (12, 13)]


def test_bridges_are_counted_without_a_sort(spark):
    members = spark.createDataFrame([("a1", 1), ("a2", 1), ("b1", 2), ("b2", 2), ("c1", 3)], "node string, community int")
    edges = [("b2", "a2"), ("a1", "b2"), ("b1", "a2"), ("c1", "a2"), ("c1", "a1"), ("b1", "c1"), ("a1", "a2")]
    found = C.bridges(C.pair_weights(spark.createDataFrame(edges, "a string, b string")), members)
    assert [tuple(r) for r in found.collect()] == [(2, 3, 1, "b1", "c1"), (1, 3, 2, "a1", "c1")] and "SortAggregate" not in plan(found)
    many = C.bridges(C.pair_weights(spark.createDataFrame(edges, "a string, b string")), members, most=3)
    assert [tuple(r) for r in many.collect()][-1] == (1, 2, 3, "a1", "b2")


def test_exported_pairs_are_made_once(spark):
    from rootweave.plans import registry

    assert "lineitem" not in plan(registry.QUERIES["export_dot_edges"](spark, "/root/testdata/sf0.001"))


def test_a_large_component_takes_the_same_moves(spark):
    ids = F.col("id").cast("string")
    corners = [(F.lit("hub"), F.concat(F.lit("a"), ids)), *((F.concat(F.lit(x), ids), F.concat(F.lit(y), ids)) for x, y in ("ab", "ac", "bc"))]
    pairs = C.pair_weights(spark.range(70_000).select(F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in corners])).alias("e")).select("e.a", "e.b"))
    rows = [tuple(r) for r in pairs.collect()]
    want = C.local_moves(rows, 2 * sum(w for *_, w in rows))
    found = C.communities(pairs).collect()
    assert len(found) == len(want) == 210_001 and all(r.exact for r in found)
    first = {}
    assert all(first.setdefault(r.community, want[r.node]) == want[r.node] for r in found) and len(first) == len(set(want.values()))


def test_components_and_moves_by_part(spark):
    import random

    rng = random.Random(2)
    edges = [(f"{k}-{rng.randrange(9)}", f"{k}-{rng.randrange(9)}") for k in range(6) for _ in range(14)]
    pairs = C.pair_weights(spark.createDataFrame(edges, "a string, b string"))
    rows = [(r.a, r.b, r.w) for r in pairs.collect()]
    whole = C.local_moves(rows, 2 * sum(w for *_, w in rows))
    groups = lambda x: {frozenset(n for n in x if x[n] == c) for c in set(x.values())}
    assert groups({r.node: r.community for r in C.communities(pairs).collect()}) == groups(whole)


def test_steps_beyond_memory_are_read_from_a_file(monkeypatch):
    """A component's steps come in batches; however few of them are held, moves are those of the whole graph in memory."""
    import random

    import pyarrow as pa

    rng = random.Random(5)
    edges = {(a, b): rng.randrange(1, 9) for a, b in ((rng.randrange(40), rng.randrange(40, 80)) for _ in range(500))} | {(0, k): 1 for k in range(80, 300)}
    two_m = 2 * sum(edges.values())
    rows = sorted((0, v, u, w) for (a, b), w in edges.items() for v, u in ((a, b), (b, a)))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 37])], names=["component", "v", "u", "w"]) for k in range(0, len(rows), 37)]
    want = {int(v): int(h) for v, h in C.local_moves([(f"{a:03}", f"{b:03}", w) for (a, b), w in edges.items()], two_m).items()}
    for held, block in ((1 << 20, 1 << 20), (100, 64)):
        monkeypatch.setattr(C, "HELD_STEPS", held)
        monkeypatch.setattr(C, "BLOCK_STEPS", block)
        got = [b.to_pydict() for b in C.moved_components(batches, two_m)]
        assert {v: h for b in got for v, h in zip(b["v"], b["label"])} == want


def test_summary_and_labels(spark):
    nodes = spark.createDataFrame([(f"{a}{i}", "symbol" if i else "file", f"n{a}{i}", ("src/auth/a.py" if a == "0" else "tests/b.py")) for a in "01" for i in range(3)], "key string, kind string, name string, path string")
    s = C.summary(two_triangles(spark), nodes)
    assert s["node_count"] == 6 and s["edge_count"] == 7 and s["community_count"] == 2 and [c["label"] for c in s["communities"]] == ["src/auth", "tests"]
    assert s["surprising"][0]["edge_count"] == 1 and "How is `src/auth` connected to `tests`?" in s["questions"] and "**Hubs:**" in render.markdown_architecture(s)


def test_updates(spark):
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("c", 1, 1, "z"), ("d", 1, 1, "w"), ("e", 1, 1, "v")], "path string, mtime_ns long, size_bytes long, sha256 string")
    now = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y"), ("c", 2, 2, "Z"), ("n", 1, 1, "n"), ("e", 1, 1, "V")], old.schema)
    diff = M.fingerprint_diff(old, now)
    assert {(r.path, r.change) for r in diff.collect()} == {("b", "touched"), ("c", "modified"), ("d", "removed"), ("n", "added")}
    assert M.freshness(diff).first().files_changed_since_build == 3 and tuple(M.update_counts(diff, now).first()) == (2, 3, 1)
    assert ("e", "modified") in {(r.path, r.change) for r in M.fingerprint_diff(old, now, check_all=True).collect()}
    assert M.freshness(M.fingerprint_diff(old, old)).first().stale is False
    f = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, path string")
    c = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "file_id long, content string")
    left = M.delete_files({"files": f, "chunks": c}, spark.createDataFrame([("b",)], "path string"))
    assert left["files"].count() == 1 and left["chunks"].count() == 1
    new = M.replace_files({"files": f, "chunks": c}, {"files": f.where("file_id = 2"), "chunks": c.limit(0)})
    assert new["files"].count() == 2 and [r.content for r in new["chunks"].collect()] == ["x"]
    assert sorted(map(tuple, M.upsert(f, spark.createDataFrame([(2, "B"), (3, "c")], f.schema), "file_id").collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_health(spark, index):
    cover = M.language_coverage(index["files"], index["symbols"])
    assert {(r.lang, r.files, r.symbols) for r in cover.collect()} == {("python", 3, 6), ("typescript", 1, 1)}
    fresh = M.freshness(M.fingerprint_diff(index["files"], index["files"]))
    from rootweave.functions import paths as P

    assert {(r.id, r.ok) for r in M.findings(fresh, cover, P.graph_tier(F.col("lang"))).collect()} == {("index_fresh", True), ("symbol_extraction", True), ("graph_coverage", True)}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 3), ("q3", "z", 1)], "query string, item string, rank int")
    truth = spark.createDataFrame([("q1", "b"), ("q2", "c"), ("q3", "x")], "query string, item string")
    got = {r.query: (r.recall, round(r.rr, 4), round(r.ndcg, 4)) for r in metrics.per_query(ranked, truth, 2).collect()}
    assert got == {"q1": (1.0, 0.5, 0.6309), "q2": (0.0, 0.3333, 0.0), "q3": (0.0, 0.0, 0.0)}
    assert metrics.means(metrics.per_query(ranked, truth, 3)).first().queries == 3
    r = spark.createDataFrame([("k", 1, 3), ("k", 4, 5), ("k", 7, 9), ("k", 8, 8)], "k string, begin long, end long")
    assert sorted((x.begin, x.end) for x in metrics.merge_ranges(r, "k").collect()) == [(1, 5), (7, 9)]


def test_bursts_batch_and_stream(spark, tmp_path):
    rows = [("f", "2024-01-01 00:00:00"), ("f", "2024-01-01 00:00:00.3"), ("f", "2024-01-01 00:00:02"), ("g", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    want = sorted((r.path, r.events) for r in watch.bursts(df, "path").collect())
    assert want == [("f", 1), ("f", 2), ("g", 1)]
    late = spark.createDataFrame([("z", "2024-01-02 00:00:00")], "path string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in/0"))
    late.coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = watch.bursts(stream, "path", watermark="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = sorted((r.path, r.events) for r in spark.table("bursts").where("path <> 'z'").collect())
    assert set(got) <= set(want)
    seen = []
    w = watch.watch(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*")), lambda p: seen.extend(r.path for r in p.collect()), str(tmp_path / "c2"), once=True)
    w.awaitTermination(120)
    assert set(seen) == {"f", "g", "z"}


def test_exports(spark, tmp_path, index):
    nodes = G.nodes(index["files"], index["symbols"])
    shown = render.shown_edges(index["edges"], nodes, spark.createDataFrame([("src/api/service.py",)], "path string"))
    assert shown.count() == 4
    info = nodes.select("key", "kind", "name", "path", F.lit(0).alias("community"), F.lit(1).alias("degree"))
    for form, mark in (("dot", "digraph"), ("graphml", "<graphml"), ("cypher", "MERGE")):
        render.export_graph(shown, info, str(tmp_path / form), form)
        text = "\n".join(r.value for r in spark.read.text(str(tmp_path / form)).collect())
        assert mark in text and text.count("->" if form == "dot" else "<edge" if form == "graphml" else "]->(b)") == 4
    page = render.html(shown, info, "a <b>")
    assert "a &lt;b>" in page and json.loads(page.split('application/json">')[1].split("</script>")[0].replace("<\\/", "</"))["edges"]
    assert "| path |" in render.markdown_rows("Files", index["files"].select("path")) and "_Nothing found._" in render.markdown_rows("None", index["files"].where("false"))
    with pytest.raises(ValueError, match="form"):
        render.export_graph(shown, info, str(tmp_path / "x"), "svg")


def test_token_helpers_agree(spark):
    df = spark.createDataFrame([("The refresh_token's HTTPServer",)], "t string")
    assert df.select(T.tokens(F.col("t"))).first()[0] == ["the", "refresh", "token", "s", "httpserver"]
