import subprocess

import pytest
from test_operators import REPO

from rootweave import config as cfg
from rootweave import storage
from rootweave.operators import embedding, parse, render
from rootweave.plans import indexing, service
from rootweave.sources import git


def run_git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


class Concepts:
    enabled, name, dim, calls = True, "concepts", 4, 0

    def embed(self, texts):
        return [[float(any(w in t.lower() for w in ws)) for ws in (("auth", "token"), ("user",), ("db",), ("http",))] for t in texts]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in REPO.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (root / ".gitignore").write_text(".rootweave/\n")
    run_git(root, "init", "-q")
    run_git(root, "add", "-A")
    run_git(root, "commit", "-qm", "one")
    config = cfg.load(str(root))
    folder = str(root / ".rootweave" / "index")
    stats = indexing.build(spark, folder, config)
    return root, folder, config, stats, service.Service(spark, folder, config)


def test_build(made):
    root, folder, config, stats, s = made
    assert {k: stats[k] for k in ("indexed", "symbols", "failures", "deleted", "edges_resolved", "vectors")} == {"indexed": 5, "symbols": 7, "failures": 0, "deleted": 0, "edges_resolved": 5, "vectors": 0}
    meta = indexing.get_meta(folder)
    assert meta["head_commit"] == git.head(str(root)) and meta["config_hash"] == config.digest() and indexing.peek_schema_version(folder) == 1 and storage.current_version(folder) == 1
    assert s.state() == {"exists": True, "stale": False, "files_changed_since_build": 0, "built_at": meta["built_at"], "head_commit": meta["head_commit"]}
    assert s.stats()["files"] == 5 and {(r["lang"], r["files"], r["symbols"], r["graph"]) for r in s.stats()["coverage"]} == {("python", 3, 6, "full"), ("typescript", 1, 1, "full")}


def test_answers(made):
    root, folder, config, _, s = made
    found = s.search("token")
    assert found["results"][0]["path"] == "src/auth/token.py" and found["index"]["exists"] and list(found)[:8] == ["query", "intent", "mode", "index", "confidence", "results", "recommended_reads", "fallback_suggestions"]
    assert s.explain("login")["intent"] == "how_it_works"
    hit = s.impact("src/models/user.py")
    assert [x["path"] for x in hit["files"]] == ["src/api/service.py"] and hit["coverage"] == {"partial": False, "languages": [], "reason": None}
    assert "service.py" in render.markdown_impact(hit) and "isn't known" in render.markdown_impact(s.impact("nothing"))
    way = s.path("renew", "refresh_access_token")
    assert way["found"] and way["hops"] == 1 and way["steps"] == [{"edge_type": "call", "confidence": "extracted", "direction": "out"}] and [n["name"] for n in way["nodes"]] == ["renew", "refresh_access_token"]
    assert "→ call" in render.markdown_path(way) and not s.path("renew", "zzz")["found"] and "No edges" in render.markdown_path(s.path("bootstrap", "renew"))
    card = s.describe("refresh_access_token")
    assert card["primary"]["in_degree"] == 2 and {c["path"] for c in card["callers"]} == {"src/auth/token.py", "src/api/service.py"} and card["primary"]["module"] == "src/auth"
    assert "Called from (2)" in render.markdown_describe(card) and "No symbol" in render.markdown_describe(s.describe("zzz"))
    a = s.architecture()
    assert a["available"] and a["node_count"] > 4 and a["god_nodes"] and not service.Service(s.spark, str(root / "none"), config).architecture()["available"]
    checks = {r["id"]: r["ok"] for r in s.doctor()}
    assert checks == {"cache_ignored": True, "hooks_enabled": False, "index_fresh": True, "symbol_extraction": True, "graph_coverage": True}
    assert s.health()["index"]["exists"] and not service.Service(s.spark, str(root / "none"), config).health()["index"]["exists"]
    shown = s.graph("src/models/user.py")
    assert {r.key for r in shown["nodes"].collect()} >= {"file::src/models/user.py"} and shown["nodes"].where("degree > 0 AND community >= 0").count() == shown["nodes"].count() > 0


def test_update_and_diff(spark, made):
    root, folder, config, _, s = made
    assert indexing.update(spark, folder, config) == {"indexed": 0, "skipped": 5, "deleted": 0, "edges_resolved": 0, "vectors": 0}
    (root / "src/auth/token.py").write_text(REPO["src/auth/token.py"] + "\n\ndef logout():\n    return login(1, 2)\n")
    (root / "src/new.py").write_text("from models.user import User\n\n\nclass Guest(User):\n    pass\n")
    (root / "web/app.ts").unlink()
    (root / "docs/notes.md").touch()
    diff = s.diff_impact()
    assert diff["changed_files"] == ["src/auth/token.py", "web/app.ts"] and [(a["path"], a["changed_by"]) for a in diff["affected_files"]] == [("src/api/service.py", ["src/auth/token.py"])]
    assert not diff["truncated"] and diff["index"]["files_changed_since_build"] == 3 and "Affected (1)" in render.markdown_diff(diff)
    few = s.diff_impact(max_files=1)
    assert few["truncated"] and few["changed_files_total"] == 2 and few["changed_files"] == ["src/auth/token.py"] and "only the first 1" in render.markdown_diff(few)
    stats = indexing.update(spark, folder, config)
    assert (stats["indexed"], stats["skipped"], stats["deleted"]) == (2, 3, 1)
    names = {(r.path, r.name) for r in s.tables()["symbols"].collect()}
    assert ("src/auth/token.py", "logout") in names and ("src/new.py", "Guest") in names and ("web/app.ts", "bootstrap") not in names
    assert s.impact("src/models/user.py")["files"][0]["path"] == "src/api/service.py" and len(s.impact("src/models/user.py")["files"]) == 2 and not s.state()["stale"]
    assert any(r["path"] == "src/auth/token.py" for r in s.search("logout")["results"]) and indexing.get_meta(folder, "updated_at")
    (root / "src/new.py").write_text("x = 1\n")
    (root / "src/models/user.py").write_text("y = 2\n")
    run_git(root, "add", "src/new.py")
    run_git(root, "commit", "-qm", "two")
    scoped = indexing.update(spark, folder, config, since="HEAD", check_all=True)
    assert (scoped["indexed"], scoped["deleted"]) == (1, 0) and ("src/new.py", "Guest") in {(r.path, r.name) for r in s.tables()["symbols"].collect()}
    with pytest.raises(ValueError, match="revision"):
        indexing.update(spark, folder, config, since="--output=x")


def test_vectors_are_made_once(spark, made, tmp_path):
    _, _, config, _, _ = made
    folder = str(tmp_path / "index")
    first = indexing.build(spark, folder, config, Concepts())
    again = indexing.build(spark, folder, config, Concepts())
    t = indexing.opened(spark, folder)
    assert first["vectors"] > 0 and again["vectors"] == 0 and t["vectors"].count() == t["chunks"].count() and t["vector_meta"].first()[:2] == ("concepts", 4)
    out = service.Service(spark, folder, config).search("token", mode="vector", vector=[1.0, 0.0, 0.0, 0.0])
    assert out["results"]


def test_backends(monkeypatch):
    c = cfg.Config()
    assert not embedding.backend_of(c).enabled and isinstance(embedding.Noop(), embedding.Backend)
    c.embeddings = cfg.Embeddings(enabled=True, backend="external")
    monkeypatch.delenv(embedding.KEY_VARIABLE, raising=False)
    for ready in (lambda: setattr(c.embeddings, "allow_external", True), lambda: monkeypatch.setenv(embedding.KEY_VARIABLE, "k"), lambda: setattr(c.embeddings, "endpoint", "http://e")):
        with pytest.raises(embedding.EmbeddingError):
            embedding.backend_of(c)
        ready()
    told = []
    b = embedding.backend_of(c, told.append, lambda e, k, m, t: [[1, 2] for _ in t])
    assert b.embed(["a", "b"]) == [[1.0, 2.0]] * 2 and b.dim == 2 and "http://e" in told[0] and b.embed([]) == []
    with pytest.raises(embedding.EmbeddingError):
        embedding.External("e", "k", "m", lambda *_: []).embed(["x"])


def test_config(tmp_path, monkeypatch):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".rootweave").mkdir()
    (tmp_path / ".rootweave" / "config.json").write_text('{"max_file_bytes": 7, "retrieval": {"limit": 3}, "other": 1}')
    assert cfg.find_root(str(inner)) == str(tmp_path)
    c = cfg.load(str(tmp_path))
    assert (c.max_file_bytes, c.retrieval.limit, c.retrieval.rrf_k, c.root) == (7, 3, 60, str(tmp_path))
    monkeypatch.setenv(cfg.MAX_BYTES_VARIABLE, "9")
    d = cfg.load(str(tmp_path))
    assert d.max_file_bytes == 9 and d.digest() != c.digest() == cfg.Config(root=str(tmp_path), max_file_bytes=7).digest()
    with pytest.raises(ValueError, match="mode"):
        cfg._filled(cfg.Config, {"retrieval": {"default_mode": "best"}})


def test_guard_and_git(tmp_path):
    folder = str(tmp_path / "i")
    assert indexing.peek_schema_version(folder) == 0 and git.head(str(tmp_path)) is None and git.changed_since(str(tmp_path), "HEAD") == set()
    indexing.set_meta(folder, schema_version=99, a=1)
    indexing.set_meta(folder, a=2)
    assert indexing.get_meta(folder, "a") == 2
    with pytest.raises(RuntimeError, match="newer"):
        indexing.guard(folder)
    for bad in ("", "-x", "a\0b"):
        with pytest.raises(ValueError, match="revision"):
            git.diff_targets(str(tmp_path), bad)


def test_generic_symbols(spark):
    assert [parse.generic_kind(w) for w in ("class_declaration", "struct_item", "EnumSpecifier", "fn", "namespace_definition")] == ["class", "struct", "enum", "function", "namespace"]
    text = "module Shapes\npublic class Box {\n  func area(x) {\n    return side(x)\n  }\n}\nsub helper\n"
    found, edges = parse.pattern_symbols(text, "swift")
    assert [(s["name"], s["kind"]) for s in found] == [("Shapes", "module"), ("Box", "class"), ("area", "method" if found[2]["parent"] is not None else "function"), ("helper", "function")]
    parse.register("toy", [(r"^thing\s+(\w+)", "type")], imports=r"^load (\w+)")
    try:
        found, edges = parse.pattern_symbols("load base\nthing Lamp\n", "toy")
        assert [(s["name"], s["kind"]) for s in found] == [("Lamp", "type")] and [(e["type"], e["name"]) for e in edges] == [("import", "base")]
    finally:
        del parse.DECLARATIONS["toy"], parse.IMPORTS["toy"]
