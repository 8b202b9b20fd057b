"""What a tool or a command answers from a stored index: payloads of plain values, all of bounded size."""

from __future__ import annotations

import json
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave import storage
from rootweave.config import Config
from rootweave.functions import paths as P
from rootweave.operators import graph, render
from rootweave.operators import tables as M
from rootweave.plans import indexing, search
from rootweave.sources import git

#: Callers, callees and affected nodes that a payload lists.
MOST = 200


def _rows(df: DataFrame, most: int = MOST) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


class Service:
    """Answers from the index in `folder` of the tree that the config names."""

    def __init__(self, spark: SparkSession, folder: str, config: Config) -> None:
        self.spark, self.folder, self.config = spark, folder, config

    @property
    def exists(self) -> bool:
        return storage.current_version(self.folder) > 0

    def tables(self) -> dict[str, DataFrame]:
        return indexing.opened(self.spark, self.folder)

    def state(self) -> dict:
        return indexing.freshness(self.spark, self.folder, self.config)

    def _graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        t = self.tables()
        return t["edges"], t["files"], t["symbols"].drop("in_degree", "out_degree")

    def search(self, query: str, **how: object) -> dict:
        r = self.config.retrieval
        own = {"limit": r.limit, "mode": r.default_mode, "skeleton": r.compact_snippets, "min_reduction": r.compact_min_reduction}
        return search.search(self.tables(), query, **(own | how), state=self.state())

    def explain(self, query: str) -> dict:
        return self.search(search.explain_query(query), limit=10, budget=2200, mode="hybrid")

    def impact(self, target: str, depth: int | None = None, direction: str = "up") -> dict:
        e, f, s = self._graph()
        depth = depth or self.config.graph.max_depth
        found = graph.impact_response(target, e, f, s, depth, direction)
        return {"target": target, "direction": direction, "depth": depth, "nodes": _rows(found["nodes"]), "files": _rows(found["files"]), "coverage": found["coverage"].first().asDict()}

    def diff_impact(self, ref: str = "HEAD", depth: int = 2, direction: str = "up", max_files: int = 200) -> dict:
        """What the changes since a revision reach. A cut to max_files changed paths is reported as truncated."""
        if direction not in ("up", "down", "both") or depth < 1 or max_files < 1:
            raise ValueError("direction must be up, down or both, depth and max_files 1 at least")
        root = Path(self.config.root)
        own = Path(self.folder).resolve()
        commit, paths = git.diff_targets(str(root), ref, own.relative_to(root.resolve()).as_posix() if own.is_relative_to(root.resolve()) else None)
        e, f, s = self._graph()
        chosen = paths[:max_files]
        hit = graph.diff_impact(self.spark.createDataFrame([(p,) for p in chosen], "path string"), e, f, s, None, direction, depth)
        total = hit.summary.first()
        return {
            "base_ref": ref, "base_commit": commit, "direction": direction, "depth": depth, "index": self.state(),
            "changed_files": chosen, "changed_files_total": len(paths), "truncated": len(paths) > max_files,
            "unresolved_files": [r["path"] for r in hit.unresolved.collect()], "affected_files": [r.asDict() for r in hit.affected.collect()],
            "coverage": {k: total[k] for k in ("partial", "languages", "reason")},
        }

    def path(self, src: str, dst: str) -> dict:
        e, f, s = self._graph()
        ends = [graph.seeds(x, f, s, with_symbols=False) for x in (src, dst)]
        for name, end in zip((src, dst), ends):
            if end.isEmpty():
                return {"src": src, "dst": dst, "found": False, "reason": f"Nothing is named {name}."}
        found = graph.shortest_path(e, *ends).first()
        if found is None:
            return {"src": src, "dst": dst, "found": False, "reason": "No edges lead from one to the other."}
        at = [(found["src_kind"], found["src_id"]), *((x["next_kind"], x["next_id"]) for x in found["steps"])]
        known = {(r["kind"], r["id"]): r.asDict() for r in graph.nodes(f, s).join(F.broadcast(self.spark.createDataFrame(at, "kind string, id long").distinct()), ["kind", "id"]).collect()}  # a path's nodes
        steps = [{"edge_type": x["edge_type"], "confidence": x["confidence"], "direction": x["way"]} for x in found["steps"]]
        return {"src": src, "dst": dst, "found": True, "hops": found["hops"], "nodes": [known[k] for k in at], "steps": steps}

    def describe(self, name: str) -> dict:
        e, f, s = self._graph()
        gods = (indexing.get_meta(self.folder, "analysis") or {}).get("god_nodes") or []
        ranked = self.spark.createDataFrame([(str(k), g["name"], g["path"], g["degree"]) for k, g in enumerate(gods)], "key string, name string, path string, degree long") if gods else None
        card = graph.node_card(name, e, f, s, ranked)
        primary = card["primary"].first()
        if primary is None:
            return {"query": name, "found": False, "reason": f"No symbol is named {name}."}
        return {"query": name, "found": True, "primary": primary.asDict(), **{k: _rows(card[k]) for k in ("definitions", "callers", "callees")}}

    def architecture(self) -> dict:
        """The analysis that the last build left, with the state of the index."""
        summary = indexing.get_meta(self.folder, "analysis") if self.exists else None
        if not summary:
            return {"exists": self.exists, "available": False, "reason": "The index holds no analysis: build it again.", "index": self.state()}
        return {"exists": True, "available": True, "index": self.state(), **summary}

    def stats(self) -> dict:
        t = self.tables()
        coverage = M.language_coverage(t["files"], t["symbols"]).withColumn("graph", P.graph_tier(F.col("lang")))
        counts = {k: t[k].count() for k in ("files", "symbols", "chunks", "edges")}
        meta = indexing.get_meta(self.folder)
        return {"exists": True, **counts, "built_at": meta.get("built_at"), "head_commit": meta.get("head_commit"), "coverage": _rows(coverage)}

    def doctor(self, settings: str = ".claude/settings.json", command: str = "rootweave") -> list[dict]:
        """Checks as (id, ok, severity, detail): is the index ignored by git, do hooks update it, is it fresh, do parsed languages give symbols, are graphs whole."""
        root = Path(self.config.root)
        own = Path(self.folder).resolve()
        line = own.relative_to(root.resolve()).as_posix() if own.is_relative_to(root.resolve()) else None
        rules = {x.strip().strip("/") for x in (root / ".gitignore").read_text("utf-8").splitlines()} if (root / ".gitignore").is_file() else set()
        ignored = line is None or any(x.as_posix() in rules for x in (Path(line), *Path(line).parents))
        out = [{"id": "cache_ignored", "ok": ignored, "severity": "high", "detail": "the index is out of version control" if ignored else f"add {line} to .gitignore"}]
        found = hooks(root / settings, command)
        out.append({"id": "hooks_enabled", "ok": bool(found), "severity": "info", "detail": "; ".join(found) or "no hook updates the index"})
        if not self.exists:
            return [*out, {"id": "index_fresh", "ok": False, "severity": "medium", "detail": "there is no index"}]
        state, t = self.state(), self.tables()
        fresh = self.spark.createDataFrame([(state["stale"], state["files_changed_since_build"])], "stale boolean, files_changed_since_build long")
        return out + _rows(M.findings(fresh, M.language_coverage(t["files"], t["symbols"]), P.graph_tier(F.col("lang"))))

    def health(self) -> dict:
        """The package's version, the root, and whether there is an index and how fresh it is."""
        try:
            own = version("rootweave")
        except PackageNotFoundError:
            own = "0"
        return {"package_version": own, "root": self.config.root, "index": {"path": self.folder, **self.state()}}

    def graph(self, target: str | None = None, depth: int | None = None) -> dict[str, DataFrame]:
        """The edges to show (of what a target's change reaches, if one is given) and their nodes with module and degree."""
        e, f, s = self._graph()
        paths = None
        if target is not None:
            paths = graph.impact(target, e, f, s, depth or self.config.graph.max_depth)[1].select("path").unionByName(self.spark.createDataFrame([(target,)], "path string"))
        edges = storage.stored(render.shown_edges(e, graph.nodes(f, s), paths))
        return {"edges": edges, "nodes": render.shown_graph(edges)}


def hooks(settings: Path, command: str) -> list[str]:
    """The events of a settings file whose hooks run a command."""
    try:
        events = json.loads(settings.read_text("utf-8")).get("hooks", {})
    except (OSError, ValueError):
        return []
    runs = lambda x: command in x if isinstance(x, str) else any(map(runs, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else False
    return sorted(name for name, body in events.items() if runs(body))

