"""Planning and running a hybrid search: intent, retrievers, fusion, reranking, budget and page."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions import text as T
from rootweave.operators import fulltext, fuse, retrieve
from rootweave.plans.snippets import compact

SOURCES = ("symbol", "path", "fts", "vector")
#: Intent: (pattern, weights of the sources, token budget), tried in this order.
INTENTS: dict[str, tuple[str, tuple[float, ...], int]] = {
    "debug_error": (r"error:|exception|why does .* fail|stack ?trace|traceback", (0.6, 0.3, 1.0, 0.4), 1800),
    "find_refs": (r"\b(callers of|references to|find references|who calls)\b", (1.0, 0.2, 0.3, 0.2), 1500),
    "impact": (r"\b(affected if|impact of|what (?:depends on|breaks))\b", (1.0, 0.6, 0.3, 0.3), 1800),
    "data_flow": (r"\b(trace .* flow|data ?flow|where does .* get set)\b", (0.9, 0.3, 0.8, 0.6), 2000),
    "architecture": (r"\b(overview|structure of|high-?level|architecture)\b", (0.4, 0.5, 0.6, 0.5), 2500),
    "how_it_works": (r"\b(explain how|how (?:do|does|.* works?))\b", (0.7, 0.3, 1.0, 0.8), 2200),
    "locate_impl": (r"\b(defined|implementation of|find the|locate|where is)\b", (1.0, 0.7, 0.4, 0.2), 1500),
}
KEYWORD = ((0.6, 0.5, 1.0, 0.7), 1500)
KINDS = {k + s: k for k in ("method", "function", "interface", "enum", "type") for s in ("", "s")} | {"class": "class", "classes": "class"}
#: Candidates that each retriever gives for a row of the page: those beyond the page's end only tell whether there is a next page.
LOOKAHEAD = 4
#: What a result shows of a ranked row as it is.
SHOWN = ("path", "line_start", "line_end", "reason", "snippet", "token_est", "elided_lines", "skeletonized")
SHAPES = ("architecture", "how_it_works", "data_flow")


@dataclass
class Plan:
    intent: str
    weights: dict[str, float]
    budget: int
    kind: str | None = None
    terms: list[str] = field(default_factory=list)


def plan(query: str) -> Plan:
    """All matching intents merged: the first is named, the greatest weights and budget hold."""
    hit = [(name, w, b) for name, (pattern, w, b) in INTENTS.items() if re.search(pattern, query, re.IGNORECASE)] or [("keyword", *KEYWORD)]
    weights = {s: max(w[i] for _, w, _ in hit) for i, s in enumerate(SOURCES)}
    return Plan(hit[0][0], weights, max(b for _, _, b in hit), requested_kind(query), T.salient_terms(query))


def requested_kind(query: str) -> str | None:
    """The symbol kind that a query asks for, if it names exactly one."""
    kinds = {KINDS[w] for w in re.findall(r"[a-z]+", query.lower()) if w in KINDS}
    return kinds.pop() if len(kinds) == 1 else None


def intent_of(query: Column) -> Column:
    """The primary intent of a column of queries."""
    out = F.lit("keyword")
    for name, (pattern, _, _) in reversed(INTENTS.items()):
        out = F.when(query.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def explain_query(query: str) -> str:
    return query if re.search(r"\b(how|architecture|overview)\b", query, re.IGNORECASE) else f"how does {query} work"


def candidates(index: dict[str, DataFrame], query: str, p: Plan, limit: int, mode: str = "hybrid", vector: list[float] | None = None) -> DataFrame | None:
    """The union of the retrievers' lists. index has files, symbols (with degrees), chunks, edges and, if any, vectors, and postings with corpus."""
    spark, files = index["files"].sparkSession, index["files"]
    shape = spark.createDataFrame([], fuse.CANDIDATE)
    lists: list[DataFrame] = []
    flags = files.select("file_id", "path", "is_generated")
    if mode in ("hybrid", "symbol") and p.terms:
        found = retrieve.symbol_candidates(index["symbols"], p.terms, limit, p.kind)
        found = retrieve.with_reference_counts(found, index["edges"]).join(files.select("file_id", "is_generated"), "file_id")
        lists.append(found.select("path", "line_start", "line_end", F.lit("symbol").alias("source"), (F.col("score") + F.col("tightness") * 1e-3 + F.least("in_degree", F.lit(1_000_000)) * 1e-9).alias("score"), "kind", F.col("name").alias("symbol"), F.col("signature").alias("content"), T.token_floor(F.coalesce("signature", F.lit(""))).alias("token_est"), "in_degree", "out_degree", "ref_count", "is_generated", F.col("is_exact").alias("exact_symbol")))
    if mode in ("hybrid", "fts") and (groups := T.match_groups(query)):
        # An underscore separates full-text tokens, so an identifier is a phrase of its parts.
        groups = [[" ".join(x for x in v.split("_") if x) for v in g] for g in groups]
        if "postings" in index:
            scored = fulltext.bm25_indexed(fulltext.Index(index["postings"], index["corpus"]), groups)
        else:
            scored = fulltext.bm25(fulltext.tokenised(index["chunks"], "chunk_id", F.concat_ws(" ", "content", "symbol_names")), groups)
        best = fulltext.top(scored, limit, "doc").withColumnRenamed("doc", "chunk_id")
        hits = index["chunks"].select("chunk_id", "file_id", "line_start", "line_end", "kind", "content", "token_est", "symbol_names").join(F.broadcast(best), "chunk_id").join(flags, "file_id")  # limit rows
        lists.append(hits.select("path", "line_start", "line_end", F.lit("fts").alias("source"), "score", "kind", F.expr("nullif(symbol_names, '')").alias("symbol"), "content", "token_est", F.lit(0).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"), F.lit(0).cast("long").alias("ref_count"), "is_generated", F.lit(False).alias("exact_symbol")))
    if mode == "hybrid" and (parts := re.findall(r"[^\s/.\\]+", query)):
        found = retrieve.path_candidates(flags, parts, limit)
        lists.append(found.select("path", F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("path").alias("source"), "score", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("token_est"), F.lit(0).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"), F.lit(0).cast("long").alias("ref_count"), "is_generated", F.lit(False).alias("exact_symbol")))
    if mode in ("hybrid", "vector") and vector is not None and "vectors" in index:
        found = retrieve.vector_candidates(index["vectors"], index["chunks"].drop("path"), files, vector, limit).join(files.select("file_id", "is_generated"), "file_id")
        lists.append(found.select("path", "line_start", "line_end", F.lit("vector").alias("source"), "score", "kind", F.expr("nullif(symbol_names, '')").alias("symbol"), "content", "token_est", F.lit(0).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"), F.lit(0).cast("long").alias("ref_count"), "is_generated", F.lit(False).alias("exact_symbol")))
    if not lists:
        return None
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape.schema])


def ranked(found: DataFrame, query: str, p: Plan, mode: str = "hybrid") -> DataFrame:
    weights = p.weights if mode == "hybrid" else {mode: 1.0}
    terms = list(dict.fromkeys(t.lower() for t in re.findall(T.WORD, query)))
    return fuse.diversify(fuse.rerank(fuse.fuse(found, weights), terms, p.intent == "architecture"))


def fallback(query: str) -> list[str]:
    """Searches to try by hand: the longest word, and the first three in a row."""
    terms = re.findall(T.WORD, query)
    if not terms:
        return []
    patterns = [max(terms, key=len), *([".*".join(terms[:3])] if len(terms) > 1 else [])]
    return [f'rg -n "{x}"' for x in patterns]


def search(
    index: dict[str, DataFrame],
    query: str,
    limit: int = 10,
    offset: int = 0,
    budget: int = 0,
    mode: str = "hybrid",
    vector: list[float] | None = None,
    skeleton: bool = True,
    min_reduction: float = 0.25,
    compat_paging: bool = False,
    fallbacks: bool = True,
    state: dict | None = None,
    compactor: Callable[..., Column] = compact,
) -> dict:
    """The payload of a search. Retrieval to ranking is one lazy plan; only rows up to the page's end reach the driver.

    state is the index block (exists, stale, files_changed_since_build, built_at, head_commit). The budget, scaled for later
    pages, is spent from the first rank on, and the page is cut from that. Of each retriever's list as many
    rows as up to the page's end take part; LOOKAHEAD times as many tell whether there is a next page; compat_paging doesn't
    look for it and never reports more. compactor makes a snippet's skeleton, as snippets.compact does.
    """
    if mode not in ("hybrid", "fts", "symbol", "vector"):
        raise ValueError(f"unknown mode {mode}")
    p = plan(query)
    fetch = limit + offset
    found = candidates(index, query, p, fetch if compat_paging else LOOKAHEAD * (fetch + 1), mode, vector)
    nothing = {"exists": True, "stale": False, "files_changed_since_build": 0, "built_at": None, "head_commit": None}
    payload: dict = {"query": query, "intent": p.intent, "mode": mode, "index": nothing | (state or {}), "confidence": "low", "results": [], "recommended_reads": [], "fallback_suggestions": {}}
    more = False
    if found is not None:
        weights = p.weights if mode == "hybrid" else {mode: 1.0}
        placed = fuse.ranks(found)
        rows = placed.collect()  # a few rows for each of the page's, from each retriever
        if not compat_paging:
            more = len({(r["path"], (max(r["line_start"], 1) - 1) // fuse.BUCKET_LINES) for r in rows if weights.get(r["source"], 0) > 0}) > fetch
        part = index["files"].sparkSession.createDataFrame([r for r in rows if r["rank0"] < fetch], placed.schema)
        order = ranked(part.drop("rank0"), query, p, mode).where(F.col("pos") < fetch).withColumns({"skeletonized": F.lit(False), "elided_lines": F.lit(0)})
        if skeleton:
            c = compactor(F.col("content"), F.col("path"), F.col("line_start"), 0 if p.intent in SHAPES else 2, query, min_reduction)
            order = order.withColumn("c", c).withColumns({"skeletonized": F.col("c.skeletonized"), "elided_lines": F.col("c.elided_lines"), "content": F.when(F.col("c.skeletonized"), F.col("c.text")).otherwise(F.col("content")), "token_est": F.when(F.col("c.skeletonized"), F.col("c.token_est")).otherwise(F.col("token_est"))}).drop("c")
        best = order.withColumn("shown", T.redact(T.redact_key_blocks(F.col("content")))).orderBy("pos").collect()
        payload["confidence"] = fuse.confidence_of(*[r["score"] for r in best[:2]], n=len(best), agree=best[0]["agreeing_sources"] if best else None, exact=best[0]["exact_symbol"] if best else None)
        spend = budget if budget > 0 else p.budget
        fits, _ = fuse.fits([r["token_est"] if r["content"] else None for r in best], spend * fetch // max(limit, 1) if offset else spend)
        for r, ok in [*zip(best, fits)][offset:]:
            payload["results"].append({"rank": r["pos"] + 1, "symbols": [r["symbol"]] if r["symbol"] else [], "score": round(r["score"], 4), **{k: (r["shown"] if ok else None) if k == "snippet" else r[k] for k in SHOWN}})
            if not (ok and r["token_est"] >= fuse.USEFUL_TOKENS):
                payload["recommended_reads"].append({k: r[k] for k in ("path", "line_start", "line_end")})
    if payload["confidence"] == "low" and fallbacks:
        payload["fallback_suggestions"] = {"ripgrep": tries} if (tries := fallback(query)) else {}
    if offset or more:
        payload["pagination"] = {"offset": offset, "limit": limit, "has_more": more, "next_offset": fetch if more else None}
    return payload


def explain(index: dict[str, DataFrame], query: str, **how: object) -> dict:
    return search(index, explain_query(query), limit=10, budget=2200, **how)
