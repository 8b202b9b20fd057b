"""Graph exports (DOT, GraphML, Cypher, HTML) and Markdown or JSON for people and tools.

Lines are made by column expressions, so exports of any size are written as text by the cluster; only documents
for people, which are bounded, are put together on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.operators import communities
from rootweave.operators.order import numbered
from rootweave.storage import cut

EDGE_LIMIT = 500
_CAP = 20


def dense_ids(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(key, n): a number from 0 for every node of edges, in order of keys."""
    keys = edges.select(F.col(source).alias("key")).union(edges.select(F.col(target))).distinct()
    return numbered(keys, "key")


def _numbered(edges: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = ids.select(F.col("key").alias("source"), F.col("n").alias("s")), ids.select(F.col("key").alias("target"), F.col("n").alias("t"))
    return edges.join(a.hint("shuffle_hash"), "source").join(b.hint("shuffle_hash"), "target")


def _escape_dot(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _escape_xml(x: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _quote_cypher(x: Column) -> Column:
    bare = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), bare, F.lit("'"))


def dot_nodes(nodes: DataFrame) -> DataFrame:
    """Lines of nodes (n, name, path)."""
    label = F.when(F.coalesce("name", F.lit("")) != "", F.concat_ws("\n", "name", "path")).otherwise(F.col("path"))
    return nodes.select(F.concat(F.lit("  n"), F.col("n").cast("string"), F.lit(' [label="'), _escape_dot(label), F.lit('"];')).alias("line"))


def dot_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    style = F.when(F.col("confidence") == "inferred", "dashed").when(F.col("confidence") == "ambiguous", "dotted").otherwise("solid")
    return _numbered(edges, ids).select(F.concat(F.lit("  n"), F.col("s").cast("string"), F.lit(" -> n"), F.col("t").cast("string"), F.lit(' [label="'), _escape_dot(F.col("edge_type")), F.lit('", style='), style, F.lit("];")).alias("line"))


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    """Elements of nodes (n, kind, name, path, community, degree)."""
    data = [F.concat(F.lit(f'<data key="{k}">'), _escape_xml(F.col(k).cast("string")), F.lit("</data>")) for k in ("kind", "name", "path", "community", "degree")]
    return nodes.select(F.concat(F.lit('<node id="n'), F.col("n").cast("string"), F.lit('">'), *data, F.lit("</node>")).alias("line"))


def graphml_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    data = [F.concat(F.lit(f'<data key="{k}">'), _escape_xml(F.col(k)), F.lit("</data>")) for k in ("edge_type", "confidence")]
    return _numbered(edges, ids).select(F.concat(F.lit('<edge source="n'), F.col("s").cast("string"), F.lit('" target="n'), F.col("t").cast("string"), F.lit('">'), *data, F.lit("</edge>")).alias("line"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """Statements of nodes (key, name, path, community, degree)."""
    label = F.when(F.coalesce("name", F.lit("")) != "", "Symbol").otherwise("File")
    return nodes.select(F.concat(F.lit("MERGE (:"), label, F.lit(" {key:"), _quote_cypher(F.col("key")), F.lit(", name:"), _quote_cypher(F.col("name")), F.lit(", path:"), _quote_cypher(F.col("path")), F.lit(", community:"), F.col("community").cast("string"), F.lit(", degree:"), F.col("degree").cast("string"), F.lit("});")).alias("line"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    kind = F.upper(F.coalesce("edge_type", F.lit("edge")))
    return edges.select(F.concat(F.lit("MATCH (a {key:"), _quote_cypher(F.col("source")), F.lit("}), (b {key:"), _quote_cypher(F.col("target")), F.lit("}) MERGE (a)-[:"), kind, F.lit(" {confidence:"), _quote_cypher(F.coalesce("confidence", F.lit("extracted"))), F.lit("}]->(b);")).alias("line"))


def layout(nodes: DataFrame, width: int = 1200, height: int = 760, key: str = "id") -> DataFrame:
    """Nodes on a circle, in order of their keys: id, x, y."""
    radius = min(width, height) * 0.38
    at = numbered(nodes, key, name="__i").crossJoin(F.broadcast(nodes.agg(F.count("*").alias("__c"))))  # one row
    angle = 2 * F.pi() * F.col("__i") / F.col("__c")
    return at.select(F.col(key).alias("id"), F.round(width / 2 + radius * F.cos(angle), 2).alias("x"), F.round(height / 2 + radius * F.sin(angle), 2).alias("y"))


def shown_edges(edges: DataFrame, nodes: DataFrame, impacted_paths: DataFrame | None = None, limit: int = EDGE_LIMIT) -> DataFrame:
    """Resolved edges with their endpoints' keys, names and paths, those that touch the impacted paths, in a total order."""
    side = lambda p: nodes.select(F.col("kind").alias(f"{p}_kind"), F.col("id").alias(f"{p}_id"), F.col("path").alias(f"{p}_path"), F.col("name").alias(f"{p}_name"), F.col("key").alias({"src": "source", "dst": "target"}[p]))
    e = edges.where("resolved").select("edge_type", "src_kind", "src_id", "dst_kind", "dst_id", "line", "confidence")
    out = e.join(side("src"), ["src_kind", "src_id"]).join(side("dst"), ["dst_kind", "dst_id"])
    if impacted_paths is not None:
        hit = impacted_paths.select("path").distinct().withColumn("hit", F.lit(True))
        out = out.join(hit.withColumnRenamed("path", "src_path").withColumnRenamed("hit", "h1"), "src_path", "left").join(hit.withColumnRenamed("path", "dst_path").withColumnRenamed("hit", "h2"), "dst_path", "left").where("h1 OR h2").drop("h1", "h2")
    return out.orderBy("edge_type", "src_path", "line", "source", "target").limit(limit)


def shown_graph(shown: DataFrame) -> DataFrame:
    """Nodes (key, kind, name, path, community, degree) of shown_edges(): module and degree are those of the shown graph, -1 and 0 without neighbours."""
    ends = [shown.select(F.col(k).alias("key"), F.col(f"{p}_kind").alias("kind"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_path").alias("path")) for k, p in (("source", "src"), ("target", "dst"))]
    nodes = ends[0].unionByName(ends[1]).dropDuplicates(["key"])
    pairs = cut(communities.pair_weights(shown.select(F.col("source").alias("a"), F.col("target").alias("b"))))
    found = communities.communities(pairs).select(F.col("node").alias("key"), "community").join(communities.weighted_degree(pairs).withColumnRenamed("node", "key"), "key")
    return nodes.join(found, "key", "left").select("key", "kind", "name", "path", F.coalesce("community", F.lit(-1)).alias("community"), F.coalesce("degree", F.lit(0)).alias("degree"))


def write_lines(lines: list[DataFrame], path: str, head: list[str] | None = None, tail: list[str] | None = None) -> None:
    """Lines in their order as text files of one folder: head, each part, tail."""
    spark = lines[0].sparkSession
    text = lambda rows: spark.createDataFrame([(r,) for r in rows], "line string")
    parts = [text(head or []), *[x.orderBy("line") for x in lines], text(tail or [])]
    out = None
    for k, p in enumerate(parts):
        own = p.select(F.lit(k).alias("part"), F.monotonically_increasing_id().alias("i"), "line")
        out = own if out is None else out.unionByName(own)
    out.orderBy("part", "i").select("line").write.mode("overwrite").text(path)


def export_graph(edges: DataFrame, nodes: DataFrame, path: str, form: str) -> None:
    """A graph of shown_edges() and its nodes (key, kind, name, path, community, degree) as dot, graphml or cypher."""
    e = edges.select("source", "target", "edge_type", "confidence")
    ids = dense_ids(e)
    own = nodes.join(ids, "key")
    if form == "dot":
        write_lines([dot_nodes(own), dot_edges(e, ids)], path, ["digraph code {", "  graph [rankdir=LR];", "  node [fontsize=10, shape=box];"], ["}"])
    elif form == "graphml":
        keys = [f'<key attr.name="{k}" attr.type="{t}" for="node" id="{k}"/>' for t, ks in (("string", ("kind", "name", "path")), ("long", ("community", "degree"))) for k in ks]
        keys += [f'<key attr.type="string" attr.name="{k}" for="edge" id="{k}"/>' for k in ("edge_type", "confidence")]
        write_lines([graphml_nodes(own), graphml_edges(e, ids)], path, ["<?xml version='1.0'?>", "<!-- nodes, then edges -->", "<graphml xmlns='http://graphml.graphdrawing.org/xmlns'>", *keys, '<graph edgedefault="directed">'], ["</graph>", "</graphml>"])
    elif form == "cypher":
        write_lines([cypher_nodes(own), cypher_edges(e)], path, ["// graph export"])
    else:
        raise ValueError(f"unknown form {form}")


def html(edges: DataFrame, nodes: DataFrame, title: str = "graph") -> str:
    """A page that draws at most EDGE_LIMIT edges with their nodes (key, name, path, community, degree) on a circle."""
    e = edges.select("source", "target", F.col("edge_type").alias("type"), "line", "confidence").limit(EDGE_LIMIT)
    keys = e.select(F.col("source").alias("key")).union(e.select("target")).distinct()
    placed = layout(keys.withColumnRenamed("key", "id"))
    n = nodes.join(placed, nodes["key"] == placed["id"]).select("id", "name", "path", "community", "degree", "x", "y").orderBy("id")
    data = json.dumps({"nodes": [r.asDict() for r in n.collect()], "edges": [r.asDict() for r in e.collect()]}).replace("</", r"<\/")
    script = (
        "const g=JSON.parse(document.getElementById('g').textContent),s=document.querySelector('svg'),at={};for(const n of g.nodes)at[n.id]=n;"
        "const put=(t,a,x)=>{const e=document.createElementNS(s.namespaceURI,t);for(const k in a)e.setAttribute(k,a[k]);if(x)e.textContent=x;s.append(e)};"
        "for(const e of g.edges){const a=at[e.source],b=at[e.target];if(a&&b)put('line',{x1:a.x,y1:a.y,x2:b.x,y2:b.y,class:e.confidence})}"
        "for(const n of g.nodes){put('circle',{cx:n.x,cy:n.y,r:6+Math.sqrt(n.degree||0),fill:`hsl(${(n.community*47)%360} 60% 50%)`});put('text',{x:n.x+10,y:n.y},n.name||n.path)}"
    )
    style = "line{stroke:#999}line.inferred{stroke-dasharray:5 3}line.ambiguous{stroke:#c33;stroke-dasharray:2 3}text{font:11px sans-serif}"
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<!doctype html><meta charset="utf-8"><title>{safe}</title><style>{style}</style><svg viewBox="0 0 1200 760"></svg><script id="g" type="application/json">{data}</script><script>{script}</script>'


def to_json(payload: dict) -> str:
    """A payload for tools: indented, other alphabets kept."""
    return json.dumps(payload, default=str, ensure_ascii=False, indent=2)


def envelope(tool: str, payload: dict) -> dict:
    return {"schema_version": 1, "tool": tool, **payload}


def markdown_table(columns: list[str], rows: list[list[object]]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]


def markdown_search(payload: dict) -> str:
    facts = {"Query": payload["query"], "Intent": f"`{payload['intent']}`", "Confidence": payload["confidence"]}
    out = [" · ".join(f"**{k}:** {v}" for k, v in facts.items()), ""]
    lines = lambda r: "-".join(str(r[k]) for k in ("line_start", "line_end"))
    place = lambda r: f"`{r['path']}:{lines(r)}`"
    if payload["results"]:
        out += markdown_table(["#", "Path", "Lines", "Reason"], [[r["rank"], f"`{r['path']}`", lines(r), r["reason"]] for r in payload["results"]])
        for r in payload["results"]:
            if r["snippet"]:
                out += ["", place(r), "```", r["snippet"], "```"]
    else:
        out.append("_No index matches._")
    if payload["recommended_reads"]:
        out += ["", "**Recommended reads:**", *(f"- {place(r)}" for r in payload["recommended_reads"])]
    if tries := payload["fallback_suggestions"].get("ripgrep"):
        out += ["", "**Fallback (low confidence), try:**", *(f"- `{t}`" for t in tries)]
    if (page := payload.get("pagination")) and page["has_more"]:
        out += ["", f"_More from offset {page['next_offset']}._"]
    return "\n".join(out)


def markdown_rows(title: str, df: DataFrame, cap: int = _CAP) -> str:
    """A bounded table of a result: symbols, references, impact, path steps, callers or findings."""
    rows = df.limit(cap + 1).collect()
    body = markdown_table(df.columns, [list(r) for r in rows[:cap]]) if rows else ["_Nothing found._"]
    return "\n".join([f"**{title}**", "", *body, *([f"_More than {cap} rows._"] if len(rows) > cap else [])])


def markdown_architecture(s: dict) -> str:
    out = [f"**Nodes:** {s['node_count']} · **Edges:** {s['edge_count']} · **Modules:** {s['community_count']} · **Modularity:** {s['modularity']}", ""]
    out += markdown_table(["module", "size", "key nodes"], [[c["label"], c["size"], ", ".join(n["name"] for n in c["top_nodes"][:4])] for c in s["communities"]])
    out += ["", "**Hubs:**", *(f"- `{g['name']}` ({g['path']}), degree {g['degree']}" for g in s["god_nodes"])]
    out += ["", "**Bridges:**", *(f"- `{x['from']['name']}` – `{x['to']['name']}` ({x['edge_count']})" for x in s["surprising"])]
    return "\n".join([*out, "", "**Questions:**", *(f"- {q}" for q in s["questions"])])


_MARKS = {"inferred": "~", "ambiguous": "?"}


def _mark(confidence: str | None) -> str:
    return _MARKS.get(confidence or "", "")


def _where(n: dict) -> str:
    return f"{n['path']}:{n['line_start']}" if n.get("line_start") else n["path"]


def _label(n: dict) -> str:
    return f"`{n['name']}` ({_where(n)})" if n.get("name") else f"`{n['path']}`"


def _body(head: str, *parts: list[str]) -> str:
    return "\n\n".join([head, *("\n".join(p) for p in parts if p)]) + "\n"


def markdown_path(payload: dict) -> str:
    """A path of plans.service: its nodes, with the edge taken between two of them."""
    head = f"**Path:** `{payload['src']}` to `{payload['dst']}`"
    if not payload["found"]:
        return _body(head, [f"_{payload['reason']}_"])
    chain = [_label(payload["nodes"][0])]
    for step, node in zip(payload["steps"], payload["nodes"][1:]):
        arrow = "→" if step["direction"] == "out" else "←"
        chain += [f"  {arrow} {' '.join(filter(None, (step['edge_type'], _mark(step['confidence']))))}", _label(node)]
    return _body(f"{head} · {payload['hops']} step(s)", chain)


def markdown_describe(payload: dict) -> str:
    """A symbol's card: what it is, how connected, who calls it and what it uses; at most _CAP of each."""
    head = f"**Symbol:** `{payload['query']}`"
    if not payload["found"]:
        return _body(head, [f"_{payload['reason']}_"])
    p = payload["primary"]
    facts = [f"module `{p['module']}`", f"used {p['in_degree']} times, uses {p['out_degree']}", *([f"hub #{p['god_rank']}"] if p.get("god_rank") else [])]
    defs = ["**Defined:**", *(f"- {d['kind']} `{d.get('qualified') or d['name']}` in `{_where(d)}`" + (f": `{d['signature']}`" if d.get("signature") else "") for d in payload["definitions"])]
    listed = lambda title, rows, show: [f"**{title} ({len(rows)}):**", *(f"- {show(r)} {_mark(r['confidence'])}".rstrip() for r in rows[:_CAP])] if rows else []
    callers = listed("Called from", payload["callers"], lambda c: f"`{c['path']}:{c['line']}`")
    return _body(" · ".join([head, *facts]), defs, callers, listed("Uses", payload["callees"], lambda c: f"{_label(c)} {c['edge_type']}"))


def markdown_impact(payload: dict) -> str:
    """What a change of a target reaches, nearest first."""
    head = f"**Impact of** `{payload['target']}` · {payload['direction']}, {payload['depth']} step(s) · {len(payload['files'])} file(s)"
    rows = [[n["distance"], f"{n['via_edge'] or ''} {_mark(n['via_confidence'])}".strip(), n["kind"], f"`{n['name']}`", f"`{_where(n)}`"] for n in payload["nodes"]]
    note = [f"> {payload['coverage']['reason']}"] if payload["coverage"]["partial"] else []
    return _body(head, markdown_table(["distance", "by", "kind", "node", "place"], rows) if rows else ["_Nothing depends on it, or it isn't known._"], note)


def markdown_diff(payload: dict) -> str:
    """What the changes since a commit reach."""
    head = f"**Changes since** `{payload['base_ref']}` · {payload['direction']}, {payload['depth']} step(s)"
    if not payload["changed_files"]:
        return _body(head, ["_No tracked change._"])
    changed = [f"**Changed ({payload['changed_files_total']}):**", *(f"- `{p}`" for p in payload["changed_files"])]
    if payload["truncated"]:
        changed.append(f"- _only the first {len(payload['changed_files'])} were followed_")
    rows = [[a["distance"], f"`{a['path']}`", ", ".join(f"`{p}`" for p in a["changed_by"]), a["via_edge"], a["via_confidence"]] for a in payload["affected_files"]]
    affected = [f"**Affected ({len(rows)}):**", *markdown_table(["distance", "path", "by change of", "edge", "confidence"], rows)] if rows else ["_No affected file is known._"]
    unknown = ["**Not in the index:**", *(f"- `{p}`" for p in payload["unresolved_files"])] if payload["unresolved_files"] else []
    note = [f"> {payload['coverage']['reason']}"] if payload["coverage"]["partial"] else []
    return _body(head, changed, affected, unknown, note)
