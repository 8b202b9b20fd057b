"""Structure of a weighted undirected graph: adjacency, communities, hubs, bridges, modularity and labels.

Nodes are strings that survive indexing again (stable keys).
"""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.functions import paths as P
from rootweave.operators.order import numbered
from rootweave.storage import cut, stored

PASSES = 20
#: A component's steps are held in memory up to the first number, and read from their file by the second.
HELD_STEPS, BLOCK_STEPS = 1 << 21, 1 << 17
TASK_PAIRS = 1_000_000
MAX_GODS, TOP_NODES, MAX_BRIDGES, BRIDGE_EDGES, MAX_COMMUNITIES, MIN_COMMUNITY, MAX_QUESTIONS = 20, 5, 12, 2, 40, 2, 8


def pair_weights(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: how often two nodes are joined, in either direction; loops are dropped."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("w"))


def adjacency(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def weighted_degree(pairs: DataFrame) -> DataFrame:
    return adjacency(pairs).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))


def moves(n: int, rows: Callable[[], Iterable[tuple[Iterable[int], Iterable[int]]]], two_m: int, passes: int = PASSES) -> array:
    """One level of deterministic Louvain moves over nodes 0 to n - 1: the first member of each node's community.

    rows() gives, once a pass, the neighbours and weights of each node in order. A node leaves its community and joins
    the neighbouring one of the greatest gain (links into it minus its share of the total degree), its own counting first,
    then the one founded by the smallest node. Only three numbers a node are kept.
    """
    degree = array("q", (sum(ws) for _, ws in rows()))
    home, total = array("q", range(n)), degree[:]
    for _ in range(passes):
        moved = 0
        for v, (us, ws) in enumerate(rows()):
            old, own = home[v], degree[v]
            share = own / two_m
            total[old] -= own
            into: dict[int, int] = {}
            for c, w in zip(map(home.__getitem__, us), ws):
                into[c] = into.get(c, 0) + w
            best, most = old, into.get(old, 0) - total[old] * share
            for c in sorted([c for c, x in into.items() if x > most]):  # no gain is above its links
                if (gain := into[c] - total[c] * share) > most + 1e-12:
                    best, most = c, gain
            home[v] = best
            total[best] += own
            moved += best != old
        if not moved:
            break
    return home


def local_moves(edges: list[tuple[str, str, int]], two_m: int, passes: int = PASSES) -> dict[str, str]:
    """moves() over the edges of a component in memory, nodes in order of their keys: node -> the community's first member."""
    links: dict[str, dict[str, int]] = {}
    for a, b, w in edges:
        links.setdefault(a, {})[b] = w
        links.setdefault(b, {})[a] = w
    order = sorted(links)
    number = {n: i for i, n in enumerate(order)}
    near = [([number[b] for b in links[n]], list(links[n].values())) for n in order]
    home = moves(len(order), lambda: near, two_m, passes)
    return {n: order[home[v]] for v, n in enumerate(order)}


class Steps:
    """The steps (v, u, w) of one component in order of v. Beyond HELD_STEPS they are in a file, and a block of them in memory."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.file = 0, None

    def add(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> None:
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        self.seen.append((v[first], np.diff(np.r_[first, len(v)])))
        self.parts.append(np.stack([u, w], axis=1))
        self.size += len(v)
        if self.size > HELD_STEPS:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for part in self.parts:
                self.file.write(part.tobytes())
            self.parts = []

    def moved(self, two_m: int) -> tuple[np.ndarray, np.ndarray]:
        """(node, first member of its community) of every node."""
        every, counts = (np.concatenate([x[k] for x in self.seen]) for k in (0, 1))
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])  # a node's steps may come in two batches
        nodes, ends = every[first], np.cumsum(np.add.reduceat(counts, first))
        self.seen = []
        if self.file is None:
            steps = np.concatenate(self.parts)
        else:
            self.file.flush()
            steps = np.memmap(self.file, np.int64, "r+").reshape(-1, 2)
        for at in range(0, self.size, HELD_STEPS):
            steps[at : at + HELD_STEPS, 0] = np.searchsorted(nodes, steps[at : at + HELD_STEPS, 0])

        def column(k: int, begin: int, end: int) -> Iterator[int]:
            for at in range(begin, end, BLOCK_STEPS):
                yield from steps[at : min(at + BLOCK_STEPS, end), k].tolist()

        def rows() -> Iterator[tuple[Iterable[int], Iterable[int]]]:
            v, begin = 0, 0
            while v < len(ends):
                last = int(np.searchsorted(ends, begin + BLOCK_STEPS, "right"))
                if last == v:  # a hub, whose steps are many blocks
                    yield column(0, begin, int(ends[v])), column(1, begin, int(ends[v]))
                    v, begin = v + 1, int(ends[v])
                    continue
                us, ws = (steps[begin : ends[last - 1], k].tolist() for k in (0, 1))
                x = 0
                for end in (ends[v:last] - begin).tolist():
                    yield us[x:end], ws[x:end]
                    x = end
                v, begin = last, int(ends[last - 1])

        return nodes, nodes[np.frombuffer(moves(len(nodes), rows, two_m), np.int64)]


def moved_components(batches: Iterable[pa.RecordBatch], two_m: int) -> Iterator[pa.RecordBatch]:
    """(v, label) from batches (component, v, u, w) in order of component and v: one component at a time."""
    steps, at, done, held = None, None, [], 0

    def out(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in done])) for k in (0, 1)], names=["v", "label"])

    for batch in batches:
        c, v, u, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(c):
            continue
        cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
        for x, y in zip(cuts, cuts[1:]):
            if steps is None or c[x] != at:
                if steps is not None:
                    done.append(steps.moved(two_m))
                    held += len(done[-1][0])
                    if held >= 10_000:
                        yield out(done)
                        done, held = [], 0
                steps, at = Steps(), c[x]
            steps.add(v[x:y], u[x:y], w[x:y])
    if steps is not None:
        yield out([*done, steps.moved(two_m)])


def connected(pairs: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, by min-label steps with pointer jumps.

    The steps lie partitioned by their far end, so that of each round only labels move.
    """
    both = cut(adjacency(pairs).select("a", "b").repartition("b"))
    label = cut(both.groupBy(F.col("b").alias("node")).agg(F.least(F.col("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b").hint("shuffle_hash"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        step = cut(label.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("was")))
        hop = step.select("node", F.col("component").alias("mid"), "was").join(step.select(F.col("node").alias("mid"), F.col("component").alias("root")), "mid")
        new = cut(hop.select("node", F.least("mid", "root").alias("component"), "was"))
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        label = new.drop("was")


def communities(pairs: DataFrame, exact_nodes: int | None = None) -> DataFrame:
    """(node, community, exact): dense community ids, the largest first, then by least member.

    Louvain moves depend on the rest of the graph only through its total weight, so each connected
    component is a group of its own, whatever its size. One task goes through a component's steps, which lie sorted by node
    in a file of its own, and keeps a few numbers a node. Only if a caller gives exact_nodes do components above so many
    nodes take label propagation, flagged by exact = false.
    """
    pairs = stored(pairs)
    two_m = 2 * (pairs.agg(F.sum("w")).first()[0] or 0)
    nodes = stored(numbered(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", name="v"))
    a, b = (nodes.select(F.col("node").alias(k), F.col("v").alias(f"v{k}")).hint("shuffle_hash") for k in "ab")
    links = stored(pairs.join(a, "a").join(b, "b").select(F.col("va").alias("a"), F.col("vb").alias("b"), F.col("w").cast("long").alias("w")))
    part = connected(links)
    size = part.groupBy("component").agg(F.count("*").alias("n"))
    home = part if exact_nodes is None else part.join(size, "component")
    each = adjacency(links).join(home.withColumnRenamed("node", "a").hint("shuffle_hash"), "a")
    fits = F.lit(True) if exact_nodes is None else F.col("n") <= exact_nodes
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), links.count() // TASK_PAIRS)
    steps = each.where(fits).select("component", F.col("a").alias("v"), F.col("b").alias("u"), "w").repartition(tasks, "component").sortWithinPartitions("component", "v")
    found = steps.mapInArrow(lambda batches: moved_components(batches, two_m), "v long, label long").select(F.col("v").alias("node"), "label", F.lit(True).alias("exact"))
    large = each.where(~fits & (F.col("a") < F.col("b"))).select("a", "b", "w")
    if exact_nodes is not None and not large.isEmpty():
        found = found.unionByName(propagate(large).withColumn("exact", F.lit(False)))
    numbers = renumber(cut(found)).withColumnRenamed("node", "v")
    return numbers.join(nodes, "v").select("node", "community", "exact")


def propagate(pairs: DataFrame, rounds: int = PASSES) -> DataFrame:
    """Synchronous label propagation: each node takes the label of most weight around it, the least among equals."""
    both = cut(adjacency(pairs))
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))
        new = cut(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label")))
        same = new.join(label.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty()
        label = new
        if same:
            break
    return label


def renumber(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    dense = numbered(sizes, F.desc("n"), "least", name="community").select("label", "community")
    return labels.join(dense, "label").select("node", "community", *[c for c in labels.columns if c not in ("node", "label")])


def adjacent_modularity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row (modularity): the share of weight within communities less what degrees explain, over adjacent pairs only."""
    degree = weighted_degree(pairs).join(members.select("node", "community"), "node")
    a = degree.select(F.col("node").alias("a"), F.col("degree").alias("da"), F.col("community").alias("ca"))
    b = degree.select(F.col("node").alias("b"), F.col("degree").alias("db"), F.col("community").alias("cb"))
    total = pairs.agg((2 * F.sum("w")).cast("double").alias("m2"))
    each = pairs.join(a, "a").join(b, "b").crossJoin(F.broadcast(total))  # one row
    part = F.when(F.col("ca") == F.col("cb"), 2 * (F.col("w") - F.col("da") * F.col("db") / F.col("m2"))).otherwise(0.0)
    return each.agg(F.round(F.coalesce(F.sum(part) / F.max("m2"), F.lit(0.0)), 4).alias("modularity"))


def god_nodes(pairs: DataFrame, limit: int = MAX_GODS) -> DataFrame:
    """The nodes of the highest weighted degree."""
    return weighted_degree(pairs).orderBy(F.desc("degree"), "node").limit(limit)


def bridges(pairs: DataFrame, members: DataFrame, limit: int = MAX_BRIDGES, most: int = BRIDGE_EDGES) -> DataFrame:
    """Community pairs that few edges join, the fewest first, each with its least edge.

    Nodes are numbered in their order, and an edge is one number made of both (31 bits each): so edges are only counted and compared in hash tables, never sorted.
    """
    nodes = members.select("node").distinct()
    number = stored(numbered(nodes, "node").select("node", "n"))
    c = members.select("node", "community").join(number, "node")
    a, b = (c.select(F.col("node").alias(k), F.col("community").alias(f"c{k}"), F.col("n").alias(f"n{k}")).hint("shuffle_hash") for k in "ab")
    ends = pairs.select("a", "b").join(a, "a").join(b, "b").where("ca <> cb")
    least = F.min(F.col("na") * F.lit(1 << 31) + F.col("nb"))
    grouped = ends.groupBy(F.least("ca", "cb").alias("from_community"), F.greatest("ca", "cb").alias("to_community")).agg(F.count("*").alias("edge_count"), least.alias("e"))
    few = grouped.where(F.col("edge_count") <= most).orderBy("edge_count", "from_community", "to_community").limit(limit)
    shown = few.select("*", F.shiftright("e", 31).alias("na"), F.col("e").bitwiseAND(F.lit((1 << 31) - 1)).alias("nb"))
    names = [number.select(F.col("node").alias(k), F.col("n").alias(f"n{k}")) for k in "ab"]
    return shown.join(names[0], "na").join(names[1], "nb").orderBy("edge_count", "from_community", "to_community").select("from_community", "to_community", "edge_count", "a", "b")


def labels(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, label): the directory of most members, tests aside unless there is nothing else; ties go to the shorter, then the lesser."""
    placed = members.join(nodes.select(F.col("key").alias("node"), "path"), "node").where("path IS NOT NULL")
    counted = placed.groupBy("community", P.directory(F.col("path")).alias("dir")).agg(F.sum((~P.is_test_for_labels(F.col("path"))).cast("long")).alias("prod"), F.count("*").alias("every"))
    some = Window.partitionBy("community")
    votes = F.when(F.max("prod").over(some) > 0, F.col("prod")).otherwise(F.col("every"))
    order = some.orderBy(F.desc("votes"), F.length("dir"), "dir")
    return counted.withColumn("votes", votes).withColumn("n", F.row_number().over(order)).where("n = 1").select("community", F.col("dir").alias("label"))


def top_nodes(members: DataFrame, degree: DataFrame, limit: int = TOP_NODES) -> DataFrame:
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    return members.join(degree, "node").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("community", "n", "node", "degree")


def summary(edges: DataFrame, nodes: DataFrame) -> dict:
    """The architecture summary of a graph: edges (a, b) of keys, nodes with key, kind, name and path. Its lists have fixed bounds."""
    pairs = cut(pair_weights(edges))
    members = cut(communities(pairs))
    degree = weighted_degree(pairs)
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    info = nodes.select(F.col("key").alias("node"), "kind", "name", "path")
    named = labels(members, nodes)
    shown = sizes.where(F.col("size") >= MIN_COMMUNITY).orderBy(F.desc("size"), "community").limit(MAX_COMMUNITIES)
    top = top_nodes(members.join(shown, "community", "left_semi"), degree).join(info, "node")
    listed = top.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("n", "kind", "name", "path", "degree"))).alias("top"))
    rows = shown.join(named, "community", "left").join(listed, "community", "left").orderBy(F.desc("size"), "community").collect()
    gods = [r.asDict() for r in god_nodes(pairs).join(info, "node", "left").join(members, "node").orderBy(F.desc("degree"), "node").select("kind", "name", "path", "degree", "community").collect()]
    ends = info.select(F.col("node").alias("a"), F.struct("kind", "name", "path").alias("from"))
    tos = info.select(F.col("node").alias("b"), F.struct("kind", "name", "path").alias("to"))
    bridged = bridges(pairs, members).join(ends, "a").join(tos, "b").orderBy("edge_count", "from_community", "to_community").collect()
    crossing = [{"from": r["from"].asDict(), "to": r["to"].asDict(), "from_community": r["from_community"], "to_community": r["to_community"], "edge_count": r["edge_count"]} for r in bridged]
    asked = {c for x in crossing for c in (x["from_community"], x["to_community"])}
    names = {r["community"]: r["label"] for r in named.where(F.col("community").isin(*asked)).collect()} if asked else {}
    return {
        "node_count": degree.count(),
        "edge_count": pairs.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0],
        "community_count": sizes.where(F.col("size") >= MIN_COMMUNITY).count(),
        "modularity": adjacent_modularity(pairs, members).first()[0],
        "communities": [{"id": r["community"], "label": r["label"], "size": r["size"], "top_nodes": [{k: t[k] for k in ("kind", "name", "path", "degree")} for t in r["top"]]} for r in rows],
        "god_nodes": gods,
        "surprising": crossing,
        "questions": questions(gods, crossing, names),
    }


def questions(gods: list[dict], crossing: list[dict], names: dict[int, str], limit: int = MAX_QUESTIONS) -> list[str]:
    """Questions to begin with, from the three strongest hubs and bridges."""
    asked = []
    for kind, name in ((g["kind"], g["name"]) for g in gods[:3]):
        of_file = [f"What is the role of `{name}` in the architecture?"]
        asked += [f"How does `{name}` work?", f"What breaks if `{name}` changes?"] if kind == "symbol" else of_file
    for x in crossing[:3]:
        a, b = (names.get(x[k]) or f"community {x[k]}" for k in ("from_community", "to_community"))
        if a != b:
            asked.append(f"How is `{a}` connected to `{b}`?")
    return list(dict.fromkeys(asked))[:limit]
