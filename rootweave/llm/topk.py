"""Exact top-k inner-product search by norm buckets; the queries are the vectors whose id a number divides (1: all).

Vectors are range-partitioned by length (Euclidean norm, longest first) and packed into buckets, one
row with a matrix each, and the queries likewise into blocks. The bucket of the longest vectors, whose size doesn't
grow, is searched first by every block, which gives each query a lower bound of its k-th product. Then query blocks
meet the other buckets whose longest vector can still reach a bound, packed row against packed row; the number of
tasks is bounded, and a task goes through a run of buckets. Within a pair each query
has a local cosine threshold, its bound divided by its own length and the bucket's longest: above 1
the bucket is skipped; when it is high, coordinate pruning keeps the vectors whose largest query
coordinates lie in the feasible range; otherwise length pruning keeps the prefix of vectors long
enough. Kept vectors are verified by products, bounds rise as buckets pass by, and a task hands on
only its best k of each query. All blocks and buckets that pruning can't rule out are compared: the
result is exact, and in the worst case its cost is the product of queries and vectors.

Cases. Ids must be of an integral type; others raise an error. Vectors that are null, empty, of another dimension than
`dim`, or with a null or non-finite element are left out, as queries and as answers; so are rows without an id. A zero
vector has products of 0. Rows that share an id are one vector each; a query never answers itself (its own row), but a
repeated row answers its copy. Ties go to the smaller id. With fewer than k others a query has fewer
answers. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.common import integral_id, shards, stored

BUCKET = 4096
#: Queries of a block.
QUERY_BLOCK = 1024
#: Buckets that a task goes through at most, and tasks while there are fewer runs of buckets than that.
RUN, MOST_TASKS = 64, 20_000
#: Local cosine thresholds from which the coordinates prune; below it their feasible ranges hold nearly everything.
COORDINATE_FROM = 0.9
FOCUS = 3
#: How much rounding can move a product of unit vectors.
SLACK = 1e-9


class Block:
    """A packed bucket: ids, row numbers, lengths (falling) and unit vectors, in double precision."""

    def __init__(self, ids: bytes, rows: bytes, vectors: bytes, dim: int) -> None:
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.vectors = np.frombuffer(vectors, np.float32).reshape(-1, dim).astype(np.float64)
        self.norm = np.sqrt((self.vectors**2).sum(axis=1))
        self.unit = self.vectors / np.where(self.norm > 0, self.norm, 1)[:, None]


class Best:
    """The best k answers of each query so far: products, ids and row numbers, best first."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score = k, np.full((n, k), -np.inf)
        self.id, self.row = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    @property
    def bound(self) -> np.ndarray:
        return self.score[:, -1]

    def take(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Products (queries q, candidates); -inf marks none."""
        if score.shape[1] > self.k:  # all that tie with the k-th stay for the tie rule
            kth = np.partition(score, -self.k, axis=1)[:, -self.k]
        else:
            kth = np.full(len(q), -np.inf)
        hit_q, hit_c = np.nonzero((score >= np.maximum(kth, self.score[q, -1])[:, None]) & (score > -np.inf))
        if not len(hit_q):
            return
        who = np.unique(hit_q)
        all_q = np.concatenate([hit_q, np.repeat(who, self.k)])
        all_s = np.concatenate([score[hit_q, hit_c], self.score[q[who]].ravel()])
        all_i = np.concatenate([ids[hit_c], self.id[q[who]].ravel()])
        all_r = np.concatenate([rows[hit_c], self.row[q[who]].ravel()])
        order = np.lexsort((all_r, all_i, -all_s, all_q))
        all_q, all_s, all_i, all_r = all_q[order], all_s[order], all_i[order], all_r[order]
        first = np.flatnonzero(np.append(True, all_q[1:] != all_q[:-1]))
        at = first[:, None] + np.arange(self.k)
        self.score[q[who]], self.id[q[who]], self.row[q[who]] = all_s[at], all_i[at], all_r[at]


def search(queries: Block, bucket: Block, best: Best) -> tuple[int, int]:
    """Brings the bucket's vectors into best; returns how many pairs were verified and how many there are."""
    n, m = len(queries.ids), len(bucket.ids)
    longest = float(bucket.norm[0])
    reach = queries.norm * longest
    local = np.where(reach > 0, best.bound / np.where(reach > 0, reach, 1), np.where(best.bound > 0, np.inf, -np.inf))
    open_ = np.flatnonzero(local <= 1 + SLACK)
    if not len(open_):
        return 0, n * m
    verified = 0
    sharp = open_[local[open_] >= COORDINATE_FROM]
    for q in sharp.tolist():  # coordinate pruning: the feasible range of the query's largest coordinates
        u, t = queries.unit[q], min(1.0, local[q] - SLACK)
        keep = np.ones(m, bool)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
            low = -1.0 if u[f] <= -t else u[f] * t - spread
            high = 1.0 if u[f] >= t else u[f] * t + spread
            keep &= (bucket.unit[:, f] >= low - SLACK) & (bucket.unit[:, f] <= high + SLACK)
        keep &= bucket.norm * queries.norm[q] >= best.bound[q] - SLACK * (1 + abs(best.bound[q]))
        where = np.flatnonzero(keep)
        verified += len(where)
        if len(where):
            score = (bucket.vectors[where] @ queries.vectors[q])[None, :]
            score[0, bucket.rows[where] == queries.rows[q]] = -np.inf
            best.take(np.array([q]), score, bucket.ids[where], bucket.rows[where])
    rest = open_[local[open_] < COORDINATE_FROM]
    if len(rest):  # length pruning: the prefix that the most demanding of a slice of queries still needs
        need = np.where(queries.norm[rest] > 0, best.bound[rest] / np.where(queries.norm[rest] > 0, queries.norm[rest], 1), -np.inf)
        order = np.argsort(need)
        for lo in range(0, len(order), 512):
            q = rest[order[lo : lo + 512]]
            upto = int(np.searchsorted(-bucket.norm, -(need[order[lo]] - SLACK * (1 + abs(need[order[lo]]))), "right")) if np.isfinite(need[order[lo]]) else m
            verified += len(q) * upto
            if upto:
                score = queries.vectors[q] @ bucket.vectors[:upto].T
                score[queries.rows[q][:, None] == bucket.rows[None, :upto]] = -np.inf
                best.take(q, score, bucket.ids[:upto], bucket.rows[:upto])
    return verified, n * m


def usable(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, norm, tag) of the vectors that take part; tag numbers their rows."""
    v = F.col("v")
    body = vectors.select(integral_id(vectors, id_col).alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"))
    body = body.where(F.col("id").isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return stored(body.withColumns({"norm": norm, "tag": F.monotonically_increasing_id()}))


def buckets(body: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(block, longest, ids, rows, vectors): usable vectors packed in buckets of falling length."""
    parts = shards(body.count(), bucket)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            flat = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float32)
            block = part << 24 | made
            made += 1
            packed = [pa.array([t.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("id", "tag")]
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([t.column("norm")[0].as_py()]), *packed, pa.array([flat.tobytes()], pa.binary())], names=["block", "longest", "ids", "rows", "vectors"])

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= 2 * bucket:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, bucket).combine_chunks())
                held = t.slice(bucket).to_batches()
                rows -= bucket
        if rows:
            yield out(pa.Table.from_batches(held).combine_chunks())

    order = F.desc("norm"), F.asc("id"), F.asc("tag")
    return stored(body.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "block long, longest double, ids binary, rows binary, vectors binary"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 1, dim: int | None = None, bucket: int = BUCKET, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbor_id, score): of each vector whose id `every` divides, its k best others by inner product; rank counts from 1."""
    if dim is None:  # the dimension that most vectors have, the larger of equally frequent ones
        sizes = vectors.select(F.size(F.col(f"`{vector_col}`")).alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = sizes["d"] if sizes else 1
    body = usable(vectors, dim, id_col, vector_col)
    packed, asked = buckets(body, bucket), buckets(body.where(F.col("id") % every == 0), query_block)
    n, m = packed.count(), asked.count()
    top = packed.orderBy(F.desc("longest"), "block").first()  # one bucket
    head = tuple(top[c] for c in ("block", "ids", "rows", "vectors")) if top else None

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                own = Block(r.ids, r.rows, r.vectors, dim)
                best = Best(len(own.ids), k)
                search(own, Block(*head[1:], dim), best)
                need = np.where(own.norm > 0, best.bound / np.where(own.norm > 0, own.norm, 1), np.where(best.bound > 0, np.inf, -np.inf))
                yield pd.DataFrame({"q_block": [r.block], "q_ids": [r.ids], "q_rows": [r.rows], "q_vectors": [r.vectors], "needs": [float(need.min())], "score": [best.score.tobytes()], "id": [best.id.tobytes()], "row": [best.row.tobytes()]})

    seeds = stored(asked.mapInPandas(first, "q_block long, q_ids binary, q_rows binary, q_vectors binary, needs double, score binary, id binary, row binary"))

    def opened(r) -> tuple[Block, Best]:  # noqa: ANN001
        queries = Block(r.q_ids, r.q_rows, r.q_vectors, dim)
        best = Best(len(queries.ids), k)
        for name, kind in (("score", np.float64), ("id", np.int64), ("row", np.int64)):
            setattr(best, name, np.frombuffer(getattr(r, name), kind).reshape(-1, k).copy())
        return queries, best

    def rows_of(queries: Block, best: Best, known: np.ndarray | None = None) -> pd.DataFrame:
        """The answers, those of the first bucket (known) aside."""
        there = best.row >= 0
        if known is not None:
            there &= ~(best.row[:, :, None] == known[:, None, :]).any(axis=2)
        q, at = np.nonzero(there)
        return pd.DataFrame({"vec_id": queries.ids[q], "q_row": queries.rows[q], "neighbor_id": best.id[q, at], "n_row": best.row[q, at], "score": best.score[q, at]})

    def seeded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                yield rows_of(*opened(r))

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, queries, best, known = None, None, None, None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.q_block != block:
                    if block is not None:
                        yield rows_of(queries, best, known)
                    block, (queries, best) = r.q_block, opened(r)
                    known = best.row.copy()
                search(queries, Block(r.ids, r.rows, r.vectors, dim), best)
        if block is not None:
            yield rows_of(queries, best, known)

    runs = max(shards(n, RUN), min(shards(n, 8), RUN))
    left = seeds.repartition(max(1, min(m, MOST_TASKS // runs)), "q_block")
    right = packed.where(F.col("block") != (head[0] if head else -1)).repartitionByRange(runs, F.desc("longest"), "block").sortWithinPartitions(F.desc("longest"), "block")
    near = left.join(right, F.col("longest") >= F.col("needs") - SLACK * (1 + F.abs("needs")))  # a stated query set against all rows, in blocks
    shape = "vec_id long, q_row long, neighbor_id long, n_row long, score double"
    hits = near.mapInPandas(second, shape).unionByName(seeds.mapInPandas(seeded, shape))
    rank = Window.partitionBy("q_row").orderBy(F.desc("score"), "neighbor_id", "n_row")
    return hits.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "score")
