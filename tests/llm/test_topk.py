import numpy as np
import pytest

from rootweave.llm import topk


def brute(rows, k, every=1):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows], np.float64)
    score = v @ v.T
    out = []
    for q in (q for q in range(len(rows)) if ids[q] % every == 0):
        order = sorted((j for j in range(len(rows)) if j != q), key=lambda j: (-score[q, j], ids[j]))[:k]
        out += [(ids[q], r + 1, round(score[q, j], 5)) for r, j in enumerate(order)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<float>, norm string")


@pytest.mark.parametrize(("kind", "every"), [("unit", 1), ("skewed", 1), ("clustered", 1), ("unit", 7), ("skewed", 100)])
def test_equals_brute_force(spark, kind, every):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((260, 12))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1)[:, None]
    if kind == "skewed":
        v *= rng.pareto(1.0, 260)[:, None]
    if kind == "clustered":
        v = np.repeat(v[:13], 20, axis=0) + 0.01 * rng.standard_normal((260, 12))
    rows = [(k, x) for k, x in enumerate(v.astype(np.float32).tolist())]
    got = sorted((r.vec_id, r.rank, round(r.score, 5)) for r in topk.top_k(frame(spark, rows), k=5, every=every, bucket=40, query_block=30).collect())
    want = brute(rows, 5, every)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)


def test_both_prunings_discard(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((10, 16))
    v = (np.repeat(centre, 50, axis=0) + 0.01 * rng.standard_normal((500, 16))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[250:] *= 0.01
    v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
    block = lambda s: topk.Block(np.arange(s.start, s.stop).tobytes(), np.arange(s.start, s.stop).tobytes(), v[s].tobytes(), 16)
    q, far = block(slice(0, 250)), block(slice(250, 500))
    best = topk.Best(250, 5)
    topk.search(q, q, best)
    verified, every = topk.search(q, far, best)
    assert verified == 0 < every  # too short
    near = topk.Best(250, 5)
    near.score[:] = 0.999 * (q.norm**2)[:, None]
    verified, every = topk.search(q, q, near)
    assert verified < every / 3  # coordinates out of range


def test_odd_vectors(spark):
    rows = [(1, [1, 0]), (2, [0, 1]), (2, [0, 1]), (3, [0, 0]), (4, None), (None, [1, 1]), (5, []), (6, [1]), (7, [float("nan"), 1]), (8, [None, 1]), (9, [1, 0]), (10, [float("inf"), 0])]
    out = topk.top_k(frame(spark, rows), k=3)
    by = {}
    for r in out.collect():
        by.setdefault(r.vec_id, []).append((r.rank, r.neighbor_id, r.score))
    assert set(by) == {1, 2, 3, 9} and sorted(by[1]) == [(1, 9, 1.0), (2, 2, 0.0), (3, 2, 0.0)]
    assert sorted(by[2])[0] == sorted(by[2])[1] == (1, 2, 1.0)  # a repeated row answers its copy, each once
    assert sorted(by[3]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 2, 0.0)]  # ties go to the smaller id


def test_few_and_none(spark):
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert sorted(tuple(r)[:3] for r in topk.top_k(frame(spark, [(1, [1.0]), (2, [2.0])]), k=9).collect()) == [(1, 1, 2), (2, 1, 1)]


def test_ids_are_integral_and_names_may_clash(spark):
    df = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(30)], "vec_id int, embedding array<float>")
    want = sorted(map(tuple, topk.top_k(df, k=3, every=10).collect()))
    clash = df.selectExpr("*", *[f"0 AS {c}" for c in ("id", "v", "norm", "tag", "block", "longest", "score", "rank", "q_row", "d")])
    assert sorted(map(tuple, topk.top_k(clash, k=3, every=10).collect())) == want and len(want) == 9
    with pytest.raises(TypeError, match="integral"):
        topk.top_k(df.selectExpr("string(vec_id) AS vec_id", "embedding"))


def test_one_vector_repeated_very_often(spark):
    df = spark.range(3_000).selectExpr("if(id % 3 = 0, 5, id) AS vec_id", "if(id % 3 = 0, array(1f, 0f), array(float(id), 1f)) AS embedding")
    out = topk.top_k(df, k=2, every=5, bucket=64).collect()
    assert len(out) == 2 * df.where("vec_id % 5 = 0").count() and all(r.neighbor_id >= 2_996 for r in out)
