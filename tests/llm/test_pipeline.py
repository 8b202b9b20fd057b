import random

import pytest
from llm_samples import prose

import corpus_pipeline
from rootweave.llm import packing, quality_mil, queries, secret_scan, token_count
from rootweave.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, SF))
        out.append(docs)
    return out


def test_the_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]
    docs = stages[0]
    assert all(s.columns == docs.columns for s in stages[1:5])
    counts = [s.count() for s in stages]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:]))


def test_rejected_documents_go(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    had = {r.doc_id for r in stages[0].collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items() if i in had]
    assert sum(right) / len(right) >= 0.95


def test_one_of_each_text_stays(stages):
    before, after = ([(r.text, r.doc_id) for r in s.collect()] for s in stages[1:3])
    least = {}
    for t, i in before:
        least[t] = min(i, least.get(t, i))
    assert sorted(after) == sorted(least.items())


def test_no_secret_is_left(stages):
    assert not list(secret_scan.findings([r.text for r in stages[4].collect()]))


def test_every_document_is_packed(stages):
    packed = {r.doc_id for r in stages[5].collect()}
    assert packed == {r.doc_id for r in stages[4].collect() if r.text}
    fill = stages[5].selectExpr("bin", "token_end - token_begin AS n").groupBy("bin").sum("n").collect()
    assert max(r[1] for r in fill) <= packing.CAPACITY


def test_odd_rows_pass_through_all_stages(spark, odd, docs_of, tmp_path):
    """Null ids and texts, empty, blank and very long texts, repeated rows and ids, ties, and columns of clashing names."""
    rng = random.Random(3)
    good = [(1000 + k, prose(rng.randrange(20, 200), k)) for k in range(90)]
    bad = [(2000 + k, " ".join(f"{w.upper()}!!" for w in prose(60, 300 + k).split())) for k in range(30)]
    secret = "aB3xK9fQ2LpZ8wRt7YhVbN5c"
    more = [(3000, f"{prose(60, 7)} password={secret} end"), (3001, prose(40, 8)), (3001, prose(40, 9)), (3002, prose(40, 8)), (3003, bad[0][1]), (None, good[0][1])]
    docs = odd.unionByName(docs_of(good + bad + more))
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (1000, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for _, f in corpus_pipeline.STAGES:
        steps.append(stored(f(spark, steps[-1], folder)))
    rows = [[(r.doc_id, r.text) for r in s.collect()] for s in steps[:5]]
    assert all(s.columns == docs.columns for s in steps[:5])
    score = {(r.doc_id, r.score is None): r.is_kept for r in quality_mil.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {t for _, t in rows[0]} - {t for _, t in rows[1]} >= {t for _, t in bad} and all((i, t) in rows[1] for i, t in good) and all(score[k] for k in score if k[1])
    best = {}
    for i, t in rows[1]:
        if t is not None:
            best[t] = min(((i is None, i), best[t]) if t in best else ((i is None, i),), key=lambda x: (x[0], x[1] or 0))
    assert sorted((i, t) for i, t in rows[2] if i is not None and t is not None) == sorted((i, t) for t, (none, i) in best.items() if not none)
    assert sum(t is None for _, t in rows[2]) == sum(t is None for _, t in rows[1]) == 2
    ids = [i for i, _ in rows[3]]
    assert 7 in ids and 8 not in ids and ids.count(3001) <= 2 and 3002 not in ids and None in ids and len(rows[3]) < len(rows[2])
    assert len(rows[4]) == len(rows[3]) and not any(secret in (t or "") for _, t in rows[4]) and any("<secret>" in (t or "") for _, t in rows[4])
    encode = token_count.encoding(token_count.VOCABULARY).encode_ordinary
    tokens = sum(len(encode(t)) for _, t in rows[4] if t)
    assert steps[5].selectExpr("sum(token_end - token_begin)").first()[0] == tokens
    assert sorted(map(str, corpus_pipeline.run(spark, folder).drop("bin").collect())) == sorted(map(str, steps[5].drop("bin").collect()))


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF)
    assert docs.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
