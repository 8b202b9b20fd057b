import duckdb
import pytest

import __spark_entry__ as entry
from rootweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["bm25_topk", "phrase_match", "rrf_fuse", "edge_confidence", "impact_up", "adjacent_modularity", "fingerprint_diff", "line_windows_20_5", "recall_mrr_ndcg", "edit_sessions"]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    out = con.execute(registry.ORACLE[name])
    names = [c[0] for c in out.description]
    want = sorted(str([row[names.index(c)] for c in cols]) for row in out.fetchall())
    assert sorted(names) == cols and sorted(str([r[c] for c in cols]) for r in df.collect()) == want
