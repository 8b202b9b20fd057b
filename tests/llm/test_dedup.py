import random
from collections import defaultdict

import numpy as np
import pytest
from llm_samples import prose

from pyspark.sql import functions as F

from rootweave.llm import common, exact_dedup, simhash
from rootweave.llm.common import components


def groups_by_text(rows):
    by = defaultdict(list)
    for i, t in rows:
        if t is not None:
            by[t].append(i)
    return {t: ids for t, ids in by.items() if len(ids) > 1}


def test_exact_groups_equal_brute_force(odd, docs_of):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, f"same head {'x' * 80} {i % 7}") for i in range(40)]
    df = docs_of(rows)
    got = sorted(((r.doc_id, r.group_id, r.is_kept) for r in exact_dedup.groups(df).collect()), key=str)
    want = []
    for ids in groups_by_text(rows).values():
        order = sorted(ids, key=lambda i: (i is None, i))
        want += [(i, order[0], k == 0) for k, i in enumerate(order)]
    assert got == sorted(want, key=str)


def test_exact_dedup_keeps_one_and_all_columns(odd):
    out = exact_dedup.dedup(odd)
    assert out.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    texts = [t for _, t in kept if t is not None]
    assert len(texts) == len(set(texts)) and kept.count((3, None)) == 1 and kept.count((None, None)) == 1
    assert (1, "alpha beta") in kept and (4, "") in kept


def test_exact_empty_table(docs_of):
    empty = docs_of([])
    assert exact_dedup.groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_corpus():
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(120):
        words = prose(150, k).split()
        rows.append((10 * k, " ".join(words)))
        if k % 3 == 0:
            edited = [w if rng.random() > 0.04 else f"z{rng.randrange(999)}" for w in words]
            rows.append((10 * k + 1, " ".join(edited)))
            pairs.append((10 * k, 10 * k + 1))
    return rows, pairs


def test_near_pairs_recall_against_all_pairs():
    rows, _ = near_corpus()
    fp, has = simhash.fingerprints([t for _, t in rows])
    assert has.all()
    bits = simhash.unpacked(fp).astype(int)
    true = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (bits[i] != bits[j]).sum() <= simhash.DISTANCE}
    positions = simhash.key_positions(*simhash.layout(len(rows)))
    got = [p for t in range(len(positions)) for a, b in simhash.range_pairs(fp, np.arange(len(rows)), t, positions, simhash.DISTANCE, simhash.PIVOTS) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) <= true and len(set(got)) >= 0.9 * len(true) > 0


def near_found(fp, n=None):
    """Pairs of the tables that a corpus of n fingerprints would have."""
    positions = simhash.key_positions(*simhash.layout(n or len(fp)))
    return {p for t in range(len(positions)) for a, b in simhash.range_pairs(fp, np.arange(len(fp)), t, positions, simhash.DISTANCE, simhash.PIVOTS) for p in zip(a.tolist(), b.tolist())}


@pytest.mark.parametrize("size", [400, 250_000, 16_000_000])
def test_recall_at_each_distance(size):
    rng, n = np.random.default_rng(11), 400
    for distance in range(12, simhash.DISTANCE + 1) if size == 400 else (16, 18, 20):
        bits = rng.integers(0, 2, (n, simhash.BITS)).astype(np.uint8)
        flips = np.zeros_like(bits)
        np.put_along_axis(flips, np.argsort(rng.random(bits.shape), axis=1)[:, :distance], 1, axis=1)
        fp = np.packbits(np.concatenate([bits, bits ^ flips]), axis=1).view(">i8").astype(np.int64)
        got = near_found(fp, size)
        assert sum((k, n + k) in got for k in range(n)) >= 0.9 * n, distance


def test_recall_with_more_edits():
    for share in (0.08, 0.1, 0.12):
        rng, texts = random.Random(7), []
        for k in range(400):
            words = prose(150, k).split()
            texts += [" ".join(words), " ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in words)]
        fp, _ = simhash.fingerprints(texts)
        far = np.bitwise_count(fp[::2].view(np.uint64) ^ fp[1::2].view(np.uint64)).sum(axis=1)
        true = {(2 * k, 2 * k + 1) for k in np.flatnonzero(far <= simhash.DISTANCE).tolist()}
        assert len(true & near_found(fp)) >= 0.9 * len(true) > 30, share


def flipped(rng, base, n, most):
    """n copies of a fingerprint's bits with up to `most` of them turned."""
    out = np.repeat(base[None], n, axis=0)
    for k in range(n):
        out[k, rng.choice(simhash.BITS, rng.integers(0, most + 1), replace=False)] ^= 1
    return out


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def test_links_of_a_large_bucket_connect_what_all_its_pairs_connect():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2, (2, simhash.BITS)).astype(np.uint8)
    chain = np.stack([np.where(np.arange(simhash.BITS) < 12 * k, 1 - b, b) for k in range(9)]).astype(np.uint8)
    bits = np.concatenate([flipped(rng, a, 150, 10), flipped(rng, b, 90, 14), chain, rng.integers(0, 2, (60, simhash.BITS)).astype(np.uint8), flipped(rng, a ^ 1, 40, 30)])
    bits = bits[rng.permutation(len(bits))]
    fp = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    n = len(fp)
    true = {(i, j) for i in range(n) for j in range(i + 1, n) if (bits[i] != bits[j]).sum() <= simhash.DISTANCE}
    links = [p for i, j in simhash.bucket_links(fp, simhash.pivot_table(bits), 0, n, simhash.DISTANCE) for p in zip(i.tolist(), j.tolist())]
    assert set(links) <= true and roots(n, links) == roots(n, true) and len(links) == n - len(set(roots(n, true)))


def test_tables_connect_the_same_whether_buckets_are_paired_or_linked():
    rng = np.random.default_rng(9)
    bits = np.concatenate([flipped(rng, base, 200, 12) for base in rng.integers(0, 2, (3, simhash.BITS)).astype(np.uint8)])
    fp = np.unique(np.packbits(bits, axis=1).view(">i8").astype(np.int64), axis=0)
    positions = simhash.key_positions(*simhash.layout(len(fp)))
    found = [{p for t in range(len(positions)) for a, b in simhash.range_pairs(fp, np.arange(len(fp)), t, positions, simhash.DISTANCE, simhash.PIVOTS, most) for p in zip(a.tolist(), b.tolist())} for most in (10**9, 16)]
    assert roots(len(fp), found[0]) == roots(len(fp), found[1]) and len(found[1]) < len(found[0]) / 3


def test_two_groups_of_many_near_copies_in_one_bucket_take_linear_work():
    rng = np.random.default_rng(2)
    bits = np.concatenate([flipped(rng, base, 20_000, 8) for base in rng.integers(0, 2, (2, simhash.BITS)).astype(np.uint8)])
    fp = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    tests, real = [], simhash.verified
    simhash.verified = lambda fp, far, i, j, distance: (tests.append(len(i)), real(fp, far, i, j, distance))[1]
    try:
        links = sum(len(i) for i, _ in simhash.bucket_links(fp, simhash.pivot_table(bits), 0, len(fp), simhash.DISTANCE))
    finally:
        simhash.verified = real
    assert links == len(fp) - 2 and sum(tests) < 20 * len(fp)


def planted(rng, n, distance):
    """n random fingerprints and a copy of each with so many bits turned."""
    bits = rng.integers(0, 2, (n, simhash.BITS)).astype(np.uint8)
    flips = np.zeros_like(bits)
    np.put_along_axis(flips, np.argsort(rng.random(bits.shape), axis=1)[:, :distance], 1, axis=1)
    return np.packbits(np.concatenate([bits, bits ^ flips]), axis=1).view(">i8").astype(np.int64)


def test_no_pair_at_the_distance_is_lost(spark):
    n = 3_000
    fp = planted(np.random.default_rng(12), n, simhash.DISTANCE)
    nodes = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(fp.tolist())], "node long, h1 long, h2 long")
    for each in (10_000, 100):
        got = {(r.a, r.b) for r in simhash.near_pairs(nodes, 2 * n, shard_rows=each).collect()}
        assert got == {(k, n + k) for k in range(n)}, each
    assert 0.9 * n < simhash.near_pairs(nodes, 2 * n, recall=0.95).count() < n  # what a caller may ask for


def test_some_mask_has_none_of_any_differing_bits():
    rng = np.random.default_rng(6)
    for distance in (0, 1, 3, 12, 20, 31):
        masks = simhash.cover(distance)
        for _ in range(200):
            at = rng.choice(simhash.BITS, distance, replace=False) if rng.random() < 0.7 else rng.integers(0, simhash.BITS - distance) + np.arange(distance)
            bits = np.zeros(simhash.BITS, np.uint8)
            bits[at] = 1
            differ = np.packbits(bits).view(">u8").astype(np.uint64)
            assert (masks & differ == 0).all(axis=1).any()
        for ranges in (1, 3, 1000):
            groups = simhash.table_groups(masks, ranges)
            assert sorted(t for g in groups for t in g.tolist()) == list(range(len(masks)))


def test_groups_of_tables_connect_what_all_near_pairs_connect():
    rng = np.random.default_rng(13)
    a, b = rng.integers(0, 2, (2, simhash.BITS)).astype(np.uint8)
    chain = np.stack([np.where(np.arange(simhash.BITS) < 20 * k, 1 - b, b) for k in range(7)]).astype(np.uint8)
    bits = np.concatenate([flipped(rng, a, 150, 10), flipped(rng, b, 300, 14), flipped(rng, b ^ 1, 90, 30), chain, rng.integers(0, 2, (60, simhash.BITS)).astype(np.uint8)])
    fp = np.unique(np.packbits(bits, axis=1).view(">i8").astype(np.int64), axis=0)
    n, masks = len(fp), simhash.cover(simhash.DISTANCE)
    off = np.bitwise_count(fp[:, None].view(np.uint64) ^ fp[None].view(np.uint64)).sum(axis=2)
    true = set(zip(*(x.tolist() for x in np.nonzero(np.triu(off <= simhash.DISTANCE, 1)))))
    for ranges in (1, 50):
        for most in (64, 4, 10**9):
            found = [simhash.covered_links(fp, np.arange(n), g, masks, simhash.DISTANCE, simhash.PIVOTS, most) for g in simhash.table_groups(masks, ranges)]
            links = [p for i, j in found for p in zip(i.tolist(), j.tolist())]
            assert set(links) <= true and roots(n, links) == roots(n, true) and len(links) < 10 * n < len(true)


def test_pivots_never_lose_a_pair():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (60, simhash.BITS)).astype(np.uint8)
    far = simhash.pivot_table(bits).astype(int)
    for i in range(60):
        for j in range(i):
            assert np.abs(far[i] - far[j]).max() <= (bits[i] != bits[j]).sum()


def test_pivots_discard_most_far_pairs():
    """Among random fingerprints that share a key, before any is verified."""
    rng = np.random.default_rng(3)
    for size in (400, 250_000):
        positions = simhash.key_positions(*simhash.layout(size))
        bits = rng.integers(0, 2, (300, simhash.BITS)).astype(np.uint8)
        bits[:, positions[0]] = bits[0, positions[0]]
        far = simhash.pivot_table(bits).astype(int)
        i, j = np.triu_indices(300, 1)
        apart = np.abs(far[i] - far[j]).max(axis=1) > simhash.DISTANCE
        assert apart.mean() > 0.6


def test_key_bits_follow_the_number_of_fingerprints():
    assert simhash.layout(2) == simhash.layout(4_000) and [simhash.layout(1 << k)[1] for k in (14, 20, 30, 60)] == [12, 18, 28, 40]
    assert all(simhash.layout(1 << k)[0] <= simhash.layout(1 << k + 1)[0] < 1.3 * simhash.layout(1 << k)[0] + 1 for k in range(14, 40))


def test_ids_of_any_type_and_hot_groups(spark):
    text = prose(60, 1)
    rows = [(f"d{k:03d}", text) for k in range(40)] + [("a", prose(60, 2)), ("a", prose(60, 3)), ("b", prose(60, 2)), ("c", prose(60, 3)), ("lone", prose(60, 4)), (None, text)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for hot in (simhash.HOT_ROWS, 5):
        got = {r.doc_id: r.group_id for r in simhash.members(df, hot_rows=hot).collect()}
        assert got == {f"d{k:03d}": "d000" for k in range(40)} | {"a": "a", "b": "a", "c": "a"}
        own = exact_dedup.groups(df, hot_rows=hot).collect()
        assert sorted((r.group_id, r.is_kept) for r in own if r.is_kept) == [("a", True), ("a", True), ("d000", True)] and len(own) == 41 + 4
    assert sorted(str(r.doc_id) for r in simhash.dedup(df).collect()) == ["None", "a", "a", "d000", "lone"]


def test_one_text_copied_very_often(spark):
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    for hot in (exact_dedup.HOT_ROWS, 1_000):
        out = exact_dedup.groups(df, hot_rows=hot).agg(F.count("*").alias("n"), F.count_if("is_kept").alias("kept"), F.max("group_id").alias("g")).first()
        assert tuple(out) == (133_334, 1, 0)
    assert exact_dedup.dedup(df).count() == 66_667


def test_full_key_filter_changes_no_result(odd, monkeypatch):
    before = sorted(map(str, exact_dedup.groups(odd).collect()))
    monkeypatch.setattr(common, "FILTER_BYTES", 16)
    assert sorted(map(str, exact_dedup.groups(odd).collect())) == before


def test_key_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select((F.col("id") * 7).alias("k"))
    may = common.key_filter(keys, 20_000)
    out = spark.range(140_000).select("id", may(F.col("id")).alias("m"))
    assert out.where("id % 7 = 0 AND NOT m").count() == 0 and out.where("id % 7 <> 0 AND m").count() < 0.06 * 120_000
    none = common.key_filter(keys.limit(0), 0)
    assert spark.range(10).where(none(F.col("id"))).count() == 0


def test_fingerprint_is_the_majority_of_distinct_words():
    texts = [prose(700, 1), "b a b a c", "", None, "?!", "A b C"]
    fp, has = simhash.fingerprints(texts)
    assert has.tolist() == [True, True, False, False, False, True]
    assert (fp[1] == fp[5]).all()  # order, case and repeats don't count
    alone, _ = simhash.fingerprints(texts[:1])
    assert (alone[0] == fp[0]).all()  # nor does the company of other texts


def test_near_groups_end_to_end(docs_of):
    rows, pairs = near_corpus()
    rows += [(5000 + k, rows[0][1]) for k in range(30)] + [(None, rows[0][1]), (6000, None), (6001, "")]
    df = docs_of(rows)
    group = {r.doc_id: r.group_id for r in simhash.groups(df).collect()}
    assert all(group.get(5000 + k) == 0 for k in range(30)) and group[0] == 0
    assert sum(group.get(a) == group.get(b) == a for a, b in pairs) >= 0.9 * len(pairs)
    assert all(i % 30 in (0, 1) or i >= 5000 for i in group)  # clean documents are left alone
    kept = simhash.dedup(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and None in ids and 6000 in ids and 6001 in ids and 5003 not in ids and 0 in ids
    assert len(ids) == len(rows) - sum(i != g for i, g in group.items())


def test_near_odd_inputs(odd, docs_of):
    group = {r.doc_id: r.group_id for r in simhash.groups(odd).collect()}
    assert group[1] == group[2] == 1 and group[7] == group[8] == 7 and group[12] == group[13] == 12
    assert not {3, 4, 5, 6, 10} & set(group)
    out = simhash.dedup(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and ids.count(1) == 2 and ids.count(None) == 2 and not {2, 8, 13} & set(ids)
    assert simhash.groups(docs_of([])).count() == 0 and simhash.dedup(docs_of([])).count() == 0


def test_many_shards_find_the_same_pairs(docs_of):
    rows, _ = near_corpus()
    df = docs_of(rows, clash=False)
    one, many = (sorted((r.doc_id, r.group_id) for r in simhash.members(df, shard_rows=n).collect()) for n in (10_000, 20))
    assert one == many
