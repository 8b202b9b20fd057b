import random

import numpy as np
import pytest
import tiktoken
from llm_samples import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rootweave.llm import bpe_replay, token_count, wavelet
from rootweave.llm import textkit as tk

TEXTS = ["it's I'll we've 's'd x''s \"'re don't 're're", "  a\n\n b \t c  ", "", "'", "a'", "'s", " 's", "aaaa aaaaaaa", "naïve 中文 🙂🙂 \x00", "zzzzzzz===---", "x 　y", "12½ 3", "\n", " ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe_replay.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def pieces(text):
    cp, bounds, whole = tk.code_points([text])
    return [whole[a:b] for a, b in zip(*tk.pretokens(cp, bounds))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sdtmrevl  \n\té1²!_-中🙂")), max_size=30))
def test_pretokens_follow_the_pattern(text):
    import regex

    assert pieces(text) == regex.findall(token_count.PATTERN, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_replay_equals_the_tokenizer(texts):
    texts = [t for t in texts if t.isprintable() or "\ud800" not in t]
    t = Tokenizer.from_file(bpe_replay.VOCABULARY) if not hasattr(test_replay_equals_the_tokenizer, "t") else test_replay_equals_the_tokenizer.t
    t.encode_special_tokens = True
    test_replay_equals_the_tokenizer.t = t
    m = bpe_replay.merges(bpe_replay.VOCABULARY)
    ids, at = bpe_replay.encode(m, texts)
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == t.encode(text, add_special_tokens=False).ids
        assert bpe_replay.decode(m, own).decode() == text


def test_encode_documents(spark, odd, docs_of, reference):
    out = bpe_replay.encode_documents(odd)
    rows = out.collect()
    texts = sorted((str(r.doc_id), str(r.text)[:50]) for r in odd.collect())
    assert len(rows) == len(texts) and out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"]
    by = {r.doc_id: r for r in rows}
    assert by[3].token_ids is None and by[3].n_tokens is None and by[3].round_trip is None
    assert by[4].token_ids == [] and by[4].n_tokens == 0 and by[4].round_trip is True
    assert by[11].token_ids == reference("Ünïcödé 中文 🙂 it's") and all(r.round_trip in (True, None) for r in rows)
    assert by[8].token_ids == reference(prose(60_000, 1) + " tail")
    back = {r.doc_id: r.text for r in bpe_replay.decode_documents(out).collect()}
    assert back == {r.doc_id: r.text for r in odd.collect()}
    assert bpe_replay.encode_documents(docs_of([])).count() == 0


def test_counts_equal_tiktoken(odd, docs_of):
    enc = token_count.encoding(token_count.VOCABULARY)
    assert isinstance(enc, tiktoken.Encoding)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (None, "null id")] + [(200 + k, prose(300, k, 50)) for k in range(20)]
    want = sorted(((i, None if t is None else len(enc.encode_ordinary(t))) for i, t in rows), key=str)
    df = docs_of(rows)
    for entries in (0, 8, token_count.FREQUENT):
        got = token_count.count_tokens(df, entries=entries)
        assert got.columns == ["doc_id", "n_tokens"] and sorted(map(tuple, got.collect()), key=str) == want
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(odd).collect()}[7] == len(enc.encode_ordinary(prose(60_000, 1)))
    assert token_count.count_tokens(docs_of([])).count() == 0


def test_counts_of_very_long_pretokens(docs_of):
    dna = "".join(random.Random(4).choices("ACGT", k=120_000))
    texts = ["a" * 200_000, "b a", dna, "中" * 70_000]
    df = docs_of([(k, t) for k, t in enumerate(texts)] + [(9, texts[0]), (10, texts[0])])
    encode = token_count.encoding(token_count.VOCABULARY).encode_ordinary
    want = {k: len(encode(t)) for k, t in enumerate(texts)}
    want[9] = want[10] = want[0]
    assert max(want.values()) > 60_000
    for entries in (token_count.FREQUENT, 1, 0):
        assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, entries=entries).collect()} == want
    assert want[0] in token_count.frequent_table(df)["size"].tolist()  # a run that several documents share is in the table


def test_frequent_table_holds_the_most_frequent(docs_of):
    df = docs_of([(k, "the of the " + prose(50, k)) for k in range(60)]).repartition(7)
    table = token_count.frequent_table(df, entries=5)
    hashes, sizes = table["hash"], table["size"]
    cp, bounds, _ = tk.code_points(["the of the"])
    want = tk.span_hashes(cp, *tk.pretokens(cp, bounds))
    assert set(want.tolist()) - {int(want[0])} <= set(hashes.tolist()) and len(hashes) <= 5 and (sizes > 0).all()


def thue_morse(n):
    a = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024, 2048, 4096])
def test_structured_texts_of_one_polynomial_are_told_apart(docs_of, reference, n):
    a, b = thue_morse(n)
    m = bpe_replay.merges(bpe_replay.VOCABULARY)
    ids, at = bpe_replay.encode(m, [a, b, a])
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(3)] == [reference(a), reference(b), reference(a)]
    cp, bounds, _ = tk.code_points([a, b])
    h = tk.span_hashes(cp, bounds[:-1], bounds[1:])
    assert h[0] != h[1]
    for entries in (token_count.FREQUENT, 0):
        got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs_of([(1, a), (2, b), (3, a), (4, b)]), entries=entries).collect()}
        assert got == {1: len(reference(a)), 2: len(reference(b)), 3: len(reference(a)), 4: len(reference(b))}


def test_spans_of_one_hash_are_told_apart():
    cp, bounds, _ = tk.code_points(["abc", "abd", "abc", "ab", "abd", "xyz"])
    first, which = tk.distinct_spans(cp, bounds[:-1], bounds[1:], np.array([7, 7, 7, 7, 7, 1], np.uint64))
    assert which[0] == which[2] and which[1] == which[4] and len(set(which.tolist())) == 4 == len(first)
    assert [which[k] for k in first] == list(range(4))


def test_table_holds_what_collides():
    hashes = np.array([5, 5 + (1 << 63), 6, 7, (5 << 50) + 1, 1 << 62], np.uint64)
    check = np.arange(6, dtype=np.uint64)
    t = token_count.Table(hashes, check, np.arange(6, dtype=np.int32) * 70_000)
    assert t.sizes(hashes, check).tolist() == [0, 70_000, 140_000, 210_000, 280_000, 350_000]
    assert t.sizes(hashes, check + np.uint64(1)).tolist() == [-1] * 6


def test_a_task_remembers_its_pretokens(reference):
    m = bpe_replay.merges(bpe_replay.VOCABULARY)
    memo = bpe_replay.Words(m, most=30)
    for k in range(6):
        text = prose(40, k, 60)
        assert bpe_replay.encode(m, [text], memo)[0].tolist() == reference(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=200))
def test_wavelet_matrix_equals_the_sequence(x):
    w = wavelet.WaveletMatrix(wavelet.build(np.array(x, np.int64)))
    assert len(w) == len(x) and [w.access(i) for i in range(len(x))] == x
    for t in {*x[:5], 3}:
        at = [i for i, v in enumerate(x) if v == t]
        assert w.positions(t) == at and w.count(t) == len(at) and w.rank(t, len(x) // 2) == sum(i < len(x) // 2 for i in at)


def test_wavelet_over_many_blocks():
    rng = random.Random(1)
    x = [min(int(rng.paretovariate(0.6)), 50_000) for _ in range(100_000)]
    w = wavelet.WaveletMatrix(wavelet.build(np.array(x)))
    assert [w.access(i) for i in range(0, 100_000, 501)] == x[::501]
    at = [i for i, v in enumerate(x) if v == 2]
    assert [w.select(2, k) for k in range(0, len(at), 97)] == at[::97] and w.rank(2, 65_536) == sum(i < 65_536 for i in at)
    with pytest.raises(IndexError):
        w.select(2, len(at))


def test_shards_hold_every_token(odd, docs_of, reference):
    rows = odd.collect()
    shards = wavelet.shards(odd, shard_tokens=5_000)
    seen = []
    for s in shards.collect():
        w = wavelet.WaveletMatrix(s.blob)
        assert len(w) == s.n_tokens == s.doc_begins[-1] and len(s.doc_ids) + 1 == len(s.doc_begins)
        for i, a, b in zip(s.doc_ids, s.doc_begins, s.doc_begins[1:]):
            seen.append((i, b - a))
            if i == 11:
                assert [w.access(k) for k in range(a, b)] == reference("Ünïcödé 中文 🙂 it's")
    assert sorted(seen, key=str) == sorted(((r.doc_id, len(reference(r.text or ""))) for r in rows), key=str)
    token = reference("alpha beta")[-1]
    hits = [r for r in wavelet.occurrences(shards, [token]).collect()]
    want = [(token, r.doc_id, p) for r in rows for p, t in enumerate(reference(r.text or "")) if t == token]
    assert sorted(map(tuple, hits), key=str) == sorted(want, key=str)
    assert wavelet.token_totals(shards, [token]).first().n == len(want)
    assert wavelet.shards(docs_of([])).count() == 0


def test_files_are_read_block_by_block(spark, tmp_path, reference):
    rows = [(f"d{k}", prose(400, k)) for k in range(12)] + [(None, "x y"), ("e", None)]
    made = wavelet.shards(spark.createDataFrame(rows, "doc_id string, text string").coalesce(2), shard_tokens=2_000)
    files = wavelet.write_files(made, str(tmp_path / "wm")).collect()
    assert len({r.path for r in files}) == len(files) > 1
    seen = {}
    for r in files:
        with wavelet.WaveletFile(r.path) as w:
            for i, a, b in zip(r.doc_ids, r.doc_begins, r.doc_begins[1:]):
                seen[i] = [w.access(k) for k in range(a, b)]
    assert seen == {i: reference(t or "") for i, t in rows}
    token = reference(rows[0][1])[0]
    hits = sorted((r.doc_id, r.position) for r in wavelet.occurrences(made, [token]).collect())
    assert hits == sorted((i, p) for i, t in rows for p, x in enumerate(reference(t or "")) if x == token)


def test_pairs_of_bytes_are_ranked_by_table(monkeypatch):
    m = bpe_replay.merges(bpe_replay.VOCABULARY)
    a, b = np.repeat(np.arange(256, dtype=np.uint8), 256), np.tile(np.arange(256, dtype=np.uint8), 256)
    assert (m.byte_rank(a, b) == m.rank(m.byte_id[a], m.byte_id[b])).all()
    words, asked, real = [b"he", b"in", b"er", b"\xff\x00"], [], m.rank
    monkeypatch.setattr(m, "rank", lambda a, b: (asked.append(len(a)), real(a, b))[1], raising=False)
    bpe_replay.replay(m, np.frombuffer(b"".join(words), np.uint8), np.arange(0, 9, 2))
    assert sum(asked) == 0  # no merge leaves a neighbour


def test_matrix_bytes_equal_a_plain_construction():
    rng = np.random.default_rng(8)
    for n, most in ((1, 1), (32_768, 50_000), (32_769, 65_535), (150_001, 65_536), (70_000, 1 << 20)):
        tokens = rng.integers(0, most, n)
        tokens[-1] = most
        w = wavelet.WaveletMatrix(wavelet.build(tokens))
        rest, planes = tokens, int(tokens.max()).bit_length()
        assert w.planes == planes
        for level in range(planes):
            bit = rest >> (planes - 1 - level) & 1 == 1
            got = np.concatenate([w._bits(level * w._per + k)[: min(wavelet.BLOCK_BITS, n - k * wavelet.BLOCK_BITS)] for k in range(w._per)])
            assert (got == bit).all() and w.zeros[level] == n - bit.sum()
            assert w._ones[level * w._per : (level + 1) * w._per].tolist() == [int(bit[: k * wavelet.BLOCK_BITS].sum()) for k in range(w._per)]
            rest = np.concatenate([rest[~bit], rest[bit]])
