"""Queries of the text, retrieval and ranking operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.functions import paths as P
from rootweave.functions import text as T
from rootweave.operators import fulltext, fuse, metrics, parse, retrieve
from rootweave.plans import search, snippets
from rootweave.storage import once, shared_dir
from rootweave.plans.views import URL_PATH_SQL, chunks, symbols, table, url_path, with_views
from rootweave.streaming import watch

TERMS = ["thble", "thtion"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_TOKENS = "SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.tokenised(table(spark, d, "documents"), "doc_id", F.col("text"))


def _bm25_sql(where: str, tail: str) -> str:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return f"""
        WITH d AS ({_TOKENS}), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
             p AS (SELECT doc_id, len(w) AS l, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf FROM d, (SELECT unnest([{terms}]) AS term) t),
             h AS (SELECT * FROM p WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
             r AS (SELECT doc_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score, count(*) AS k
                   FROM h JOIN f USING (term), s GROUP BY doc_id)
        SELECT doc_id, round(score, 6) AS score FROM r WHERE {where} {tail}"""


def index_folder(spark: SparkSession, d: str) -> str:
    """The stored full-text index of the documents: built once for a session and tables, then read by every query."""

    def build() -> str:
        folder = f"{shared_dir(spark).rstrip('/')}/fulltext-{uuid.uuid4().hex}"
        fulltext.write_index(_docs(spark, d), folder)
        return folder

    return once(spark, f"full text of {d}", build)


@query(f"WITH d AS ({_TOKENS}), e AS (SELECT doc_id, unnest(w) AS term FROM d) SELECT (SELECT count(*) FROM d) AS n_docs, round((SELECT avg(len(w)) FROM d), 6) AS avg_len, count(DISTINCT term) AS terms, count(DISTINCT (doc_id, term)) AS entries, count(*) AS tokens FROM e")
def fulltext_index(spark: SparkSession, d: str) -> DataFrame:
    """Builds the index, if this session hasn't, and says what it holds."""
    i = fulltext.open_index(spark, index_folder(spark, d))
    held = i.postings.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("entries"), F.sum("tf").alias("tokens"))
    return i.corpus.select("n_docs", F.round("avg_len", 6).alias("avg_len")).crossJoin(F.broadcast(held))  # one row each


@query(_bm25_sql("k = 2", "ORDER BY r.score DESC, doc_id LIMIT 10"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    found = fulltext.bm25_indexed(fulltext.open_index(spark, index_folder(spark, d)), [[t] for t in TERMS])
    return fulltext.top(found, 10, "doc").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql("k = 2", "ORDER BY r.score DESC, doc_id LIMIT 10"))
def bm25_scan_topk(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.top(fulltext.bm25(_docs(spark, d), [[t] for t in TERMS]), 10, "doc").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql("true", ""))
def bm25_indexed_any(spark: SparkSession, d: str) -> DataFrame:
    found = fulltext.bm25_indexed(fulltext.open_index(spark, index_folder(spark, d)), [[t] for t in TERMS], all_groups=False)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH d AS ({_TOKENS}), e AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d)
           SELECT a.doc_id, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY a.doc_id""")
def phrase_indexed(spark: SparkSession, d: str) -> DataFrame:
    found = fulltext.indexed_counts(fulltext.open_index(spark, index_folder(spark, d)), ["of the"])
    return found.where("f_0 > 0").select(F.col("doc").alias("doc_id"), F.col("f_0").alias("n"))


@query(f"WITH d AS ({_TOKENS}) SELECT doc_id, len(w) AS len FROM d WHERE (list_contains(w, 'thble') OR list_contains(w, 'attion')) AND list_contains(w, 'thing')")
def match_and_or_groups(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_docs(spark, d), [["thble", "attion"], ["thing"]]).select(F.col("doc").alias("doc_id"), "len")


@query(f"""WITH d AS ({_TOKENS}), e AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d)
           SELECT a.doc_id, count(*) AS n FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY a.doc_id""")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_docs(spark, d), [["of the"]]).select(F.col("doc").alias("doc_id"), F.col("f_0").alias("n"))


@query(f"WITH d AS ({_TOKENS}) SELECT doc_id, len(w) AS len, len(list_distinct(w)) AS terms FROM d")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("doc").alias("doc_id"), F.size("tokens").cast("long").alias("len"), F.size(F.array_distinct("tokens")).cast("long").alias("terms"))


@query(f"WITH d AS ({_TOKENS}), e AS (SELECT doc_id, unnest(w) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM e GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.document_frequency(_docs(spark, d)).select("term", "df", F.col("cf").cast("long").alias("cf"))


@query(f"WITH d AS ({_TOKENS}), e AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM d) SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tf, sum(first)::BIGINT AS first_positions FROM (SELECT term, doc_id, count(*) AS tf, min(i) AS first FROM e GROUP BY term, doc_id) GROUP BY term")
def postings_summary(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.postings(_docs(spark, d)).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"), F.sum(F.col("positions")[0].cast("long")).alias("first_positions"))


@query("""SELECT c_custkey, array_to_string(list_filter(regexp_extract_all(c_name, '[A-Z]?[a-z0-9]+'), lambda p: len(p) >= 2), ',') AS parts FROM customer""")
def identifier_subtokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.subtokens(F.col("c_name")), ",").alias("parts"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'small')")
def symbol_prefix(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.lit("").alias("path"), F.col("p_partkey").alias("line_start"))
    return retrieve.symbols_by_name(s, "Small", exact=False).select("p_partkey", F.col("name").alias("p_name"))


@query("""WITH g AS (SELECT l_partkey, count(*) AS in_degree FROM lineitem GROUP BY l_partkey)
          SELECT p_partkey, p_name, coalesce(in_degree, 0) AS in_degree FROM part LEFT JOIN g ON l_partkey = p_partkey WHERE contains(lower(p_name), 'ring')
          ORDER BY lower(p_name) = 'ring' DESC, starts_with(lower(p_name), 'ring') DESC, in_degree DESC, p_partkey LIMIT 20""")
def symbol_nocase_rank(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("g"))
    s = table(spark, d, "part").join(g, "p_partkey", "left").select("p_partkey", F.col("p_name").alias("name"), F.lit("").alias("path"), F.col("p_partkey").alias("line_start"), F.coalesce("g", F.lit(0)).alias("in_degree"))
    return retrieve.search_names(s, "RING", 20).select("p_partkey", F.col("name").alias("p_name"), "in_degree")


@query("""WITH s AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS parts, lower(p_name) AS n FROM part)
          SELECT p_partkey, (contains(n, 'red')::INT + contains(n, 'ring')::INT) AS covered, round(len(list_intersect(parts, ['red', 'ring'])) / len(parts), 6) AS tightness FROM s WHERE contains(n, 'red') OR contains(n, 'ring')""")
def symbol_coverage_score(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    s = table(spark, d, "part").where(F.exists(retrieve.literals(TERMS2), lambda t: F.lower("p_name").contains(t)))
    return s.withColumns(retrieve.name_score(name, TERMS2)).select("p_partkey", "covered", F.round("tightness", 6).alias("tightness"))


TERMS2 = ["red", "ring"]


@query(f"""WITH f AS ({URL_PATH_SQL}), h AS (SELECT page_id, path, contains(lower(path), 'blog')::INT + contains(lower(path), 'fr')::INT AS hits FROM f),
          t AS (SELECT *, row_number() OVER (ORDER BY hits DESC, len(path), path, page_id) AS r FROM h WHERE hits > 0)
          SELECT path, hits, round(hits / r, 6) AS score FROM t WHERE r <= 25""")
def path_token_hits(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.path_candidates(url_path(table(spark, d, "pages")), ["blog", "fr"], 25).select("path", "hits", F.round("score", 6).alias("score"))


@query(f"""WITH f AS ({URL_PATH_SQL}), p AS (SELECT page_id, string_split(lower(path), '/') AS a FROM f),
          e AS (SELECT page_id, array_to_string(a[i:], '/') AS suffix FROM p, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))
          SELECT suffix, min(page_id) AS page_id FROM e GROUP BY suffix HAVING count(*) = 1""")
def url_suffix_unique(spark: SparkSession, d: str) -> DataFrame:
    from rootweave.operators.graph import unique_suffixes

    return unique_suffixes(url_path(table(spark, d, "pages")).withColumnRenamed("page_id", "file_id")).select("suffix", F.col("file_id").alias("page_id"))


_SUFFIX_CASE = " ".join(f"WHEN '{s}' THEN '{lang}'" for s, lang in P.BY_SUFFIX.items())


@query(f"""WITH f AS ({URL_PATH_SQL}), s AS (SELECT page_id, regexp_extract(lower(string_split(path, '/')[-1]), '^.+\\.([^.]+)$', 1) AS x FROM f)
          SELECT page_id, l AS lang, CASE WHEN l IN ({', '.join(f"'{c}'" for c in P.CODE)}) THEN 'treesitter' ELSE 'line' END AS parser
          FROM (SELECT page_id, CASE x {_SUFFIX_CASE} END AS l FROM s)""")
def language_of_path(spark: SparkSession, d: str) -> DataFrame:
    lang = P.language(F.col("path"))
    return url_path(table(spark, d, "pages")).select("page_id", lang.alias("lang"), P.parser(lang).alias("parser"))


_PATHS = ["src/tests/x.py", "contest/a.py", "a/test_b.py", "a/b_test.go", "c/d.spec.ts", "latest.py", "x.generated.ts", "app.min.js", ".env", "k/server.pem", "spec.md", "Dockerfile", "testing/e.rb"]
_PATH_ROWS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(_PATHS))


@query(f"""WITH v(i, tail) AS (VALUES {_PATH_ROWS}), f AS (SELECT source || '/' || tail AS path, lower(string_split(tail, '/')[-1]) AS name, string_split(lower(source || '/' || tail), '/')[:-2] AS dirs FROM (SELECT DISTINCT source FROM documents), v)
          SELECT path, len(list_intersect(dirs, ['__test__', '__tests__', 'e2e', 'spec', 'specs', 'test', 'testing', 'tests'])) > 0 OR string_split(name, '.')[1] = 'test' OR starts_with(name, 'test_') OR ends_with(string_split(name, '.')[1], '_test') OR contains(name, '.test.') OR contains(name, '.spec.') AS is_test,
                 contains(name, '.generated.') OR ends_with(name, '.min.js') OR ends_with(name, '.min.css') OR ends_with(name, '.generated') AS is_generated,
                 name IN ('credentials.json', 'secrets.json', 'service-account.json', 'id_ed25519', 'id_rsa', '.env') OR starts_with(name, '.env.') OR regexp_matches(name, '\\.(pem|key|p12|pfx)$') AS is_secret FROM f""")
def path_flags(spark: SparkSession, d: str) -> DataFrame:
    tails = F.explode(F.array(*[F.lit(p) for p in _PATHS]))
    path = F.col("path")
    return table(spark, d, "documents").select("source").distinct().select("source", tails.alias("tail")).select(F.concat_ws("/", "source", "tail").alias("path")).select("path", P.is_test(path).alias("is_test"), P.is_generated(path).alias("is_generated"), P.is_secret_name(path).alias("is_secret"))


def _windows_sql(size: int, step: int) -> str:
    return f"""WITH l AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS r FROM documents),
        w AS (SELECT doc_id, r, unnest(range(0, CASE WHEN len(r) = 0 THEN 0 WHEN len(r) <= {size} THEN 1 ELSE ceil((len(r) - {size}) / {step})::BIGINT + 1 END)) AS k FROM l)
        SELECT doc_id, (k * {step} + 1)::INT AS line_start, least(k * {step} + {size}, len(r))::INT AS line_end, md5(array_to_string(r[k * {step} + 1:k * {step} + {size}], chr(10))) AS content_md5 FROM w"""


def _windows(spark: SparkSession, d: str, size: int, overlap: int) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.inline(T.line_windows(F.col("text"), size, overlap)))
    return rows.select("doc_id", "line_start", "line_end", F.md5("content").alias("content_md5"))


@query(_windows_sql(80, 70))
def line_windows_80_10(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, 80, 10)


@query(_windows_sql(20, 15))
def line_windows_20_5(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, 20, 5)


@query("SELECT doc_id, greatest(1, round_even(length(text) / 4.0, 0))::INT AS chunk_tokens, greatest(1, floor(length(text) / 4.0))::INT AS floor_tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("chunk_tokens"), T.token_floor(F.col("text")).alias("floor_tokens"))


@query("SELECT sha256(text) AS content_sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_REDACT = rf"(?i)\b({T.SECRET_NAMES})\b(\s*[:=]\s*)" + f'"[{T.SECRET_SIGNS}]{{16,}}"'


@query(f"""SELECT doc_id, md5(regexp_replace(text, '{_REDACT}', '\\1\\2<<redacted:secret>>', 'g')) AS redacted_md5 FROM documents""")
def redact_assigned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^#{1,6}\\s+.+$')) AS headings FROM documents")
def md_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.markdown_headings(F.col("text"))).cast("long").alias("headings"))


@query("SELECT event_id, 'config key: k = ' || json_extract_string(props, '$.k') AS content FROM events")
def json_config_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.select("event_id", F.concat(F.lit("config key: "), "key", F.lit(" = "), "value").alias("content"))


_Q0 = "SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1"


@query(f"SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, ({_Q0}) ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").limit(1).first()["embedding"]
    return retrieve.nearest(v, q, 10, key="vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


_LISTS = f"""d AS (SELECT doc_id, source, lang, text, n_chars FROM documents),
    c AS (SELECT source AS path, 1 + doc_id % 200 AS line_start, doc_id, 'fts' AS src, n_chars::DOUBLE AS score FROM d WHERE lang = 'en'
          UNION ALL SELECT source, 1 + doc_id % 200, doc_id, 'symbol', -doc_id::DOUBLE FROM d WHERE lang <> 'de'
          UNION ALL SELECT source, 1 + doc_id % 200, doc_id, 'path', length(text) % 1000 FROM d WHERE lang IN ('fr', 'es', 'en')),
    k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, path, line_start, doc_id) - 1 AS rank0, (line_start - 1) // 40 AS bucket, CASE src WHEN 'fts' THEN 1.0 WHEN 'symbol' THEN 0.6 ELSE 0.5 END AS w FROM c),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, path, bucket ORDER BY rank0) AS n FROM k) WHERE n = 1),
    a AS (SELECT path, count(DISTINCT src) AS agreeing_sources FROM k GROUP BY path),
    fused AS (SELECT b.path, bucket, sum(w * 60 / (60 + rank0)) AS score, any_value(agreeing_sources) AS agreeing_sources,
                arg_min(line_start, {{'o': CASE src WHEN 'symbol' THEN 0 WHEN 'fts' THEN 1 ELSE 2 END, 'r': rank0}}) AS line_start FROM b JOIN a ON a.path = b.path GROUP BY b.path, bucket)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Three ranked lists over documents; line_end carries the document's id, so that ties are total."""
    doc = table(spark, d, "documents")
    shape = lambda df, src, score: df.select(F.col("source").alias("path"), (1 + F.col("doc_id") % 200).cast("int").alias("line_start"), F.col("doc_id").cast("int").alias("line_end"), F.lit(src).alias("source"), score.cast("double").alias("score"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("token_est"), F.col("doc_id").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"), F.lit(0).cast("long").alias("ref_count"), F.lit(False).alias("is_generated"), F.lit(False).alias("exact_symbol"))
    fts = shape(doc.where("lang = 'en'"), "fts", F.col("n_chars"))
    sym = shape(doc.where("lang <> 'de'"), "symbol", -F.col("doc_id"))
    return fts.unionByName(sym).unionByName(shape(doc.where("lang IN ('fr', 'es', 'en')"), "path", F.length("text") % 1000))


_WEIGHTS = {"path": 0.5, "symbol": 0.6, "fts": 1.0}


@query(f"WITH {_LISTS} SELECT path, bucket, line_start, round(score, 6) AS score, agreeing_sources FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fuse.fuse(_lists(spark, d), _WEIGHTS, whole=True).select("path", fuse.bucket(F.col("line_start")).alias("bucket"), "line_start", F.round("score", 6).alias("score"), "agreeing_sources")


_BONUS = "fused.score + least(0.08, ln(1 + line_start) * 0.03) + CASE WHEN contains(path, 'src1') THEN 0.05 ELSE 0 END"


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    fused = fuse.fuse(_lists(spark, d).withColumn("in_degree", F.col("line_start").cast("long")), _WEIGHTS, whole=True)
    return fuse.rerank(fused, ["src1"], whole=True)


@query(f"WITH {_LISTS} SELECT path, line_start, round({_BONUS}, 6) AS score, CASE WHEN contains(path, 'src1') THEN 'in ./ · ' ELSE '' END || line_start || ' callers' AS reason FROM fused")
def rerank_bonus(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("path", "line_start", F.round("score", 6).alias("score"), "reason")


@query(f"""WITH {_LISTS}, r AS (SELECT path, line_start, {_BONUS} AS score FROM fused), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, line_start) AS p FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p) > 3 AS late FROM n)
          SELECT path, line_start, row_number() OVER (ORDER BY late, p) - 1 AS pos FROM t""")
def diversify_per_file(spark: SparkSession, d: str) -> DataFrame:
    return fuse.diversify(_reranked(spark, d), whole=True).select("path", "line_start", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {_LISTS}, r AS (SELECT {_BONUS} AS score, agreeing_sources AS a, path, line_start FROM fused), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, line_start) AS p FROM r),
          g AS (SELECT max(CASE WHEN p = 1 THEN score END) AS s1, max(CASE WHEN p = 2 THEN score END) AS s2, max(CASE WHEN p = 1 THEN a END) AS a, count(*) AS n FROM o)
          SELECT CASE WHEN n = 0 OR s1 <= 0 THEN 'low' WHEN n = 1 THEN 'medium' WHEN (a >= 3 AND (s1 - s2) / s1 > 0.15) OR (a >= 2 AND (s1 - s2) / s1 > 0.25) OR (a = 1 AND (s1 - s2) / s1 > 0.5) THEN 'high'
                      WHEN a >= 2 OR (s1 - s2) / s1 > 0.1 OR n >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return fuse.confidence(_reranked(spark, d))


@query("""WITH RECURSIVE r AS (SELECT source, text, doc_id, greatest(1, round_even(length(text) / 4.0, 0))::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
          w AS (SELECT source, doc_id, p, CASE WHEN cost <= 1500 THEN cost ELSE 0 END AS spent, cost <= 1500 AS fits FROM r WHERE p = 1
                UNION ALL SELECT r.source, r.doc_id, r.p, w.spent + CASE WHEN w.spent + r.cost <= 1500 THEN r.cost ELSE 0 END, w.spent + r.cost <= 1500 FROM w JOIN r ON r.source = w.source AND r.p = w.p + 1)
          SELECT source, doc_id, fits FROM w""")
def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("source", "doc_id", T.token_estimate(F.col("text")).cast("long").alias("cost"))
    return fuse.within_budget(own, "source", ["doc_id"], "cost", 1500).select("source", "doc_id", "fits")


@query(f"WITH {_LISTS}, r AS (SELECT path, line_start, score, row_number() OVER (ORDER BY {_BONUS} DESC, path, line_start) - 1 AS pos FROM fused) SELECT path, line_start, pos, (SELECT count(*) FROM r) > 30 AS has_more FROM r WHERE pos >= 20 AND pos < 30")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    rows, info = fuse.page(_reranked(spark, d), 10, 20)
    return rows.select("path", "line_start", F.col("pos").cast("long").alias("pos")).crossJoin(F.broadcast(info.select("has_more")))  # one row


_INTENT_SQL = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, (p, _, _) in search.INTENTS.items())


@query(f"SELECT conv_id, turn, CASE {_INTENT_SQL} ELSE 'keyword' END AS intent FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -event_id - 1, 0, CASE event_type WHEN 'error' THEN 'Traceback in handler' WHEN 'click' THEN 'where is click defined' WHEN 'view' THEN 'how does view work' ELSE 'overview of ' || event_type END FROM events)")
def intent_classification(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    asked = F.when(e == "error", "Traceback in handler").when(e == "click", "where is click defined").when(e == "view", "how does view work").otherwise(F.concat(F.lit("overview of "), e))
    own = table(spark, d, "events").select((-F.col("event_id") - 1).alias("conv_id"), F.lit(0).cast("long").alias("turn"), asked.alias("text"))
    every = table(spark, d, "conversations").select("conv_id", "turn", "text").unionByName(own)
    return every.select("conv_id", "turn", search.intent_of(F.col("text")).alias("intent"))


@query("""WITH r AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
          t AS (SELECT source AS query, l.doc_id AS item FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 0),
          h AS (SELECT t.query, rank FROM t LEFT JOIN r ON r.query = t.query AND r.item = t.item)
          SELECT query, max((rank <= 10)::INT)::DOUBLE AS recall, round(1 / min(rank), 6) AS rr,
                 round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM h GROUP BY query""")
def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    ranked = doc.select(F.col("source").alias("query"), F.col("doc_id").alias("item"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    truth = table(spark, d, "labels").where("quality = 0").join(doc.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("item"))
    return metrics.per_query(ranked, truth, 10).select("query", "recall", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"))


@query("""WITH c AS (SELECT least(length(text), 320) / 4.0 AS i, length(text) / 4.0 AS b FROM documents)
          SELECT round(avg(i), 6) AS indexed_avg, round(avg(b), 6) AS baseline_avg, round(avg(b) - avg(i), 6) AS saved_avg, round(avg(b) / greatest(avg(i), 1), 6) AS ratio FROM c""")
def token_economy(spark: SparkSession, d: str) -> DataFrame:
    costs = table(spark, d, "documents").select((F.least(F.length("text"), F.lit(320)) / 4).alias("indexed"), (F.length("text") / 4).alias("baseline"))
    one = metrics.token_economy(costs)
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


@query("""WITH r AS (SELECT l_suppkey AS k, (l_orderkey % 5000)::BIGINT AS b, (l_orderkey % 5000 + l_linenumber)::BIGINT AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM r),
          i AS (SELECT *, sum(CASE WHEN b <= u + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT k AS l_suppkey, min(b) AS begin_, max(e) AS end_ FROM i GROUP BY k, g""")
def range_merge(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_orderkey") % 5000
    r = table(spark, d, "lineitem").select("l_suppkey", at.alias("begin"), (at + F.col("l_linenumber")).alias("end"))
    return metrics.merge_ranges(r, "l_suppkey").select("l_suppkey", F.col("begin").alias("begin_"), F.col("end").alias("end_"))


@query("""WITH r AS (SELECT c_nationkey AS k, c_custkey AS id, c_custkey AS b, c_custkey + 20 + c_custkey % 50 AS e FROM customer), p AS (SELECT s_nationkey AS k, s_suppkey AS pid, s_suppkey * 3 AS a FROM supplier)
          SELECT p.pid AS s_suppkey, arg_min(id, {'w': e - b, 'b': b, 'i': id}) AS c_custkey FROM p JOIN r ON p.k = r.k AND a BETWEEN b AND e GROUP BY p.k, p.pid""")
def enclosing_range(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    r = c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("range_id"), F.col("c_custkey").alias("begin"), (F.col("c_custkey") + 20 + F.col("c_custkey") % 50).alias("end"))
    p = s.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") * 3).alias("at"))
    return metrics.innermost(r, p, "k").select(F.col("point_id").alias("s_suppkey"), F.col("range_id").alias("c_custkey"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
          SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS end_us, count(*) AS events FROM s GROUP BY user_id, k""")
def edit_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = watch.bursts(table(spark, d, "events"), "user_id", "10 minutes")
    return out.select("user_id", F.unix_micros("burst_start").alias("start_us"), F.unix_micros("burst_end").alias("end_us"), "events")


@query(with_views(" SELECT symbol_id, name, kind, path, line_start FROM symbols WHERE name = 'red ring' AND kind = 'type'", "symbols"))
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.symbols_by_name(symbols(spark, d), "red ring", kind="type").select("symbol_id", "name", "kind", "path", "line_start")


@query()
def snippet_skeletons(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return c.select("chunk_id", snippets.compact(F.col("content"), F.col("path"), F.col("line_start"), 2, "where is thble").alias("c")).select("chunk_id", F.md5("c.text").alias("text_md5"), "c.token_est", "c.elided_lines", "c.skeletonized")


@query()
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    f = chunks(spark, d).select("file_id", "path", F.lit("markdown").alias("lang"), "content")
    return parse.tables(parse.parse(f))["chunks"].groupBy("kind").agg(F.count("*").alias("n"), F.sum("token_est").alias("tokens"))


@query("SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents")
def fold_accents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("folded_md5"))


@query("""WITH s AS (SELECT p_partkey, replace(lower(p_name), ' ', '_') AS n, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda p: len(p) >= 2)) AS parts, p_size AS in_degree FROM part),
               c AS (SELECT *, contains(n, 'red')::INT + contains(n, 'ring')::INT AS covered, n IN ('redring', 'red_ring') AS is_exact, len(list_intersect(parts, ['red', 'ring'])) / len(parts) AS tightness FROM s WHERE contains(n, 'red') OR contains(n, 'ring'))
          SELECT p_partkey, covered, is_exact, round(tightness, 6) AS tightness FROM c ORDER BY covered DESC, is_exact DESC, c.tightness DESC, in_degree DESC, len(n), p_partkey LIMIT 40""")
def symbol_candidates_rank(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("p_size").alias("in_degree"), F.lit("").alias("path"), F.col("p_partkey").alias("line_start"))
    return retrieve.symbol_candidates(s, TERMS2, 40).select("p_partkey", "covered", "is_exact", F.round("tightness", 6).alias("tightness"))


@query("""WITH c AS (SELECT p_partkey, p_size AS s, CASE WHEN p_size % 4 = 0 THEN 'tests/' ELSE 'src/' END || lower(p_brand) || '.py' AS path, lower(p_name) AS symbol FROM part),
               b AS (SELECT *, CASE WHEN s % 3 < 2 THEN 0.05 ELSE 0 END + CASE WHEN s % 5 = 0 THEN 0.2 ELSE 0 END + CASE WHEN symbol IN ('src', 'brand#11') THEN 0.05 ELSE 0 END + CASE WHEN contains(path, 'src') OR contains(path, 'brand#11') THEN 0.05 ELSE 0 END
                                + CASE WHEN s % 7 > 0 THEN least(0.08, ln(1 + s % 7) * 0.03) WHEN s % 6 > 0 THEN least(0.04, ln(1 + s % 6) * 0.015) ELSE 0 END
                                - CASE WHEN s % 11 = 0 OR starts_with(path, 'tests/') THEN 0.15 ELSE 0 END + CASE WHEN s % 7 + s % 9 > 0 THEN least(0.08, ln(1 + s % 7 + s % 9) * 0.015) ELSE 0 END AS bonus FROM c)
          SELECT p_partkey, round(bonus, 6) AS bonus, coalesce(nullif(concat_ws(' · ', CASE WHEN s % 5 = 0 THEN 'exact symbol match' END, CASE WHEN contains(path, 'src') OR contains(path, 'brand#11') THEN 'in ' || string_split(path, '/')[1] || '/' END,
                     CASE WHEN s % 7 > 0 THEN (s % 7) || ' callers' WHEN s % 6 > 0 THEN '~' || (s % 6) || ' refs by name' END, CASE WHEN s % 11 = 0 OR starts_with(path, 'tests/') THEN 'generated/test demoted' END), ''), 'symbol') AS reason FROM b""")
def rerank_every_bonus(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    path = F.concat(F.when(s % 4 == 0, "tests/").otherwise("src/"), F.lower("p_brand"), F.lit(".py"))
    kind = F.when(s % 3 == 0, "class").when(s % 3 == 1, "function").otherwise("variable")
    own = table(spark, d, "part").select("p_partkey", path.alias("path"), F.lit("symbol").alias("source"), kind.alias("kind"), (s % 5 == 0).alias("exact_symbol"), F.lower("p_name").alias("symbol"), (s % 7).alias("in_degree"), (s % 9).alias("out_degree"), (s % 6).alias("ref_count"), (s % 11 == 0).alias("is_generated"))
    total, why = fuse.bonus(["src", "brand#11"], architecture=True)
    return own.select("p_partkey", F.round(total, 6).alias("bonus"), why.alias("reason"))
