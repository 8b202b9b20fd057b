"""The driver's tables seen as an index: nations are files, customers, suppliers and parts symbols, foreign keys edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.functions import text as T

SUPPLIER, PART = 1_000_000_000, 2_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Nations as files region/nation.py."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    path = F.concat(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("/"), F.lower("n_name"), F.lit(".py"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("file_id"), path.alias("path"), F.lit("python").alias("lang"))


FILES_SQL = "SELECT n_nationkey::BIGINT AS file_id, lower(replace(r_name, ' ', '_')) || '/' || lower(n_name) || '.py' AS path, 'python' AS lang FROM nation JOIN region ON n_regionkey = r_regionkey"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Customers (functions), suppliers (classes) and parts (types, many of one name) as symbols."""
    f = files(spark, d).select("file_id", "path")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_nationkey").cast("long").alias("file_id"), F.col("c_name").alias("name"), F.lit("function").alias("kind"), F.col("c_custkey").cast("int").alias("line_start"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("symbol_id"), F.col("s_nationkey").cast("long").alias("file_id"), F.col("s_name").alias("name"), F.lit("class").alias("kind"), F.col("s_suppkey").cast("int").alias("line_start"))
    p = table(spark, d, "part").select((F.col("p_partkey") + PART).alias("symbol_id"), F.pmod("p_size", F.lit(25)).cast("long").alias("file_id"), F.col("p_name").alias("name"), F.lit("type").alias("kind"), F.col("p_partkey").cast("int").alias("line_start"))
    every = c.unionByName(s).unionByName(p)
    return every.join(f, "file_id").select("symbol_id", "file_id", "path", "name", "kind", "line_start", (F.col("line_start") + 9).alias("line_end"), F.concat_ws(" ", "kind", "name").alias("signature"))


SYMBOLS_SQL = f"""
    SELECT symbol_id, s.file_id, path, name, kind, line_start, line_start + 9 AS line_end
    FROM (SELECT c_custkey AS symbol_id, c_nationkey::BIGINT AS file_id, c_name AS name, 'function' AS kind, c_custkey::INT AS line_start FROM customer
          UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey, s_name, 'class', s_suppkey::INT FROM supplier
          UNION ALL SELECT p_partkey + {PART}, p_size % 25, p_name, 'type', p_partkey::INT FROM part) s JOIN files f ON f.file_id = s.file_id"""


def edges_raw(spark: SparkSession, d: str) -> DataFrame:
    """A customer calls the suppliers of its orders, a supplier refers to the names of its parts; nations import their neighbours."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    # The sides of unique keys become hash tables, so that the lines are never sorted.
    bought = o.join(c.hint("shuffle_hash"), o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey", "c_nationkey")
    calls = line.join(bought.hint("shuffle_hash"), line.l_orderkey == F.col("o_orderkey")).join(s.hint("shuffle_hash"), line.l_suppkey == s.s_suppkey)
    calls = calls.select(F.lit("call").alias("edge_type"), F.lit("symbol").alias("src_kind"), F.col("c_custkey").alias("src_id"), F.col("s_name").alias("dst_name"), F.col("c_nationkey").cast("long").alias("file_id"), F.col("l_linenumber").cast("int").alias("line"))
    refs = line.join(s.hint("shuffle_hash"), line.l_suppkey == s.s_suppkey).join(p.hint("shuffle_hash"), line.l_partkey == p.p_partkey)
    refs = refs.select(F.lit("reference").alias("edge_type"), F.lit("symbol").alias("src_kind"), (F.col("s_suppkey") + SUPPLIER).alias("src_id"), F.col("p_name").alias("dst_name"), F.col("s_nationkey").cast("long").alias("file_id"), F.col("l_linenumber").cast("int").alias("line"))
    f = files(spark, d)
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    imports = f.alias("a").join(f.select((F.col("file_id") - 1).alias("file_id"), module.alias("dst_name")), "file_id")
    imports = imports.select(F.lit("import").alias("edge_type"), F.lit("file").alias("src_kind"), F.col("file_id").alias("src_id"), "dst_name", "file_id", F.lit(1).alias("line"))
    return calls.unionByName(refs).unionByName(imports)


EDGES_RAW_SQL = f"""
    SELECT 'call' AS edge_type, 'symbol' AS src_kind, c_custkey AS src_id, s_name AS dst_name, c_nationkey::BIGINT AS file_id, l_linenumber::INT AS line
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    UNION ALL SELECT 'reference', 'symbol', s_suppkey + {SUPPLIER}, p_name, s_nationkey, l_linenumber::INT FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT 'import', 'file', a.file_id, replace(replace(b.path, '.py', ''), '/', '.'), a.file_id, 1 FROM files a JOIN files b ON b.file_id = a.file_id + 1"""

#: Resolution in SQL: the name in the edge's own file (last definition), else a name only one symbol has, else an import's file.
EDGES_SQL = """
    SELECT edge_type, src_kind, src_id,
           CASE WHEN sym IS NOT NULL THEN 'symbol' WHEN module_id IS NOT NULL THEN 'file' END AS dst_kind,
           coalesce(sym, module_id) AS dst_id, dst_name, file_id, line, sym IS NOT NULL OR module_id IS NOT NULL AS resolved,
           CASE WHEN sym IS NOT NULL THEN 'extracted' WHEN module_id IS NOT NULL THEN 'inferred' ELSE 'ambiguous' END AS confidence
    FROM (SELECT e.*, coalesce(own.symbol_id, CASE WHEN e.edge_type <> 'import' THEN u.symbol_id END) AS sym,
                 CASE WHEN e.edge_type = 'import' THEN m.file_id END AS module_id
          FROM edges_raw e
          LEFT JOIN (SELECT file_id, name, arg_max(symbol_id, {'l': line_start, 'i': symbol_id}) AS symbol_id FROM symbols GROUP BY file_id, name) own ON own.file_id = e.file_id AND own.name = e.dst_name
          LEFT JOIN (SELECT name, min(symbol_id) AS symbol_id FROM symbols GROUP BY name HAVING count(*) = 1) u ON u.name = e.dst_name
          LEFT JOIN files m ON m.path = replace(e.dst_name, '.', '/') || '.py')"""


def with_views(sql: str, *names: str) -> str:
    """sql (", more AS (...) SELECT ..." or " SELECT ...") with the views it uses in front of it."""
    every = {"files": FILES_SQL, "symbols": SYMBOLS_SQL, "edges_raw": EDGES_RAW_SQL, "edges": EDGES_SQL}
    need = {"files": ["files"], "symbols": ["files", "symbols"], "edges_raw": ["files", "edges_raw"], "edges": ["files", "symbols", "edges_raw", "edges"]}
    chosen = [n for n in every if any(n in need[x] for x in names)]
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({every[n]})' for n in chosen)}{sql}"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of files named by source and id."""
    doc = table(spark, d, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return doc.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), path.alias("path"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"), F.lit("window").alias("kind"), F.col("text").alias("content"), T.token_estimate(F.col("text")).alias("token_est"), F.lit("").alias("symbol_names"))


def url_path(df: DataFrame) -> DataFrame:
    """Pages as files: host and path of the URL, without the query."""
    return df.select("page_id", F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"\?.*$", "").alias("path"))


URL_PATH_SQL = "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '') AS path FROM pages"
