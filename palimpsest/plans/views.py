"""The engine's tables over the star schema's: the same rows as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, doc_id, file_path, name, signature, doc_comment, label, kind, text of documents."""
    d = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 7 == 0, "tests/test_").when(F.col("doc_id") % 7 == 1, "docs/readme_").when(F.col("doc_id") % 7 == 2, "fixtures/").otherwise("src/mod_")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".md", ".ts", ".go", ".java")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("node_id"),
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), folder, F.col("doc_id").cast("string"), ext).alias("file_path"),
        F.concat(F.lit("mod_"), F.col("doc_id").cast("string")).alias("name"),
        F.substring("text", 1, 40).alias("signature"),
        F.substring("text", 41, 80).alias("doc_comment"),
        F.element_at(F.array(*[F.lit(x) for x in ("class", "function", "method", "module")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"),
        "text",
        "source",
        "lang",
    )


NODES = """n AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS node_id, doc_id,
  source || '/' || lang || '/' || CASE doc_id % 7 WHEN 0 THEN 'tests/test_' WHEN 1 THEN 'docs/readme_' WHEN 2 THEN 'fixtures/' ELSE 'src/mod_' END || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.ts' WHEN 3 THEN '.go' ELSE '.java' END AS file_path,
  'mod_' || doc_id AS name, substr(text, 1, 40) AS signature, substr(text, 41, 80) AS doc_comment,
  CASE doc_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'module' END AS kind, text, source, lang FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, dst_id, edge_type, confidence: customer contains order, order calls part, supplier imports part."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = o.select(key("c", "o_custkey").alias("src_id"), key("o", "o_orderkey").alias("dst_id"), F.lit("contain").alias("edge_type"), F.lit(2).alias("confidence"))
    b = li.select(key("o", "l_orderkey").alias("src_id"), key("p", "l_partkey").alias("dst_id"), F.lit("call").alias("edge_type"), (F.col("l_linenumber") % 3).cast("int").alias("confidence"))
    c = li.select(key("s", "l_suppkey").alias("src_id"), key("p", "l_partkey").alias("dst_id"), F.lit("import").alias("edge_type"), (F.col("l_linenumber") % 2).cast("int").alias("confidence"))
    return a.unionByName(b).unionByName(c)


EDGES = """e AS (
  SELECT 'c' || o_custkey AS src_id, 'o' || o_orderkey AS dst_id, 'contain' AS edge_type, 2 AS confidence FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'call', l_linenumber % 3 FROM lineitem
  UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'import', l_linenumber % 2 FROM lineitem)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with byte spans: documents of one source are laid end to end by id; a class spans each ten of them, a module the source."""
    from pyspark.sql import Window as W

    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))
    order = W.partitionBy("source").orderBy("doc_id")
    d = d.withColumn("e", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("s", F.col("e") - F.col("n")).withColumn("rn", F.row_number().over(order) - 1)
    leaf = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), F.lit("function").alias("kind"), F.col("source").alias("file_path"), F.col("s").alias("start_byte"), F.col("e").alias("end_byte"), (F.col("doc_id") + 1_000_000_000).alias("pos"))
    ten = d.groupBy("source", F.floor(F.col("rn") / 10).alias("g")).agg(F.min("s").alias("start_byte"), F.max("e").alias("end_byte")).select(F.concat_ws("/", F.lit("k"), "source", F.col("g").cast("string")).alias("node_id"), F.lit("class").alias("kind"), F.col("source").alias("file_path"), "start_byte", "end_byte", (F.col("g") + 1000).alias("pos"))
    whole = d.groupBy("source").agg(F.min("s").alias("start_byte"), F.max("e").alias("end_byte")).select(F.concat_ws("/", F.lit("m"), "source").alias("node_id"), F.lit("module").alias("kind"), F.col("source").alias("file_path"), "start_byte", "end_byte", F.lit(0).cast("long").alias("pos"))
    return leaf.unionByName(ten).unionByName(whole)


SPANS = """d AS (SELECT doc_id, source, strlen(text)::BIGINT AS n, (sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS e, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn FROM documents),
sp AS (
  SELECT 'd' || doc_id AS node_id, 'function' AS kind, source AS file_path, e - n AS start_byte, e AS end_byte, doc_id + 1000000000 AS pos FROM d
  UNION ALL SELECT 'k/' || source || '/' || (rn // 10), 'class', source, min(e - n), max(e), rn // 10 + 1000 FROM d GROUP BY source, rn // 10
  UNION ALL SELECT 'm/' || source, 'module', source, min(e - n), max(e), 0 FROM d GROUP BY source)"""
