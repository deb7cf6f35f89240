"""Relations of the operators bound to the driver's tables, as DataFrames and as SQL views for the oracle.

These are bindings for checking the operators on shared data; archives give the same relations (``tessella.sources``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parts = [
        table(spark, sf_dir, "region").select(F.lit("geo").alias("archive_path"), _id("R/", "r_regionkey").alias("internal_name"), none.alias("super_name")),
        table(spark, sf_dir, "nation").select(F.lit("geo"), _id("N/", "n_nationkey"), _id("R/", "n_regionkey")),
        table(spark, sf_dir, "customer").select(F.lit("cust"), _id("C/", "c_custkey"), _id("N/", "c_nationkey")),
        table(spark, sf_dir, "supplier").select(F.lit("supp"), _id("S/", "s_suppkey"), _id("N/", "s_nationkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit("cust").alias("archive_path"), _id("C/", "c_custkey").alias("owner"), _id("M/", "c_mktsegment").alias("interface_name"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.lit("cust").alias("archive_path"), _id("C/", "o_custkey").alias("owner"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("descriptor"))
    return own.distinct()


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field for each part that a supplier has delivered: its brand as name, its size class as type."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
    own = line.join(part, "p_partkey").select(F.lit("supp").alias("archive_path"), _id("S/", "l_suppkey").alias("owner"), F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "I").otherwise("J").alias("descriptor"))
    return own.distinct()


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as strings in the methods of their customers."""
    return table(spark, sf_dir, "orders").select(F.lit("cust").alias("archive_path"), _id("C/", "o_custkey").alias("owner"), F.col("o_orderpriority").alias("method_name"), F.col("o_orderstatus").alias("descriptor"), _id("o", "o_orderkey").alias("text"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on a line and the next one of an order, as often as they stand so."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    return line.join(following, ["l_orderkey", "l_linenumber"]).where("l_partkey <> next").select("l_partkey", "next")


def _part_calls(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.lit("parts").alias("archive_path"), _id("P/", "l_partkey").alias("source_owner"), F.lit("run").alias("source_name"), F.lit("()V").alias("source_desc"), _id("P/", "next").alias("target_owner"), F.lit("run").alias("target_name"), F.lit("()V").alias("target_desc"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand on neighbouring lines of an order."""
    return _part_calls(_neighbours(spark, sf_dir).distinct())


def mutual_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in either direction, so that a search meets its root again: pairs are told apart whatever their direction, and turned after that; the lines are joined once."""
    pairs = _neighbours(spark, sf_dir).select(F.least("l_partkey", "next").alias("a"), F.greatest("l_partkey", "next").alias("b")).distinct()
    ends = F.array(F.struct(F.col("a").alias("l_partkey"), F.col("b").alias("next")), F.struct(F.col("b").alias("l_partkey"), F.col("a").alias("next")))
    return _part_calls(pairs.select(F.inline(ends)))


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each part, every fifth of them below its brand, and every eleventh once more in another archive."""
    parent = F.when(F.col("p_partkey") % 5 == 0, _id("B/", "p_brand"))
    p = table(spark, sf_dir, "part")
    own = p.select(F.lit("parts").alias("archive_path"), _id("P/", "p_partkey").alias("internal_name"), parent.alias("super_name"))
    return own.union(p.where("p_partkey % 11 = 0").select(F.lit("spare"), _id("P/", "p_partkey"), F.lit(None).cast("string")))


def part_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run`` of every part, a second one of every seventh, and the first again in another archive for every eleventh."""
    p = table(spark, sf_dir, "part")
    row = lambda df, archive, desc: df.select(F.lit(archive).alias("archive_path"), _id("P/", "p_partkey").alias("owner"), F.lit("run").alias("name"), F.lit(desc).alias("descriptor"))
    return row(p, "parts", "()V").union(row(p.where("p_partkey % 7 = 0"), "parts", "(I)V")).union(row(p.where("p_partkey % 11 = 0"), "spare", "()V"))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as methods and turns as instructions: every third turn jumps back two, every fifth is a switch on (the first target its default), every seventh ends."""
    t = F.col("turn")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("method"), t.alias("idx"), F.col("role").alias("op"), last.alias("last"))
    i = F.col("idx")
    kind = F.when((i % 3 == 2) & (i >= 2), "jump").when((i % 5 == 3) & (i + 2 <= F.col("last")), "switch").when(i % 7 == 6, "return").otherwise("plain")
    targets = F.when(F.col("kind") == "jump", F.array(i - 2)).when(F.col("kind") == "switch", F.array(i + 1, i + 2)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("kind", kind).withColumn("targets", targets).drop("last")


SQL = """
classes AS (
  SELECT 'geo' AS archive_path, 'R/' || r_regionkey AS internal_name, CAST(NULL AS VARCHAR) AS super_name FROM region
  UNION ALL SELECT 'geo', 'N/' || n_nationkey, 'R/' || n_regionkey FROM nation
  UNION ALL SELECT 'cust', 'C/' || c_custkey, 'N/' || c_nationkey FROM customer
  UNION ALL SELECT 'supp', 'S/' || s_suppkey, 'N/' || s_nationkey FROM supplier),
interfaces AS (SELECT 'cust' AS archive_path, 'C/' || c_custkey AS owner, 'M/' || c_mktsegment AS interface_name FROM customer),
methods AS (SELECT DISTINCT 'cust' AS archive_path, 'C/' || o_custkey AS owner, o_orderpriority AS name, o_orderstatus AS descriptor FROM orders),
fields AS (SELECT DISTINCT 'supp' AS archive_path, 'S/' || l_suppkey AS owner, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN 'I' ELSE 'J' END AS descriptor FROM lineitem JOIN part ON p_partkey = l_partkey),
strings AS (SELECT 'cust' AS archive_path, 'C/' || o_custkey AS owner, o_orderpriority AS method_name, o_orderstatus AS descriptor, 'o' || o_orderkey AS text FROM orders),
calls AS (
  SELECT DISTINCT 'parts' AS archive_path, 'P/' || a.l_partkey AS source_owner, 'run' AS source_name, '()V' AS source_desc,
         'P/' || b.l_partkey AS target_owner, 'run' AS target_name, '()V' AS target_desc
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey),
mutual AS (SELECT archive_path, source_owner, target_owner FROM calls UNION SELECT archive_path, target_owner, source_owner FROM calls),
part_classes AS (SELECT 'parts' AS archive_path, 'P/' || p_partkey AS internal_name, CASE WHEN p_partkey % 5 = 0 THEN 'B/' || p_brand END AS super_name FROM part
  UNION ALL SELECT 'spare', 'P/' || p_partkey, NULL FROM part WHERE p_partkey % 11 = 0),
part_methods AS (SELECT 'parts' AS archive_path, 'P/' || p_partkey AS owner, 'run' AS name, '()V' AS descriptor FROM part
  UNION ALL SELECT 'parts', 'P/' || p_partkey, 'run', '(I)V' FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'spare', 'P/' || p_partkey, 'run', '()V' FROM part WHERE p_partkey % 11 = 0),
instructions AS (
  SELECT conv_id AS method, turn AS idx, role AS op,
         CASE WHEN turn % 3 = 2 AND turn >= 2 THEN 'jump' WHEN turn % 5 = 3 AND turn + 2 <= max(turn) OVER (PARTITION BY conv_id) THEN 'switch'
              WHEN turn % 7 = 6 THEN 'return' ELSE 'plain' END AS kind
  FROM conversations),
targets AS (
  SELECT method, idx, idx - 2 AS target, 'jump' AS kind, 0 AS ord FROM instructions WHERE kind = 'jump'
  UNION ALL SELECT method, idx, idx + 1, 'default', 0 FROM instructions WHERE kind = 'switch'
  UNION ALL SELECT method, idx, idx + 2, 'case', 1 FROM instructions WHERE kind = 'switch'),
marked AS (
  SELECT i.*, CASE WHEN lag(kind) OVER (PARTITION BY method ORDER BY idx) IS NULL
                     OR lag(kind) OVER (PARTITION BY method ORDER BY idx) IN ('jump', 'goto', 'switch')
                     OR EXISTS (SELECT 1 FROM targets t WHERE t.method = i.method AND t.target = i.idx) THEN 1 ELSE 0 END AS leader
  FROM instructions i),
blocked AS (SELECT method, idx, op, kind, CAST(sum(leader) OVER (PARTITION BY method ORDER BY idx) - 1 AS BIGINT) AS block FROM marked),
tails AS (SELECT b.* FROM blocked b WHERE idx = (SELECT max(idx) FROM blocked c WHERE c.method = b.method AND c.block = b.block)),
flow AS (
  SELECT method, from_block, to_block, arg_min(kind, ord) AS kind, min(ord) AS ord FROM (
    SELECT t.method, t.block AS from_block, b.block AS to_block, g.kind, g.ord
    FROM tails t JOIN targets g ON g.method = t.method AND g.idx = t.idx JOIN blocked b ON b.method = g.method AND b.idx = g.target
    UNION ALL
    SELECT t.method, t.block, t.block + 1, 'fallthrough', 1 FROM tails t
    WHERE t.kind IN ('plain', 'jump') AND t.block < (SELECT max(block) FROM blocked c WHERE c.method = t.method))
  GROUP BY ALL)
"""


def with_relations(body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{SQL}{body}"
