"""Change logs made from plain tables, so that every operator can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_RELID, CONVERSATIONS_RELID = 16384, 16385


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def orders_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the target holds before the log."""
    return orders(spark, sf_dir).where("k % 10 < 8")


_LOG = """
inline(filter(array(
  if(k % 10 >= 8, named_struct('n', 0L, 'op', 'I', 'before', null, 'after', struct(k, status, price, priority)), null),
  if(k % 5 = 0, named_struct('n', 1L, 'op', 'U', 'before', struct(k, status, price, priority), 'after', named_struct('k', k, 'status', status, 'price', price + 1, 'priority', priority)), null),
  if(k % 15 = 0, named_struct('n', 2L, 'op', 'U', 'before', named_struct('k', k, 'status', status, 'price', price + 1, 'priority', priority),
     'after', named_struct('k', k, 'status', 'X', 'price', price + 1, 'priority', priority)), null),
  if(k % 7 = 0, named_struct('n', 3L, 'op', 'D', 'before', named_struct('k', k, 'status', if(k % 15 = 0, 'X', status), 'price', if(k % 5 = 0, price + 1, price), 'priority', priority), 'after', null), null)
), x -> x is not null))
"""


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts (k % 10 >= 8), price updates (k % 5 = 0), status updates (k % 15 = 0) and deletes (k % 7 = 0), 20 keys to a transaction."""
    rows = orders(spark, sf_dir).selectExpr("k AS key", _LOG)
    return rows.select(
        (4 * F.col("key") + F.col("n")).alias("lsn"),
        (80 * F.floor(F.col("key") / 20) + 80).cast("long").alias("commit_lsn"),
        F.floor(F.col("key") / 20).cast("long").alias("xid"),
        F.lit(ORDERS_RELID).cast("long").alias("relid"),
        F.lit("public").alias("schema"),
        F.lit("orders").alias("table"),
        "op",
        "before",
        "after",
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules on conv_id + turn, with a key of two columns."""
    c = conversations(spark, sf_dir).withColumn("m", F.col("conv_id") + F.col("turn"))
    old, new = F.struct("conv_id", "turn", "role", "size"), F.struct("conv_id", "turn", "role", (F.col("size") + 1).alias("size"))
    last = F.struct("conv_id", "turn", "role", (F.col("size") + F.when(F.col("m") % 5 == 0, 1).otherwise(0)).alias("size"))
    none = F.lit(None).cast(_type(c, ["conv_id", "turn", "role", "size"]))

    def row(when, n, op, before, after):
        return F.when(when, F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), before.alias("before"), after.alias("after")))

    m = F.col("m")
    rows = c.select("conv_id", "turn", F.inline(F.array_compact(F.array(row(m % 10 >= 8, 0, "I", none, old), row(m % 5 == 0, 1, "U", old, new), row(m % 7 == 0, 2, "D", last, none)))))
    return rows.select((F.col("conv_id") * 4000 + F.col("turn") * 4 + F.col("n")).alias("lsn"), F.lit("public").alias("schema"), F.lit("conversations").alias("table"), "op", "before", "after")


def _type(df: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


#: The same log for DuckDB.
ORACLE_LOG = """
o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders),
base AS (SELECT * FROM o WHERE k % 10 < 8),
l AS (
  SELECT 4*k AS lsn, 'I' AS op, k, CAST(NULL AS VARCHAR) AS b_status, CAST(NULL AS DOUBLE) AS b_price, status AS a_status, price AS a_price, priority FROM o WHERE k % 10 >= 8
  UNION ALL SELECT 4*k+1, 'U', k, status, price, status, price + 1, priority FROM o WHERE k % 5 = 0
  UNION ALL SELECT 4*k+2, 'U', k, status, price + 1, 'X', price + 1, priority FROM o WHERE k % 15 = 0
  UNION ALL SELECT 4*k+3, 'D', k, CASE WHEN k % 15 = 0 THEN 'X' ELSE status END, CASE WHEN k % 5 = 0 THEN price + 1 ELSE price END, NULL, NULL, priority FROM o WHERE k % 7 = 0),
log AS (SELECT *, CAST(floor(k / 20) AS BIGINT) AS xid, CAST(80 * floor(k / 20) + 80 AS BIGINT) AS commit_lsn FROM l)
"""
