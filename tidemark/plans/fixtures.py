"""Stand-in inputs: train and test splits of the driver's tables, with derived columns, as Spark frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Orders before 2000 are train, the rest test. Columns: see ORDERS_SQL.
ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate,
  strftime(o_orderdate, '%y-%b') AS month, strftime(o_orderdate, '%Y-%b') AS month4,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS target,
  CASE WHEN o_orderkey % 2 = 0 THEN upper(replace(o_orderpriority, '-', '_')) ELSE '  ' || o_orderpriority || ' ' END AS variant,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey % 3 = 0 THEN '9-NEW' ELSE o_orderpriority END AS moved,
  CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN o_totalprice * 1.3 + 10000 ELSE o_totalprice END AS shifted,
  CASE WHEN o_orderkey % (CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 5 ELSE 9 END) = 0 THEN o_totalprice ELSE 0 END AS sparse_price
FROM orders
"""
TRAIN = f"(SELECT * FROM ({ORDERS_SQL}) WHERE o_orderdate < TIMESTAMP '2000-01-01')"
TEST = f"(SELECT * FROM ({ORDERS_SQL}) WHERE o_orderdate >= TIMESTAMP '2000-01-01')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    key, late = F.col("o_orderkey"), F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate",
        F.date_format("o_orderdate", "yy-MMM").alias("month"), F.date_format("o_orderdate", "yyyy-MMM").alias("month4"),
        F.when(key % 97 == 0, None).when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("target"),
        F.when(key % 2 == 0, F.upper(F.replace(priority, F.lit("-"), F.lit("_")))).otherwise(F.concat(F.lit("  "), priority, F.lit(" "))).alias("variant"),
        F.when(key % 11 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(late & (key % 3 == 0), "9-NEW").otherwise(priority).alias("moved"),
        F.when(late, price * 1.3 + 10000).otherwise(price).alias("shifted"),
        F.when(key % F.when(late, 5).otherwise(9) == 0, price).otherwise(0.0).alias("sparse_price"),
    )


def splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = orders(spark, sf_dir)
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return df.where(~late), df.where(late)


# Line items with their parts: a column with more than a hundred levels, and ones that trap null and zero rates.
ITEMS_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate, p_brand || '/' || p_type AS brand_type,
  CASE WHEN l_linenumber <= 3 THEN NULL WHEN l_linenumber <= 6 THEN 0 ELSE l_extendedprice END AS trap,
  CASE WHEN l_quantity > 45 THEN l_returnflag END AS rare_flag,
  CASE WHEN l_quantity > 40 THEN l_extendedprice ELSE 0 END AS rare_price
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
ITEMS_TRAIN = f"(SELECT * FROM ({ITEMS_SQL}) WHERE l_shipdate < TIMESTAMP '2000-01-01')"
ITEMS_TEST = f"(SELECT * FROM ({ITEMS_SQL}) WHERE l_shipdate >= TIMESTAMP '2000-01-01')"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price, qty, line = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber")
    return df.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
        F.concat_ws("/", "p_brand", "p_type").alias("brand_type"),
        F.when(line <= 3, None).when(line <= 6, 0.0).otherwise(price).alias("trap"),
        F.when(qty > 45, F.col("l_returnflag")).alias("rare_flag"), F.when(qty > 40, price).otherwise(0.0).alias("rare_price"),
    )


def item_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = items(spark, sf_dir)
    late = F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    return df.where(~late), df.where(late)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as the SQL does; minus zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
