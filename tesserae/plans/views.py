"""Products, warehouse rows and complaints made of the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = r"(?U)\bP\d{6}\b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(n: Column) -> Column:
    return F.concat(F.lit("P"), F.lpad(n.cast("string"), 6, "0"))


def products(spark: SparkSession, sf_dir: str, *more: Column | str) -> DataFrame:
    """Products, with ``more`` columns of their table. Codes have six digits, so from a million parts on some share one."""
    p = table(spark, sf_dir, "part")
    status = F.when(F.col("p_size") % 10 == 0, "discontinued").when(F.col("p_size") % 10 == 1, "out of stock").otherwise("active")
    return p.select(code(F.col("p_partkey")).alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("product_model"), F.col("p_type").alias("category"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.col("p_size").alias("stock_qty"), status.alias("status"), *more)


def warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    joined = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = joined.groupBy("l_partkey", "s_name").agg(F.sum("l_quantity").cast("bigint").alias("quantity"), F.max("l_shipdate").alias("last_modified"))
    return sums.select(
        code(F.col("l_partkey")).alias("product_id"), F.col("s_name").alias("warehouse_location"), "quantity", F.col("last_modified").cast("date").alias("last_inventory_date"), "last_modified",
        F.concat(F.lit("pairs with "), code((F.col("l_partkey") * 7 + 1) % 2100), F.lit(" stock")).alias("special_notes"), (F.col("l_partkey") % 50).cast("int").alias("min_stock_level"))


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_partkey") == key % 200)
    text = F.concat(F.lit("order issue with "), code(key * 13 % 2100), F.lit(" and ("), code((key * 29 + 5) % 2100), F.lit(") ref XP000001 P0000012"), F.when(key % 4 == 0, F.concat(F.lit(", also the "), F.col("p_name"))).otherwise(""))
    return rows.select(
        F.concat(F.lit("CC"), key.cast("string")).alias("complaint_id"), F.col("o_orderdate").cast("date").alias("complaint_date"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("complaint_type"),
        F.col("o_orderpriority").alias("severity"), text.alias("description"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("last_modified"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as changes of tables."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("table"), F.col("ts").alias("last_modified"), "user_id", "value")


FX_PRODUCTS = """fx_products AS (
SELECT concat('P', lpad(CAST(p_partkey AS STRING), 6, '0')) AS product_id, p_name AS product_name,
       p_brand AS product_model, p_type AS category, CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_size AS stock_qty,
       CASE WHEN p_size % 10 = 0 THEN 'discontinued' WHEN p_size % 10 = 1 THEN 'out of stock' ELSE 'active' END AS status FROM part)"""
FX_WAREHOUSE = """fx_warehouse AS (
SELECT concat('P', lpad(CAST(l_partkey AS STRING), 6, '0')) AS product_id, s_name AS warehouse_location,
       CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(max(l_shipdate) AS DATE) AS last_inventory_date, max(l_shipdate) AS last_modified,
       concat('pairs with P', lpad(CAST((l_partkey * 7 + 1) % 2100 AS STRING), 6, '0'), ' stock') AS special_notes, CAST(l_partkey % 50 AS INT) AS min_stock_level
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, s_name)"""
FX_COMPLAINTS = """fx_complaints AS (
SELECT concat('CC', CAST(o_orderkey AS STRING)) AS complaint_id, CAST(o_orderdate AS DATE) AS complaint_date, c_name AS customer_name, c_mktsegment AS complaint_type,
       o_orderpriority AS severity, concat('order issue with P', lpad(CAST((o_orderkey * 13) % 2100 AS STRING), 6, '0'),
       ' and (P', lpad(CAST((o_orderkey * 29 + 5) % 2100 AS STRING), 6, '0'), ') ref XP000001 P0000012', CASE WHEN o_orderkey % 4 = 0 THEN concat(', also the ', p_name) ELSE '' END) AS description,
       o_orderstatus AS status, o_orderdate AS last_modified
FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % 200)"""
CODE_LINKS = r"""found AS (SELECT DISTINCT complaint_id, unnest(regexp_extract_all(description, '\bP\d{6}\b')) AS product_id FROM fx_complaints),
code_links AS (SELECT complaint_id, product_id FROM found SEMI JOIN fx_products USING (product_id))"""
NAME_LINKS = """texts AS (SELECT complaint_id, description FROM fx_complaints WHERE contains(description, ', also the ')),
names AS (SELECT DISTINCT product_name FROM fx_products WHERE product_name <> ''),
named AS (SELECT DISTINCT complaint_id, product_name FROM texts JOIN names ON contains(description, product_name)),
name_links AS (SELECT DISTINCT complaint_id, product_id FROM named JOIN fx_products USING (product_name))"""
LINKS = "links AS (SELECT complaint_id, list_sort(list(DISTINCT product_id)) AS ids FROM (SELECT * FROM code_links UNION SELECT * FROM name_links) GROUP BY complaint_id)"
