"""Views that read the given tables as conversation records, each with the same view in SQL.

Every column is a plain expression over one source row, so filters and column pruning reach the
Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import sized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


# ------------------------------------------------------------------ evaluation trials

def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial of a task: two arms, two customers, dead trials (no reward) included."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("task_id"),
        F.when(F.col("l_linestatus") == "O", "base").otherwise("trained").alias("arm"),
        F.when(F.col("l_tax") < 0.04, "A").otherwise("B").alias("customer"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("success"),
        F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("db_ok"),
        (F.col("l_discount") == 0).alias("dead"),
        F.col("l_quantity").alias("secs"), F.col("l_tax").alias("usd"),
        F.trunc("l_shipdate", "month").alias("month"), F.col("l_orderkey").alias("order_id"))


TRIALS_SQL = """trials AS (SELECT l_partkey AS task_id, CASE WHEN l_linestatus = 'O' THEN 'base' ELSE 'trained' END AS arm,
  CASE WHEN l_tax < 0.04 THEN 'A' ELSE 'B' END AS customer, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS success,
  CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS db_ok, l_discount = 0 AS dead, l_quantity AS secs, l_tax AS usd,
  date_trunc('month', l_shipdate) AS month, l_orderkey AS order_id FROM lineitem)"""


# ------------------------------------------------------------------ rollout groups

def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per episode of a rollout group (an order); the ending follows the discount."""
    li = table(spark, sf_dir, "lineitem")
    d = F.col("l_discount")
    return li.select(
        F.col("l_orderkey").alias("group_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("episode_id"),
        F.col("l_partkey").alias("task_id"), F.col("l_suppkey").alias("batch_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("reward"),
        F.when(d < 0.005, "customer_api_error").when(d < 0.015, "max_turns").when(d < 0.025, "length")
        .otherwise("natural").alias("termination"),
        F.col("l_quantity").alias("n_turns"), F.col("l_tax").alias("usd"), F.col("l_extendedprice").alias("wall_s"))


ROLLOUTS_SQL = """rollouts AS (SELECT l_orderkey AS group_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS episode_id, l_partkey AS task_id, l_suppkey AS batch_id,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS reward,
  CASE WHEN l_discount < 0.005 THEN 'customer_api_error' WHEN l_discount < 0.015 THEN 'max_turns'
       WHEN l_discount < 0.025 THEN 'length' ELSE 'natural' END AS termination,
  l_quantity AS n_turns, l_tax AS usd, l_extendedprice AS wall_s FROM lineitem)"""


# ------------------------------------------------------------------ calls on an event stream

def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tool call: an episode is a user's day; an error event is a rejected purchase."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("episode_id"),
        F.col("user_id"), F.col("ts"), F.col("event_id"),
        F.when(F.col("event_type") == "error", "purchase").otherwise(F.col("event_type")).alias("tool"),
        (F.col("event_type") == "error").alias("rejected"), F.col("value"),
        F.get_json_object("props", "$.k").alias("target"), F.col("props"))


EVENT_CALLS_SQL = """event_calls AS (SELECT concat_ws('/', user_id, CAST(CAST(ts AS DATE) AS VARCHAR)) AS episode_id, user_id, ts, event_id,
  CASE WHEN event_type = 'error' THEN 'purchase' ELSE event_type END AS tool, event_type = 'error' AS rejected, value,
  json_extract_string(props, '$.k') AS target, props FROM events)"""

EVENT_READ = ("view", "signup")
EVENT_AUTH = ("signup",)


# ------------------------------------------------------------------ store entities

def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product variant: a part is a variant of the product (brand, type)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("/", "p_brand", "p_type").alias("product"), F.col("p_partkey").alias("item_id"),
                    F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string")).alias("options"),
                    (F.col("p_size") != 13).alias("available"), F.col("p_retailprice").alias("price"))


VARIANTS_SQL = """variants AS (SELECT p_brand || '/' || p_type AS product, p_partkey AS item_id, p_name AS name, CAST(p_size AS VARCHAR) AS size,
  p_size AS size_n, p_size <> 13 AS available, p_retailprice AS price FROM part)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "pending").otherwise("processed")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
                    F.col("o_orderpriority").alias("city"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("at"))


ORDERS_SQL = """ord AS (SELECT o_orderkey AS order_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'processed' END AS status,
  o_orderpriority AS city, o_totalprice AS total, o_orderdate AS at FROM orders)"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ordered item, with its order and variant, laid by order over as many tasks as the items need: what groups
    by order next needs no other shuffle. AQE broadcasts the variants when their measured size allows and splits skewed
    partitions when not."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("item_id"),
        F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"), F.col("l_suppkey").alias("supp"))
    rows = item_rows(spark, sf_dir)
    return sized(li.join(variants(spark, sf_dir), "item_id"), rows, "order_id").join(sized(orders(spark, sf_dir), rows, "order_id"), "order_id")


def item_rows(spark: SparkSession, sf_dir: str) -> int:
    """How many item rows there are at most (item and order ids are keys), from the footers of the files."""
    return table(spark, sf_dir, "lineitem").count()


ITEMS_SQL = VARIANTS_SQL + ",\n" + ORDERS_SQL + """,
items AS (SELECT l_orderkey AS order_id, l_linenumber AS pos, l_partkey AS item_id, l_returnflag AS flag, l_discount AS discount, l_suppkey AS supp,
  v.* EXCLUDE (item_id), o.* EXCLUDE (order_id) FROM lineitem JOIN variants v ON v.item_id = l_partkey JOIN ord o ON o.order_id = l_orderkey)"""
