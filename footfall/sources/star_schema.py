"""The shop tables (events, orders, order items, users) built from the star-schema files.

The files have the usual order-processing layout plus an ``events`` log.  Column
meanings are mapped as follows.

events   signup, view, click, purchase, error become home, department or product,
         cart, purchase, cancel; a view of low value is a department page.  Views
         and errors are logged without a user, as browsing before login is.  The
         tracking token is one per visitor and day.  Traffic source and browser are
         numbered by the number in the event's properties.
orders   states F and O (finished and open) count as revenue, P (in part) does not.
         The codes are kept, so that a filter on them reaches the scan.
items    sale price is the extended price less discount, as DECIMAL.
users    a customer signs up with the first order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.sources.tables import read_files

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
DEPARTMENT_VIEW_BELOW = 25
REVENUE_STATUSES = ("F", "O")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_files(spark, f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events")
    kind = F.col("event_type")
    page = (
        F.when(kind == "signup", "home")
        .when((kind == "view") & (F.col("value") < DEPARTMENT_VIEW_BELOW), "department")
        .when(kind == "view", "product")
        .when(kind == "click", "cart")
        .when(kind == "purchase", "purchase")
        .otherwise("cancel")
    )
    number = F.get_json_object("props", "$.k").cast("long")
    return log.select(
        F.col("event_id").alias("id"),
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("ts").alias("created_at"),
        page.alias("event_type"),
        F.when(~kind.isin("view", "error"), F.col("user_id")).alias("user_id"),
        F.col("user_id").alias("visitor_id"),
        F.concat(F.lit("/"), page).alias("uri"),
        F.concat(F.lit("source-"), number % 5).alias("traffic_source"),
        F.concat(F.lit("browser-"), number % 3).alias("browser"),
        F.col("value"),
        F.col("props"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("priority"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("sale_price"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    first_order = orders(spark, folder).groupBy("user_id").agg(F.min("created_at").alias("created_at"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("market")
    )
    return customers.join(first_order, customers["id"] == first_order["user_id"], "left").select(
        "id", "market", "created_at"
    )
