"""The domain tables as a mapping of the driver's ``events``: views and signups are receipts, purchases transactions, clicks visits.

Nulls and missing codes are put in by the id's remainders, so that every rule has rows to act on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint")
    return ev.select(F.col("event_id").alias("id"), "user_id", "event_type", F.to_date("ts").alias("d"), F.floor(F.col("value") * 100).cast("bigint").alias("cents"), k.alias("k"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where(F.col("event_type").isin("view", "signup"))
    r = ev.select(
        F.col("id").alias("receipt_key"), F.expr("if(id % 41 = 0, -1, user_id)").alias("User_id_code"), F.expr("k % 4").alias("Coupon_id_code"), F.col("cents").alias("Coupon_amt_cent"),
        F.expr("if(id % 37 = 0, null, d)").alias("Receive_date"), F.expr("date_add(d, cast(id % 5 - 2 as int))").alias("Start_date"), F.col("id"),
        F.expr("if(id % 29 = 0, null, cents * (id % 4))").alias("Price_limit_cent"), F.expr("1 + id % 3").alias("Coupon_status"),
    )
    return r.withColumn("End_date", F.expr("date_add(Start_date, cast(id % 13 as int))")).drop("id")


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where("event_type = 'purchase'")
    return ev.select(
        F.col("id").alias("txn_key"), F.expr("if(id % 59 = 0, -1, user_id)").alias("User_id_code"), F.expr("if(id % 47 = 0, -1, id % 7)").alias("Shop_id_code"), F.expr("id div 3").alias("Order_id_code"),
        F.expr("case when id % 3 = 0 then -1 when id % 31 = 0 then 99 else k % 4 end").alias("Coupon_id_code"), F.lit(1).cast("bigint").alias("Coupon_type"), F.expr("if(id % 53 = 0, null, 'A')").alias("Biz_code"),
        F.expr("if(id % 43 = 0, null, d)").alias("Pay_date"), F.expr("if(id % 61 = 0, -cents, cents)").alias("Actual_pay_cent"), F.expr("if(id % 2 = 0, 0, cents div 10)").alias("Reduce_amount_cent"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("User_id_code"), F.col("d").alias("Visit_date"))


#: The same mapping for DuckDB.
SQL = """ev AS (SELECT event_id AS id, user_id, event_type, CAST(ts AS DATE) AS d, CAST(floor(value * 100) AS BIGINT) AS cents, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
receipts AS (
  SELECT id AS receipt_key, CASE WHEN id % 41 = 0 THEN -1 ELSE user_id END AS User_id_code, k % 4 AS Coupon_id_code, cents AS Coupon_amt_cent,
    CASE WHEN id % 37 = 0 THEN NULL ELSE d END AS Receive_date, d + CAST(id % 5 - 2 AS INTEGER) AS Start_date, d + CAST(id % 5 - 2 + id % 13 AS INTEGER) AS End_date,
    CASE WHEN id % 29 = 0 THEN NULL ELSE cents * (id % 4) END AS Price_limit_cent, 1 + id % 3 AS Coupon_status
  FROM ev WHERE event_type IN ('view', 'signup')),
txns AS (
  SELECT id AS txn_key, CASE WHEN id % 59 = 0 THEN -1 ELSE user_id END AS User_id_code, CASE WHEN id % 47 = 0 THEN -1 ELSE id % 7 END AS Shop_id_code, id // 3 AS Order_id_code,
    CASE WHEN id % 3 = 0 THEN -1 WHEN id % 31 = 0 THEN 99 ELSE k % 4 END AS Coupon_id_code, CAST(1 AS BIGINT) AS Coupon_type, CASE WHEN id % 53 = 0 THEN NULL ELSE 'A' END AS Biz_code,
    CASE WHEN id % 43 = 0 THEN NULL ELSE d END AS Pay_date, CASE WHEN id % 61 = 0 THEN -cents ELSE cents END AS Actual_pay_cent, CASE WHEN id % 2 = 0 THEN 0 ELSE cents // 10 END AS Reduce_amount_cent
  FROM ev WHERE event_type = 'purchase'),
visits AS (SELECT user_id AS User_id_code, d AS Visit_date FROM ev WHERE event_type = 'click')"""
