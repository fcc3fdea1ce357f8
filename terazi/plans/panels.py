"""Panels derived from the driver's tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.metadata import ROWS

#: Instrument code that stands for each part type.
TYPE_CODES = {"ECONOMY": "hs", "SMALL": "dt", "MEDIUM": "km", "PROMO": "kkstl", "STANDARD": "yyf", "LARGE": "eut"}
MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and month of shipping: units, orders as holders, value as size."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.date_trunc("month", "l_shipdate").cast("date").alias("date"), "l_orderkey", F.col("l_quantity").cast(MONEY).alias("q"), F.col("l_extendedprice").cast(MONEY).alias("v"))
    g = lines.groupBy("k", "date").agg(F.sum("q").cast("double").alias("units"), F.count_distinct("l_orderkey").alias("holders"), F.sum("v").cast("double").alias("aum"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("fund_name"))
    return g.join(names, "k").select(F.format_string("S%05d", "k").alias("fund_code"), "fund_name", "date", (F.col("aum") / F.nullif("units", F.lit(0.0))).alias("price"), "units", "holders", "aum")


def supplier_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long allocation: share of each part type in a supplier's value of a month, in percent."""
    code = F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_CODES.items() for x in kv)), F.col("p_type"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), code.alias("code"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("k"), F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").cast(MONEY).alias("v"))
    g = lines.join(parts, "l_partkey").groupBy("k", "date", "code").agg(F.sum("v").cast("double").alias("v"))
    from pyspark.sql import Window

    total = F.sum(F.col("v").cast(MONEY)).over(Window.partitionBy("k", "date")).cast("double")
    return g.select(F.format_string("S%05d", "k").alias("fund_code"), "date", "code", (F.col("v") / total * 100).alias("weight"))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day of events: count as units, value as size, types as holders."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("date"), F.col("value").cast(MONEY).alias("v"), "event_type").filter("user_id is not null and date is not null")
    g = e.groupBy("user_id", "date").agg(F.count("*").cast("double").alias("units"), F.count_distinct("event_type").alias("holders"), F.coalesce(F.sum("v").cast("double"), F.lit(0.0)).alias("aum"))
    return g.select(F.format_string("U%05d", "user_id").alias("fund_code"), F.format_string("TEST%d PORTFÖY FON %d", F.col("user_id") % 4, F.col("user_id")).alias("fund_name"), "date", (F.col("aum") / F.col("units")).alias("price"), "units", "holders", "aum")


P = """p AS (SELECT printf('S%05d', l_suppkey) AS fund_code, s_name AS fund_name, date, aum / nullif(units, 0) AS price, units, holders, aum FROM (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units,
    count(DISTINCT l_orderkey) AS holders, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS aum FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = l_suppkey)"""
W = f"""w0 AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CASE p_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_CODES.items())} END AS code,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
a AS (SELECT printf('S%05d', l_suppkey) AS fund_code, date, code, v / CAST(sum(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY l_suppkey, date) AS DOUBLE) * 100 AS weight FROM w0)"""
U = """p AS (SELECT printf('U%05d', user_id) AS fund_code, 'TEST' || CAST(user_id % 4 AS VARCHAR) || ' PORTFÖY FON ' || CAST(user_id AS VARCHAR) AS fund_name, date, aum / units AS price, units, holders, aum FROM (
  SELECT user_id, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS units, count(DISTINCT event_type) AS holders, coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 0) AS aum FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2))"""
DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in ROWS) + ") AS t(code, name_en, asset_group, broad_group, market_scope, currency, screen))"
F_SQL = """f0 AS (SELECT *, lag(date) OVER w AS prev_date, lag(price) OVER w AS prev_price, lag(aum) OVER w AS prev_aum, lag(holders) OVER w AS prev_holders, lag(units) OVER w AS prev_units
  FROM p WINDOW w AS (PARTITION BY fund_code ORDER BY date)),
f AS (SELECT *, price / nullif(prev_price, 0) - 1 AS fund_return, aum - prev_aum * (1 + (price / nullif(prev_price, 0) - 1)) AS flow_aum, (units - prev_units) * price AS flow_unit FROM f0)"""
