"""How the test tables play the engine's own: customers are companies, orders mentions of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock of the queries.
NOW_TEXT = "2001-08-01 00:00:00"


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("slug"),
        F.col("c_mktsegment").alias("sector"),
        F.when(F.col("c_nationkey") < 5, "critical").when(F.col("c_nationkey") < 10, "high")
        .when(F.col("c_nationkey") < 15, "medium").when(F.col("c_nationkey") < 20, "low").alias("ambiguity"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders are relevant; every order but those not specified is classified."""
    o = table(spark, sf_dir, "orders")
    mood = F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative").otherwise("neutral")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("article_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("relevant"), mood.alias("sentiment"), at.alias("published_at"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", at).alias("classified_at"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("article_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string")).alias("url"),
    )


#: SQL of the same for the oracle; each query prepends what it needs.
SQL_COMPANIES = """
    companies AS (SELECT c_custkey AS company_id, c_name AS name, lower(c_name) AS slug, c_mktsegment AS sector,
      CASE WHEN c_nationkey < 5 THEN 'critical' WHEN c_nationkey < 10 THEN 'high' WHEN c_nationkey < 15 THEN 'medium'
           WHEN c_nationkey < 20 THEN 'low' END AS ambiguity FROM customer)"""
SQL_MENTIONS = """
    mentions AS (SELECT o_orderkey AS id, o_custkey AS company_id, o_orderkey AS article_id,
      o_orderpriority = '1-URGENT' AS relevant,
      CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' ELSE 'neutral' END AS sentiment,
      o_orderdate AS published_at, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS classified_at
      FROM orders)"""
SQL_ROLLUP = f"""{SQL_COMPANIES},{SQL_MENTIONS},
    per AS (SELECT c.company_id, c.name, c.slug, c.sector, c.ambiguity,
        max(m.published_at) FILTER (WHERE m.relevant) AS last_at,
        count(*) FILTER (WHERE m.relevant AND m.published_at >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 90 DAY) AS mentions_in_window,
        count(*) FILTER (WHERE m.relevant AND m.published_at >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 90 DAY AND sentiment = 'positive') AS positive,
        count(*) FILTER (WHERE m.relevant AND m.published_at >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 90 DAY AND sentiment = 'negative') AS negative,
        count(*) FILTER (WHERE m.relevant AND m.published_at >= TIMESTAMP '{NOW_TEXT}' - INTERVAL 90 DAY AND sentiment = 'neutral') AS neutral
      FROM companies c LEFT JOIN mentions m ON m.company_id = c.company_id GROUP BY ALL),
    aged AS (SELECT *, greatest(0, floor(epoch_ms(TIMESTAMP '{NOW_TEXT}' - last_at) / 86400000.0))::BIGINT AS days FROM
      (SELECT * FROM per WHERE last_at IS NOT NULL) UNION ALL SELECT *, NULL::BIGINT FROM per WHERE last_at IS NULL),
    rollup_ AS (SELECT *, CASE WHEN days IS NULL THEN 'NO_COVERAGE' WHEN days <= 7 THEN 'FRESH' WHEN days <= 30 THEN 'RECENT'
        WHEN days <= 90 THEN 'STALE' ELSE 'DORMANT' END AS status FROM aged)"""
