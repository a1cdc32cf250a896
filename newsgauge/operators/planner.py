"""Search plans: what is asked of a source for each company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.text import quote, text_or_empty

from .prefilter import query_shape, trusted


def plan_queries(companies: DataFrame) -> DataFrame:
    """company_id, query, strategy, qualified, rationale.

    Qualifiers are sent only if the pre-filter will hold items to them (``trusted``):
    asking for more than the filter enforces loses items, and so does the reverse.
    """
    shaped = companies.withColumn("_more", query_shape("query")["disambiguates"])
    name, own = quote("name"), F.trim(text_or_empty("query"))
    sent = F.col("_more") & trusted("query_source")
    override = (F.col("query_source") == "human-approved") & (own != name)
    return shaped.select(
        "company_id",
        F.when(sent, F.col("query")).when(F.col("_more"), name).when(own == "", name).otherwise(own).alias("query"),
        F.when(sent & F.coalesce(override, F.lit(False)), "override").when(sent, "qualified").otherwise("exact-phrase").alias("strategy"),
        sent.alias("qualified"),
        F.when(sent, "approved qualifiers, enforced by the filter")
        .when(F.col("_more"), "unapproved qualifiers are neither sent nor enforced")
        .otherwise("the name alone is distinctive").alias("rationale"),
    )


def plan_summary(plans: DataFrame) -> DataFrame:
    """strategy, companies, qualified; every strategy is listed."""
    every = plans.sparkSession.createDataFrame([("override",), ("qualified",), ("exact-phrase",)], "strategy string")
    counted = plans.groupBy("strategy").agg(F.count("*").alias("companies"), F.count_if("qualified").alias("qualified"))
    return every.join(counted, "strategy", "left").fillna(0, ["companies", "qualified"])
