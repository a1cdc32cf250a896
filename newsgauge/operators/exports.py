"""What is handed on: mentions, company status and the summary, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .status import SENTIMENTS, counts_by, coverage, mentions_by_month, top_companies, totals_of_export


def mention_export(mentions: DataFrame, articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Published mentions with their article and company; a mention that lacks either is left out.

    mentions: company_id, article_id, relevant, sentiment, classified_at, and of confidence,
    rationale, model, prompt_version what there is. The date is the article's.
    """
    more = [c for c in ("confidence", "rationale", "model", "prompt_version") if c in mentions.columns]
    found = coverage(mentions).select("company_id", "article_id", "sentiment", *more)
    found = found.join(companies.select("company_id", F.col("name").alias("company")), "company_id")
    return found.join(articles, "article_id").select(
        "company_id", "company", *[c for c in articles.columns if c != "company_id"], "sentiment", *more
    )


def status_export(rollup: DataFrame) -> DataFrame:
    """Every company, those without coverage too."""
    return rollup.select(
        "company_id", "name", "slug", "status", "status_text", "last_mentioned_at", "days_since_last_mention",
        "mentions_in_window", F.struct(*SENTIMENTS).alias("sentiment"),
    )


def summary_export(rollup: DataFrame, exported: DataFrame, now: Column, window_days: int) -> DataFrame:
    """One row: totals, companies by status, mentions by month, the companies with most mentions.

    Each part is aggregated before it meets the row: a few states, months, and twenty companies.
    """

    def mapped(rows: DataFrame, key: str) -> Column:
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))).scalar()

    place = F.struct((-F.col("mentions_in_window")).alias("less"), "name", F.col("mentions_in_window").alias("mentions"), "status")
    top = top_companies(rollup).agg(F.array_sort(F.collect_list(place)).alias("top"))
    named = F.transform("top", lambda t: F.struct(t["name"].alias("name"), t["mentions"].alias("mentions"), t["status"].alias("status")))
    totals = totals_of_export(rollup, exported)
    return totals.select(
        now.alias("generated_at"), F.lit(window_days).alias("window_days"), F.struct(*totals.columns).alias("totals"),
        mapped(counts_by(rollup, "status"), "status").alias("companies_by_status"),
        mapped(mentions_by_month(exported), "month").alias("mentions_by_month"),
        top.select(named).scalar().alias("top_companies"),
    )


def export_all(
    rollup: DataFrame, mentions: DataFrame, articles: DataFrame, companies: DataFrame, folder: str, now: Column, window_days: int = 90
) -> dict[str, str]:
    """Write mentions, company_status and quarterly_summary as JSON lines below folder; returns their paths."""
    exported = mention_export(mentions, articles, companies)
    parts = {
        "mentions": exported, "company_status": status_export(rollup),
        "quarterly_summary": summary_export(rollup, exported, now, window_days),
    }
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in parts}
