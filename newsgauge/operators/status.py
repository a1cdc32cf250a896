"""Coverage status: rollups, summaries, details, and orders of the company table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.functions.dates import bucket, days_before, days_since, describe, month

SENTIMENTS = ("positive", "negative", "neutral")


def coverage(mentions: DataFrame) -> DataFrame:
    """Published coverage: relevant and classified."""
    return mentions.where(F.col("relevant") & F.col("classified_at").isNotNull())


def pending(mentions: DataFrame, most: int = 500) -> DataFrame:
    return mentions.where(F.col("classified_at").isNull()).orderBy("id").limit(most)


def recent_alerts(alerts: DataFrame, most: int = 50) -> DataFrame:
    """The alerts sent last, newest first; ties by mention and channel, unsent ones at the end."""
    return alerts.orderBy(F.col("sent_at").desc_nulls_last(), "mention_id", "channel").limit(most)


def status_rollup(companies: DataFrame, mentions: DataFrame, since: Column, now: Column) -> DataFrame:
    """One row for every company, with or without coverage.

    mentions: company_id, relevant, sentiment, published_at (the article's). The last
    mention is over all time, the counts over the window, which has no upper end.
    Mentions are reduced to one row a company before they meet the companies.
    """
    relevant = mentions.where("relevant")
    inside = F.col("published_at") >= since
    counts = [F.count_if(inside & (F.col("sentiment") == s)).alias(s) for s in SENTIMENTS]
    per = relevant.groupBy("company_id").agg(
        F.max("published_at").alias("last_mentioned_at"), F.count_if(inside).alias("mentions_in_window"), *counts
    )
    out = companies.join(per, "company_id", "left").fillna(0, ["mentions_in_window", *SENTIMENTS])
    out = out.withColumn("days_since_last_mention", days_since("last_mentioned_at", now))
    return out.withColumn("status", bucket(F.col("days_since_last_mention"))).withColumn(
        "status_text", describe(F.col("days_since_last_mention"))
    )


def window_start(now: Column, days: int, by_date: bool = False) -> Column:
    """Start of the trailing window; by_date takes in the whole first day."""
    start = days_before(now, days)
    return F.to_date(start).cast("timestamp") if by_date else start


def coverage_series(companies: DataFrame, published: DataFrame, first: str, last: str, days: int = 90) -> DataFrame:
    """company_id, day, mentions: coverage in the trailing window of every company at every day from first to last (inclusive).

    A mention enters on its day and leaves ``days`` days later: two events a mention, added up by (company, day)
    first, so that a company holds at most one step a day, and no row is multiplied by the length of the window. The
    days of a company are made after its steps have met it, so none of them is shuffled.
    """
    day = F.to_date("published_at")
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    near = published.where((day > F.date_sub(start, days)) & (day <= end))
    # what entered before the first day counts from it on; what leaves after the last day is left out
    events = near.select("company_id", F.explode(F.array(
        F.struct(F.greatest(day, start).alias("day"), F.lit(1).alias("step")), F.struct(F.date_add(day, days).alias("day"), F.lit(-1).alias("step"))
    )).alias("e")).select("company_id", "e.*")
    steps = events.where(F.col("day") <= end).groupBy("company_id", "day").agg(F.sum("step").alias("step"))
    # a company's steps are one row, a day each at most; its days come out of it after the last shuffle
    held = steps.groupBy("company_id").agg(F.collect_list(F.struct("day", "step")).alias("steps"))
    upto = lambda d: F.aggregate("steps", F.lit(0).cast("bigint"), lambda n, s: n + F.when(s["day"] <= d, s["step"]).otherwise(0))
    series = F.transform(F.sequence(start, end), lambda d: F.struct(d.alias("day"), F.coalesce(upto(d), F.lit(0)).cast("bigint").alias("mentions")))
    every = companies.select("company_id").join(held, "company_id", "left").select("company_id", series.alias("series"))
    return every.select("company_id", F.explode("series").alias("e")).select("company_id", "e.*")


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def mentions_by_month(published: DataFrame) -> DataFrame:
    """One for each mention."""
    return published.groupBy(month("published_at").alias("month")).agg(F.count("*").alias("n")).where("month IS NOT NULL")


def articles_by_month(articles: DataFrame, relevant: DataFrame) -> DataFrame:
    """One for each article with a relevant mention."""
    return mentions_by_month(articles.join(relevant.select("article_id").distinct(), "article_id", "left_semi"))


def top_companies(rollup: DataFrame, most: int = 20) -> DataFrame:
    return rollup.orderBy(F.desc("mentions_in_window"), "name").limit(most).select("name", "mentions_in_window", "status")


def totals_of_export(rollup: DataFrame, published: DataFrame) -> DataFrame:
    """Unwindowed counts of mentions, and the number of companies."""
    counts = [F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]
    made = published.agg(F.count("*").alias("mentions"), *counts)
    return made.withColumn("companies", rollup.agg(F.count("*")).scalar())


def totals_of_service(rollup: DataFrame) -> DataFrame:
    """Windowed sums, and companies with and without coverage. Differs from the export by design."""
    return rollup.agg(
        F.count("*").alias("companies"),
        F.sum("mentions_in_window").alias("mentions"),
        F.count_if(F.col("status") != "NO_COVERAGE").alias("with_coverage"),
        F.count_if(F.col("status") == "NO_COVERAGE").alias("without_coverage"),
        *[F.sum(s).alias(s) for s in SENTIMENTS],
    )


def company_detail(companies: DataFrame, mentions: DataFrame, articles: DataFrame, slug: str) -> DataFrame:
    """All coverage of one company, newest first; not limited to the window. No row if the slug is unknown."""
    one = companies.where(F.col("slug") == slug).select("company_id", "name", "slug")
    found = coverage(mentions).join(one, "company_id").join(articles, "article_id")
    return found.orderBy(F.col("published_at").desc_nulls_last(), "article_id")


def company_summaries(rollup: DataFrame, companies: DataFrame) -> DataFrame:
    own = companies.select("company_id", "sector", F.coalesce("ambiguity", F.lit("low")).alias("ambiguity"))
    return rollup.join(own, "company_id", "left")


def activity_order() -> list[Column]:
    return [F.col("last_mentioned_at").desc_nulls_last(), F.desc("mentions_in_window"), F.collate("name", "UNICODE")]


def grid_filter(
    summaries: DataFrame, search: str = "", statuses: tuple[str, ...] = (), sentiment: str = "", tier: str = ""
) -> DataFrame:
    """Conjunctive filters of the company table; what is empty does not filter."""
    if search.strip():
        words = F.lower(F.concat_ws(" ", "name", F.coalesce("sector", F.lit(""))))
        summaries = summaries.where(words.contains(search.strip().lower()))
    if statuses:
        summaries = summaries.where(F.col("status").isin(*statuses))
    if sentiment:
        summaries = summaries.where(F.col(sentiment) > 0)
    if tier:
        summaries = summaries.where(F.col("ambiguity") == tier)
    return summaries


def sentiment_shares(rollup: DataFrame) -> DataFrame:
    """Share of each sentiment among a company's windowed mentions, null without any."""
    total = F.nullif(sum((F.col(s) for s in SENTIMENTS), F.lit(0)), F.lit(0))
    return rollup.select("company_id", *[(F.col(s) / total).alias(f"{s}_share") for s in SENTIMENTS])


def health(companies: DataFrame, mentions: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: counts, and whether the latest run has not finished."""
    latest = runs.agg(F.max_by(F.col("finished_at").isNull(), "started_at").alias("run_in_progress"))
    return latest.select(
        companies.agg(F.count("*")).scalar().alias("companies"),
        mentions.agg(F.count("*")).scalar().alias("mentions"),
        F.coalesce("run_in_progress", F.lit(False)).alias("run_in_progress"),
    )
